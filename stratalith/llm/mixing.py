"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to any set of sources; documents with the same set form a pattern. The driver sees one total a pattern
(about 200 bytes each), routes tokens from patterns to the sources' quotas, and sends back each pattern's passes; where the
last pass runs out in a pattern's seeded order is found by sums over buckets in Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.llm.common import few, free_name, settle
from stratalith.llm.packing import word_count

#: Cost of each repetition of a token, the first use first: convex, so that everything is used once before anything is used twice.
REPEAT_COSTS = (0, 4, 9, 16)
#: A quota that stays unfilled costs more than any repetition.
SHORTFALL_COST = 1000
#: Each pattern's seeded order is cut into 2**BUCKET_BITS buckets; the one in which a pass runs out is sorted.
BUCKET_BITS = 16
SEED = 17
#: Exponent of the default targets: 1 leaves the sources' shares as they are, 0 makes them equal.
POWER = 0.3


class Flow:
    """Min-cost flow from patterns to sources by the primal-dual method.

    Every unit's cost is that of the repetition it uses, or a shortfall's. So the shortest augmenting paths of cost 0 are
    those from patterns with room in their first use, the next ones those from patterns with room in their second, and so
    on: each price is one maximal flow (blocking flows over levels, as Dinic's) on top of the cheaper ones' flow, and what
    quotas lack in the end is shortfall. At no price does flow through an edge of a dearer one pay."""

    def __init__(self, members: Sequence[Sequence[int]], quotas: Sequence[int]) -> None:
        sizes = np.fromiter(map(len, members), dtype=np.int64, count=len(members))
        self.begin = np.r_[0, np.cumsum(sizes)].tolist()
        self.source = [s for m in members for s in m]
        self.pattern = np.repeat(np.arange(len(members)), sizes).tolist()
        self.sent = [0] * len(self.source)
        self.lack = list(quotas)
        self.fed: list[list[int]] = [[] for _ in quotas]
        for e, s in enumerate(self.source):
            self.fed[s].append(e)

    def augment(self, room: list[int]) -> None:
        """A maximal flow from patterns with so much room into what the sources lack."""
        while True:
            # Levels: patterns with room, the sources that they feed, patterns whose flow those sources could give back, ...
            level_p, level_s = [-1] * len(room), [-1] * len(self.lack)
            front = [p for p, r in enumerate(room) if r]
            for p in front:
                level_p[p] = 0
            depth, reached = 0, False
            while front and not reached:
                sources = []
                for p in front:
                    for e in range(self.begin[p], self.begin[p + 1]):
                        s = self.source[e]
                        if level_s[s] < 0:
                            level_s[s] = depth
                            sources.append(s)
                            reached = reached or self.lack[s] > 0
                depth += 1
                front = []
                if not reached:
                    for s in sources:
                        for e in self.fed[s]:
                            if self.sent[e] and level_p[p := self.pattern[e]] < 0:
                                level_p[p] = depth
                                front.append(p)
            if not reached:
                return
            at_p, at_s = [self.begin[p] for p in range(len(room))], [0] * len(self.lack)
            for first, r in enumerate(room):
                while r and level_p[first] == 0 and (pushed := self._push(first, r, level_p, level_s, at_p, at_s)):
                    r -= pushed
                room[first] = r

    def _push(self, first: int, room: int, level_p: list[int], level_s: list[int], at_p: list[int], at_s: list[int]) -> int:
        """Sends flow along one path of the level graph that begins at the pattern; 0 where none is left."""
        path: list[int] = []  # edges, forward and back in turn
        p = first
        while True:
            advanced = False
            while at_p[p] < self.begin[p + 1]:
                e = at_p[p]
                s = self.source[e]
                if level_s[s] != level_p[p]:
                    at_p[p] += 1
                    continue
                if self.lack[s]:
                    path.append(e)
                    most = min([room, self.lack[s], *(self.sent[b] for b in path[1::2])])
                    for k, x in enumerate(path):
                        self.sent[x] += -most if k % 2 else most
                    self.lack[s] -= most
                    return most
                fed = self.fed[s]
                while at_s[s] < len(fed):
                    b = fed[at_s[s]]
                    if self.sent[b] and level_p[self.pattern[b]] == level_s[s] + 1:
                        break
                    at_s[s] += 1
                else:
                    at_p[p] += 1
                    continue
                path += [e, fed[at_s[s]]]
                p = self.pattern[fed[at_s[s]]]
                advanced = True
                break
            if advanced:
                continue
            if not path:
                return 0
            back = path.pop()  # a dead end: the edge that led here is passed over
            e = path.pop()
            at_s[self.source[back]] += 1
            p = self.pattern[e]


def route(tokens: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int] = REPEAT_COSTS) -> dict[tuple[int, int], int]:
    """Tokens that each membership pattern gives to each source, {(pattern, source): tokens}.

    A pattern holds tokens[p] and may be used len(costs) times over, at costs[i] a token the (i+1)th time; it serves any
    of its members. A source takes its quota at most, and what it lacks costs SHORTFALL_COST a token."""
    flow, room = Flow(members, quotas), [0] * len(tokens)
    for cost in sorted(costs):
        if cost < SHORTFALL_COST:
            room = [left + held for left, held in zip(room, tokens, strict=True)]
            flow.augment(room)
    return {(flow.pattern[e], flow.source[e]): n for e, n in enumerate(flow.sent) if n}


def default_sources() -> Column:
    """A document belongs to its source and to its language."""
    return F.array_compact(F.array(F.concat(F.lit("source:"), F.col("source")), F.concat(F.lit("lang:"), F.col("lang"))))


def _quotas(held: Mapping[str, int], weights: Mapping[str, float] | None, budget: int, power: float) -> dict[str, int]:
    raw = {s: (held[s] ** power if weights is None else float(weights.get(s, 0.0))) for s in sorted(held)}
    total = sum(raw.values())
    return {s: int(budget * w / total) if total else 0 for s, w in raw.items()}


def _pattern(sources: Column | None) -> tuple[Column, Column]:
    """(members, pattern) of a row: the sorted distinct names, and the same as one string ('|' and '\\' inside names escaped)."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(default_sources() if sources is None else sources, F.array().cast("array<string>")))))
    return names, F.array_join(F.transform(names, lambda x: F.regexp_replace(x, r"([\\|])", r"\\$1")), "|")


def _place(seed: int) -> Column:
    """A row's place in the seeded order of its pattern: 30 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), 34)


def _bucket(place: Column) -> Column:
    return F.shiftright(place, 30 - BUCKET_BITS)


def _planned(docs: DataFrame, sources: Column | None, weights: Mapping[str, float] | None, budget_ratio: float, power: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, tokens, pattern, place) of the rows; (pattern, passes, cut): whole passes of each pattern, and the bucket in which a
    further one runs out (null where it takes all); (pattern, doc_id) of the documents of those buckets that it still takes."""
    spark = docs.sparkSession
    names, pattern = _pattern(sources)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(word_count(), F.lit(0)).alias("tokens"), names.alias("members"), pattern.alias("pattern"), _place(seed).alias("place"))
    rows = settle(rows, "mix")
    patterns = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("tokens").alias("tokens")).toPandas().sort_values("pattern", ignore_index=True)
    tokens, members = patterns["tokens"].astype("int64").tolist(), [list(m) for m in patterns["members"]]
    held: dict[str, int] = {}
    for own, n in zip(members, tokens, strict=True):
        for s in own:
            held[s] = held.get(s, 0) + n
    quotas = _quotas(held, weights, int(budget_ratio * sum(tokens)), power)
    number = {s: i for i, s in enumerate(quotas)}
    given = [0] * len(tokens)
    for (p, _), n in route(tokens, [[number[s] for s in own] for own in members], list(quotas.values())).items():
        given[p] += n
    passes = [g // n if n else 1 for g, n in zip(given, tokens, strict=True)]
    left = [g - w * n if n else 0 for g, w, n in zip(given, passes, tokens, strict=True)]
    table = spark.createDataFrame(pd.DataFrame({"pattern": patterns["pattern"], "passes": pd.Series(passes, dtype="int64"), "left": pd.Series(left, dtype="int64")}), "pattern string, passes long, left long")

    counted = rows.groupBy("pattern", _bucket(F.col("place")).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    table = few(settle(table, "plan"))
    upto = F.sum("tokens").over(Window.partitionBy("pattern").orderBy("bucket"))
    over = counted.join(table, "pattern").select("pattern", "bucket", (F.col("left") - upto + F.col("tokens")).alias("left"), (upto > F.col("left")).alias("over")).where("over")
    cuts = over.groupBy("pattern").agg(F.min(F.struct("bucket", "left")).alias("at")).select("pattern", F.col("at.bucket").alias("cut"), F.col("at.left").alias("left"))
    plan = settle(table.drop("left").join(cuts, "pattern", "left"), "plan")
    edge = rows.drop("members").join(few(plan), "pattern").where(_bucket(F.col("place")) == F.col("cut"))
    run = F.sum("tokens").over(Window.partitionBy("pattern").orderBy(F.struct("place", "doc_id")))
    taken = settle(edge.withColumn("run", run).where("run <= left").select("pattern", "doc_id").distinct(), "taken")
    return rows.drop("members"), plan.drop("left"), taken


def _epochs(worded: Column, passes: Column, cut: Column, bucket: Column, taken: Column) -> Column:
    more = F.when(cut.isNull() | (bucket < cut) | ((bucket == cut) & taken), 1).otherwise(0)
    return F.when(~worded, 1).otherwise(passes + more).cast("int")


def mix_plan(docs: DataFrame, sources: Column | None = None, weights: Mapping[str, float] | None = None, budget_ratio: float = 1.0, power: float = POWER, seed: int = SEED) -> DataFrame:
    """(doc_id, tokens, pattern, epochs) for every row of docs that has a doc_id: how often the mixture uses the document.

    sources gives the array of names of the sources a document belongs to (by default its source and its language), and
    weights the target share of each source; by default the shares are proportional to the tokens of each to `power`.
    The mixture has budget_ratio times the tokens of docs. Documents are added up by membership pattern, tokens are
    routed to quotas with convex costs of repetition, and each pattern's whole passes go to all its documents, the rest
    to those first in a seeded order, as many as fit.

    There may be any number of patterns; the driver holds about 200 bytes for each.

    Tokens are words. Null and empty texts have no tokens and are used once. Documents with tokens that belong to no
    source, or only to sources of weight 0, are used 0 times. Repeated rows are drawn together (one doc_id,
    one place in the order) and counted each. An empty table gives no rows. Other columns are ignored.
    """
    rows, plan, taken = _planned(docs, sources, weights, budget_ratio, power, seed)
    joined = rows.join(few(plan), "pattern").join(few(taken.withColumn("taken", F.lit(True))), ["pattern", "doc_id"], "left")
    epochs = _epochs(F.col("tokens") > 0, F.col("passes"), F.col("cut"), _bucket(F.col("place")), F.coalesce("taken", F.lit(False)))
    return joined.select("doc_id", "tokens", "pattern", epochs.alias("epochs"))


def mix_documents(docs: DataFrame, sources: Column | None = None, weights: Mapping[str, float] | None = None, budget_ratio: float = 1.0, power: float = POWER, seed: int = SEED) -> DataFrame:
    """docs with each row as often as mix_plan says of it (see there); all columns stay, whatever their names, and rows with a null
    doc_id stay once. A row's passes follow from its own columns and two small tables, so texts are not shuffled."""
    _, plan, taken = _planned(docs, sources, weights, budget_ratio, power, seed)
    pattern, passes, cut, chosen, doc = (free_name(docs, f"__sl_{x}") for x in ("pattern", "passes", "cut", "taken", "doc"))
    plan = plan.select(F.col("pattern").alias(pattern), F.col("passes").alias(passes), F.col("cut").alias(cut))
    taken = taken.select(F.col("pattern").alias(pattern), F.col("doc_id").alias(doc), F.lit(True).alias(chosen))
    joined = docs.withColumn(pattern, _pattern(sources)[1]).join(few(plan), pattern, "left")
    joined = joined.join(few(taken), (joined[pattern] == taken[pattern]) & (joined["doc_id"].cast("long") == taken[doc]), "left")
    worded = F.coalesce(F.regexp_like("text", F.lit(r"\S")), F.lit(False)) & F.col("doc_id").isNotNull()
    times = _epochs(worded, F.col(passes), F.col(cut), _bucket(_place(seed)), F.coalesce(F.col(chosen), F.lit(False)))
    n = free_name(docs, "__sl_n")
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(1), times))).select(*(docs[c] for c in docs.columns))
