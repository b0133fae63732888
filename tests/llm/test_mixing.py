import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratalith.llm import mixing
from tests.llm import tables


def _cheapest(tokens, members, quotas):
    """Least total cost by trying all integer routings; tiny cases only."""
    cells = [(p, s) for p, m in enumerate(members) for s in m]
    best = None
    for flow in itertools.product(*(range(min(len(mixing.REPEAT_COSTS) * tokens[p], quotas[s]) + 1) for p, s in cells)):
        given, filled = [0] * len(tokens), [0] * len(quotas)
        for (p, s), x in zip(cells, flow, strict=True):
            given[p] += x
            filled[s] += x
        if any(f > q for f, q in zip(filled, quotas, strict=True)) or any(g > len(mixing.REPEAT_COSTS) * t for g, t in zip(given, tokens, strict=True)):
            continue
        best = min(x for x in (best, _cost(tokens, given, quotas, filled)) if x is not None)
    return best


def _cost(tokens, given, quotas, filled):
    cost = mixing.SHORTFALL_COST * (sum(quotas) - sum(filled))
    for g, t in zip(given, tokens, strict=True):
        for price in mixing.REPEAT_COSTS:
            used = min(g, t)
            cost, g = cost + used * price, g - used
    return cost


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_cheapest(seed):
    r = random.Random(seed)
    tokens = [r.randrange(0, 3) for _ in range(3)]
    members = [sorted(r.sample(range(2), r.randrange(1, 3))) for _ in tokens]
    quotas = [r.randrange(0, 5) for _ in range(2)]
    routed = mixing.route(tokens, members, quotas)
    given, filled = [0] * len(tokens), [0] * len(quotas)
    for (p, s), x in routed.items():
        assert s in members[p]
        given[p] += x
        filled[s] += x
    assert all(f <= q for f, q in zip(filled, quotas, strict=True))
    assert _cost(tokens, given, quotas, filled) == _cheapest(tokens, members, quotas)


def test_many_patterns_are_routed():
    """More patterns than any earlier limit, against the value of the maximal flow that a cut gives."""
    r = random.Random(2)
    n, width = 70_000, 300
    members = [sorted({r.randrange(width), r.randrange(width)}) for _ in range(n)]
    tokens = [r.randrange(1, 9) for _ in range(n)]
    quotas = [r.randrange(0, 3 * sum(tokens) // width) for _ in range(width)]
    routed = mixing.route(tokens, members, quotas)
    given, filled = [0] * n, [0] * width
    for (p, s), x in routed.items():
        given[p] += x
        filled[s] += x
    assert filled == quotas  # every source's members hold more than its quota, with repetition
    # Optimal: from no pattern with room in its kth use does a residual path lead to one that uses its tokens more than k times.
    fed = {}
    for (p, s), x in routed.items():
        fed.setdefault(s, []).append(p)
    for k in range(1, len(mixing.REPEAT_COSTS)):
        seen = {p for p in range(n) if given[p] < k * tokens[p]}
        front, sources = list(seen), set()
        while front:
            for s in members[front.pop()]:
                if s not in sources:
                    sources.add(s)
                    new = [p for p in fed.get(s, ()) if p not in seen]
                    seen.update(new)
                    front += new
        assert all(given[p] <= k * tokens[p] for p in seen)


def test_documents_beyond_all_pattern_limits(spark):
    d = spark.range(3000).select("id", F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("site|"), "id").alias("source"), F.concat(F.lit("l"), F.col("id") % 7).alias("lang"))
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == 3000 and len({p["pattern"] for p in plan}) == 3000


def test_names_with_the_separator_do_not_collide(spark):
    d = spark.createDataFrame([(1, "a b", ["x|y"]), (2, "a b", ["x", "y"]), (3, "a", ["x\\", "y"])], "doc_id long, text string, s array<string>")
    assert len({p["pattern"] for p in mixing.mix_plan(d, F.col("s")).collect()}) == 3


def test_documents_follow_the_plan(spark):
    """mix_documents decides from a row's own columns what mix_plan says; reserved names may be taken."""
    d = tables.docs(spark, [(i % 290, "w " * (i % 9), "en", "abc"[i % 3]) for i in range(300)]).withColumnRenamed("key", "__sl_cut").withColumnRenamed("node", "__SL_PATTERN")
    options = {"weights": {"s:a": 3.0, "s:b": 1.0, "s:c": 0.2}, "sources": _sources(), "budget_ratio": 0.7}
    expected = sorted((p["doc_id"], p["tokens"]) for p in mixing.mix_plan(d, **options).collect() for _ in range(p["epochs"]))
    mixed = mixing.mix_documents(d, **options)
    assert mixed.schema == d.schema
    assert sorted((r["doc_id"], len(r["text"].split())) for r in mixed.collect()) == expected


def _sources():
    return F.array(F.concat(F.lit("s:"), "source"))


def test_weights_are_met_and_the_order_is_seeded(spark):
    r = random.Random(1)
    rows = [(i, " ".join(tables.soup(i, r.randrange(5, 30))), "en", "ab"[i % 4 == 0]) for i in range(400)]
    d = tables.docs(spark, rows)
    plan = {x["doc_id"]: x for x in mixing.mix_plan(d, _sources(), {"s:a": 1.0, "s:b": 1.0}).collect()}
    assert len(plan) == 400
    total = sum(p["tokens"] for p in plan.values())
    for source in "ab":
        own = [p for i, p in plan.items() if "ab"[i % 4 == 0] == source]
        used = sum(p["tokens"] * p["epochs"] for p in own)
        assert total / 2 - 30 <= used <= total / 2
        assert max(p["epochs"] for p in own) - min(p["epochs"] for p in own) <= 1
    again = {x["doc_id"]: x["epochs"] for x in mixing.mix_plan(d.repartition(7), _sources(), {"s:a": 1.0, "s:b": 1.0}).collect()}
    assert again == {i: p["epochs"] for i, p in plan.items()}


def test_selection_is_the_longest_prefix_of_the_order(spark):
    """The bucketed cut gives what sorting each pattern whole gives."""
    d = tables.docs(spark, [(i, "w " * (i % 9), "en", "ab"[i % 3 == 0]) for i in range(300)])
    plan = mixing.mix_plan(d, _sources(), {"s:a": 3.0, "s:b": 1.0}, budget_ratio=0.5).withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id"), 34)).collect()
    for pattern in {p["pattern"] for p in plan}:
        own = sorted((p for p in plan if p["pattern"] == pattern and p["tokens"]), key=lambda p: (p["place"], p["doc_id"]))
        taken = [p["epochs"] for p in own]
        assert taken == sorted(taken, reverse=True)


def test_irregular_rows(spark):
    d = tables.messy(spark)
    plan = mixing.mix_plan(d).collect()
    assert len(plan) == d.where("doc_id IS NOT NULL").count()
    assert all(p["epochs"] == 1 for p in plan if not p["tokens"])
    assert {p["epochs"] for p in plan if p["doc_id"] == 11} == {0}  # it belongs to no source
    times = {p["doc_id"]: p["epochs"] for p in plan}
    mixed = mixing.mix_documents(d)
    assert mixed.schema == d.schema
    found = [r["doc_id"] for r in mixed.collect()]
    assert found.count(None) == 2
    assert found.count(3) == 2 * times[3]
    assert all(found.count(i) == times[i] for i in times if i != 3)


def test_no_sources_and_empty_table(spark):
    assert mixing.mix_plan(tables.empty(spark)).count() == 0
    assert mixing.mix_documents(tables.empty(spark)).count() == 0
    none = mixing.mix_plan(tables.docs(spark, [(1, "a b"), (2, "")]), F.lit(None).cast("array<string>")).collect()
    assert {r["doc_id"]: r["epochs"] for r in none} == {1: 0, 2: 1}


def test_default_targets_temper_a_hot_source(spark):
    """A source with nearly all tokens is thinned, the others are repeated, and everything stays within its quota."""
    d = tables.docs(spark, [(i, " ".join(tables.soup(i, 10)), "en", "hot" if i % 20 else f"s{i % 3}") for i in range(800)])
    used = {}
    for p in mixing.mix_plan(d, _sources()).collect():
        used.setdefault(p["pattern"], []).append(p["epochs"])
    mean = {k: sum(v) / len(v) for k, v in used.items()}
    assert mean["s:hot"] < 0.8 and all(mean[f"s:s{k}"] > 2 for k in range(3))
    assert max(max(v) for v in used.values()) <= len(mixing.REPEAT_COSTS)
