"""Histories of saves: which to keep, what they are called, how they are linked anew, and ancestry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.operators.graph import chain_closure, chain_ends, closure
from stratalith.storage import written

_KINDS = ("all", "dailies", "monthlies", "yearlies")


def classify_saves(saves: DataFrame, now: int, keep: Mapping[str, float], branch: str = "branch", utc: str = "utc", tie: str = "id") -> DataFrame:
    """saves with `keep`: all since now - keep['all']; before that the newest of each run of a day, of a month, of a year.

    Runs are of neighbours, not groups, and days and months are taken without their year: the same month of two years is one
    run if nothing lies between. A kind that is not named keeps nothing. Days are those of the session's time zone."""
    if not keep:
        raise ValueError("at least one of " + ", ".join(_KINDS) + " must be kept")
    at = F.timestamp_seconds(utc)
    since = {k: now - keep[k] if k in keep else float("inf") for k in _KINDS}
    phase, region = F.lit(4), F.lit(0)
    for i in (3, 2, 1, 0):
        edge = since[_KINDS[i]]
        if edge != float("inf"):
            phase = F.when(F.col(utc) >= edge, i).otherwise(phase)
    for i, part in ((1, F.dayofyear(at)), (2, F.month(at)), (3, F.year(at))):
        region = F.when(F.col("__phase") == i, part).otherwise(region)
    rows = saves.withColumn("__phase", phase).withColumn("__region", region)
    before = F.lag("__region").over(Window.partitionBy(branch, "__phase").orderBy(F.desc(utc), F.desc(tie)))
    kept = F.when(F.col("__phase") == 0, True).when(F.col("__phase") == 4, False).otherwise(~before.eqNullSafe(F.col("__region")))
    return rows.withColumn("keep", kept).drop("__phase", "__region")


def save_names(saves: DataFrame, branch: str = "branch", utc: str = "utc", tie: str = "id") -> DataFrame:
    """saves with `name`: the time; names that occur several times get a suffix that falls to 0 from the newest to the oldest."""
    plain = F.date_format(F.timestamp_seconds(utc), "yyyy-MM-dd-HHmmss")
    same = Window.partitionBy(branch, "__name")
    rows = saves.withColumn("__name", plain).withColumn("__n", F.count(F.lit(1)).over(same)).withColumn("__k", F.row_number().over(same.orderBy(F.desc(utc), F.desc(tie))))
    digits = F.length((F.col("__n") - 1).cast("string"))
    name = F.when(F.col("__n") == 1, F.col("__name")).otherwise(F.concat("__name", F.lit("-"), F.lpad((F.col("__n") - F.col("__k")).cast("string"), digits, F.lit("0"))))
    return rows.withColumn("name", name).drop("__name", "__n", "__k")


def suffix_duplicates(rows: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """rows with `unique_name`: as save_names, for any names in any order."""
    same = Window.partitionBy(by, name)
    n, k = F.count(F.lit(1)).over(same), F.row_number().over(same.orderBy(order))
    return rows.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(name, F.lit("-"), F.lpad((n - k).cast("string"), F.length((n - 1).cast("string")), F.lit("0")))))


def latest(saves: DataFrame, branch: str = "branch", utc: str = "utc", tie: str = "id") -> DataFrame:
    """(branch, utc, id) of each branch's newest save."""
    return saves.groupBy(branch).agg(F.max(F.struct(utc, tie)).alias("x")).select(branch, F.col(f"x.{utc}").alias(utc), F.col(f"x.{tie}").alias(tie))


def relink(saves: DataFrame, keep: Column, branch: str = "branch", utc: str = "utc", tie: str = "id") -> DataFrame:
    """(branch, id, parent, rewritten): the kept saves, each on top of the kept one before it; from the first dropped one on
    they are written anew."""
    w = Window.partitionBy(branch).orderBy(utc, tie)
    marked = saves.withColumn("__keep", keep).withColumn("__gone", F.max((~F.col("__keep")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = marked.where("__keep")
    return left.select(branch, tie, F.lag(tie).over(w).alias("parent"), (F.col("__gone") == 1).alias("rewritten"))


def leading_run(rows: DataFrame, holds: Column, by: str, *order: Column | str) -> DataFrame:
    """rows with `leading`: whether the predicate holds there and for all rows before."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("leading", F.min(holds.cast("int")).over(w) == 1)


def ancestors(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, oid, depth): the commits that each tip reaches over parents (child, parent), itself included. Histories without
    merges are followed by doubling jumps, others step by step."""
    edges = parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    edges = written(edges, "parents")
    start = tips.select(F.col("oid").alias("root"), F.col("oid").alias("node"))
    merges = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    reach = chain_closure(edges, start) if merges.isEmpty() else closure(edges, start)
    return reach.select(F.col("root").alias("tip"), F.col("node").alias("oid"), "depth")


def _places(parents: DataFrame) -> DataFrame | None:
    """(oid, line, place, unsure) of the commits that have a parent: their oldest ancestor, and how many steps it is away; None
    where a commit has several parents. A commit can only descend from one of its line whose place is not higher. It does, unless
    it is unsure: the line has a fork, or there is no oldest ancestor, as parents (child, parent) form a cycle."""
    pairs = parents.where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent")
    edges = written(pairs.groupBy(F.col("child").alias("src")).agg(F.min("parent").alias("dst"), F.max("parent").alias("other")), "parents")
    if not edges.where("dst <> other").isEmpty():
        return None
    ends = chain_ends(edges.select("src", "dst"))
    places = ends.select(F.col("node").alias("oid"), F.col("end").alias("line"), F.col("steps").alias("place"), F.col("end").isNull().alias("unsure"))
    forks = written(edges.groupBy(F.col("dst").alias("oid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("oid"), "forks")
    if forks.isEmpty():
        return places
    forked = forks.join(places, "oid", "left").select(F.coalesce("line", "oid").alias("line")).distinct().withColumn("fork", F.lit(True))
    return places.join(forked, "line", "left").select("oid", "line", "place", (F.col("unsure") | F.col("fork").isNotNull()).alias("unsure"))


def _placed(rows: DataFrame, places: DataFrame, oid: str, at: str) -> DataFrame:
    """rows with a struct of column oid's place, named at; a commit without a parent begins a line of its own."""
    known = places.select(F.col("oid").alias("__oid"), "line", "place", "unsure")
    line = F.when(F.col("place").isNull(), F.col(oid)).otherwise(F.col("line"))
    where = F.struct(line.alias("line"), F.coalesce("place", F.lit(0).cast("long")).alias("place"), F.coalesce("unsure", F.lit(False)).alias("unsure"))
    return rows.join(known, F.col(oid) == F.col("__oid"), "left").select(*rows.columns, where.alias(at))


def _allowed(parents: DataFrame, places: DataFrame, asked: DataFrame) -> DataFrame:
    """(src, dest, allowed) of asked (src, dest, at_src, at_dest); only what is unsure is followed through the history."""
    may = F.col("src").isNotNull() & F.col("at_src.line").eqNullSafe(F.col("at_dest.line")) & (F.col("at_dest.place") <= F.col("at_src.place"))
    allowed = (F.col("dest").isNull() | may).alias("allowed")
    if places.where("unsure").isEmpty():
        return asked.select("src", "dest", allowed)
    unsure = F.col("dest").isNotNull() & may & F.col("at_src.unsure") & F.col("at_dest.unsure")
    rest = written(asked.where(unsure).select("src", "dest"), "unsure")
    return asked.where(~unsure).select("src", "dest", allowed).unionByName(_followed(parents, rest))


def _followed(parents: DataFrame, requests: DataFrame) -> DataFrame:
    reach = ancestors(parents, requests.select(F.col("src").alias("oid")).distinct())
    joined = requests.join(reach, (F.col("src") == F.col("tip")) & (F.col("dest") == F.col("oid")), "left")
    return joined.select("src", "dest", (F.col("dest").isNull() | F.col("oid").isNotNull()).alias("allowed"))


def fast_forwards(parents: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (src, dest) with `allowed`: dest is null or an ancestor of src. Without merges the places of both in their line
    tell, and no history is listed."""
    places = _places(parents)
    if places is None:
        return _followed(parents, requests.select("src", "dest"))
    return _allowed(parents, places, _placed(_placed(requests.select("src", "dest"), places, "src", "at_src"), places, "dest", "at_dest"))


def fast_forwards_within(parents: DataFrame, commits: DataFrame, by: str) -> DataFrame:
    """fast_forwards() of all ordered pairs of commits (oid, by) of one group: places are joined to the commits, not to the pairs."""
    places = _places(parents)
    rows = commits.select("oid", by).withColumn("at", F.lit(None)) if places is None else _placed(commits.select("oid", by), places, "oid", "at")
    a, b = (rows.select(by, F.col("oid").alias(x), F.col("at").alias(f"at_{x}")) for x in ("src", "dest"))
    asked = a.join(b, by)
    return _followed(parents, asked.select("src", "dest")) if places is None else _allowed(parents, places, asked)


def rev_list(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, oid, utc, place, depth): each tip's history, newest first, of one time the nearest to the tip. commits: (oid, parent, utc)."""
    reach = ancestors(commits.where("parent IS NOT NULL").select(F.col("oid").alias("child"), "parent"), tips)
    dated = reach.join(commits.select("oid", "utc").distinct(), "oid")
    return dated.select("tip", "oid", "utc", F.row_number().over(Window.partitionBy("tip").orderBy(F.desc("utc"), "depth", "oid")).alias("place"), "depth")


def resolve_names(names: DataFrame, refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(name, oid): the branch of that name, otherwise the stored object of that id; null where there is neither."""
    by_ref = names.join(refs.select(F.expr("replace(name, 'refs/heads/', '')").alias("name"), F.col("oid").alias("r")).where("r IS NOT NULL"), "name", "left")
    by_id = by_ref.join(objects.select(F.col("oid").alias("o")).distinct(), F.lower("name") == F.col("o"), "left")
    return by_id.select("name", F.coalesce("r", "o").alias("oid"))


def names_by_object(refs: DataFrame, prefix: str = "refs/tags/") -> DataFrame:
    """(oid, names): sorted names of the references below prefix that point to each object."""
    short = F.substr("name", F.lit(len(prefix) + 1))
    return refs.where(F.startswith("name", F.lit(prefix))).groupBy("oid").agg(F.array_join(F.array_sort(F.collect_list(short)), ",").alias("names"))


def repair_counts(repairs: DataFrame, grave: Column, item: str, kind: str = "kind") -> DataFrame:
    """(kind, n, named): how many repairs of each kind, and the sorted items of the grave ones, null without any."""
    named = F.array_sort(F.collect_list(F.when(grave, F.col(item))))
    return repairs.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), named.alias("named")).select(kind, "n", F.when(F.size("named") > 0, F.array_join("named", ",")).alias("named"))


def converted(items: DataFrame, memo: DataFrame, stored: DataFrame) -> DataFrame:
    """items (src, ...) with `dst`: what an earlier rewrite made of src, by memo (src, dst), if that is stored (oid) still."""
    usable = memo.join(stored.select(F.col("oid").alias("dst")).distinct(), "dst", "left_semi").groupBy("src").agg(F.min("dst").alias("dst"))
    return items.join(usable, "src", "left")


def pack_numbers(objects: DataFrame, order: str, size: str, by: str, most_bytes: int = 1_000_000_000, most_objects: int = 200_000) -> DataFrame:
    """objects with `pack`: the number of the pack each goes to. A pack is closed when it holds most_bytes or most_objects, so
    each writer's (`by`) objects are taken in order."""
    import pandas as pd

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in objects.schema)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        numbers, pack, held, count = [], 0, 0, 0
        for n in part[size].tolist():
            numbers.append(pack)
            held, count = held + n, count + 1
            if held >= most_bytes or count >= most_objects:
                pack, held, count = pack + 1, 0, 0
        return part.assign(pack=numbers)

    return objects.groupBy(by).applyInPandas(run, f"{schema}, pack long")
