"""Reachability over object graphs: rounds of joins against what has been seen, each written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.storage import written


def closure(edges: DataFrame, start: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): everything that each root reaches over edges (src, dst), beginning with start (root, node), and in
    how many steps at least.

    Nodes of stop (node) are reached but not left. A round joins only what the last one found, and adds only what is new;
    cycles and shared descendants cost nothing extra. There are as many rounds as the longest shortest path is long; the edges
    are computed once. chain_closure needs fewer rounds where every node has one successor at most."""
    edges = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    frontier = written(start.select("root", "node", F.lit(0).alias("depth")).where("node IS NOT NULL").distinct(), "frontier")
    rounds, seen = [frontier], frontier
    while True:
        leave = frontier if stop is None else frontier.join(stop.select("node"), "node", "left_anti")
        step = leave.join(edges.select("src", "dst"), leave["node"] == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(len(rounds)).alias("depth")).where("node IS NOT NULL").distinct()
        frontier = written(step.join(seen.select("root", "node"), ["root", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        rounds.append(frontier)
        seen = seen.unionByName(frontier)
        if len(rounds) % 16 == 0:  # a long history: one file set instead of many
            seen = written(seen, "seen")


def chain_closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """As closure, for edges with one dst a src at most: a round doubles the length of all jumps, so a chain of n steps takes
    log2(n) rounds, and each pair of root and node is made once. Cycles end the doubling, and their nodes keep the least depth."""
    jumps = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "jumps")
    seen = written(start.select("root", "node", F.lit(0).cast("long").alias("depth")).where("node IS NOT NULL").distinct(), "chain")
    length, nodes = 1, jumps.count()
    while length <= nodes:
        far = seen.join(jumps, seen["node"] == jumps["src"]).select("root", F.col("dst").alias("node"), (F.col("depth") + length).alias("depth"))
        if far.isEmpty():
            break
        seen = written(seen.unionByName(far), "chain")
        again = jumps.select(F.col("src").alias("via"), F.col("dst").alias("to"))
        jumps = written(jumps.join(again, jumps["dst"] == again["via"]).select("src", F.col("to").alias("dst")), "jumps")
        length *= 2
    return seen.groupBy("root", "node").agg(F.min("depth").cast("int").alias("depth"))


def chain_ends(edges: DataFrame) -> DataFrame:
    """(node, end, steps) of every src of edges (src, dst) with one dst a src: the node without a dst that it leads to, and in
    how many steps; null and 0 where it runs into a cycle.

    Jumps double as in chain_closure, but a node has one row only: it jumps until a round finds its end. So what a round moves
    is in proportion to the nodes, whatever can be reached from them."""
    rest, found = edges.select(F.col("src").alias("node"), F.col("dst").alias("end"), F.lit(1).cast("long").alias("steps"), F.lit(False).alias("over")), []
    length, nodes = 1, edges.count()
    while length <= nodes:
        every = reduce(DataFrame.unionByName, found, rest)
        via = every.select(F.col("node").alias("via"), F.col("end").alias("to"), F.col("steps").alias("more"), F.col("over").alias("last"))
        jumped = rest.join(via, rest["end"] == via["via"], "left")
        step = jumped.select("node", F.coalesce("to", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("last", F.lit(True)).alias("over"))
        step = written(step, "ends")
        found, rest = [*found, step.where("over")], step.where("NOT over")
        if rest.isEmpty():
            break
        length *= 2
    endless = rest.select("node", F.when(F.lit(False), F.col("end")).alias("end"), F.lit(0).cast("long").alias("steps"), F.lit(True).alias("over"))
    return reduce(DataFrame.unionByName, found, endless).drop("over")


def reachable(edges: DataFrame, roots: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(node) that any root (node) reaches, each once, the roots included."""
    return closure(edges, roots.select(F.lit(0).alias("root"), "node"), stop).select("node").distinct()


def dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(src, dst): links from stored objects to objects that are not stored."""
    return edges.join(objects.select(F.col("node").alias("dst")), "dst", "left_anti").join(objects.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst").distinct()


def missing_reachable(edges: DataFrame, roots: DataFrame, objects: DataFrame) -> DataFrame:
    """(node) that roots reach but that is not stored."""
    return reachable(edges, roots).join(objects.select("node"), "node", "left_anti")


def transfer_set(edges: DataFrame, roots: DataFrame, present: DataFrame) -> DataFrame:
    """(node) to copy: what roots reach without passing through objects that the destination has."""
    return reachable(edges, roots, present).join(present.select("node"), "node", "left_anti")


def unreachable(edges: DataFrame, roots: DataFrame, objects: DataFrame) -> DataFrame:
    """(node) that is stored but reached from no root."""
    return objects.select("node").distinct().join(reachable(edges, roots), "node", "left_anti")


def sweep_plan(objects: DataFrame, live: DataFrame, threshold: int = 10) -> DataFrame:
    """(pack, total, live, decision) for packs of objects (pack, node, kind): delete without live objects, keep where no
    tree or commit is dead and more than 100 - threshold percent live, rewrite otherwise."""
    marked = objects.join(live.select("node").distinct().withColumn("on", F.lit(1)), "node", "left")
    counts = marked.groupBy("pack").agg(F.count(F.lit(1)).alias("total"), F.count("on").alias("live"), F.count(F.when(F.col("on").isNull() & (F.col("kind") != "blob"), 1)).alias("dead"))
    keep = (F.col("dead") == 0) & (F.col("live") / F.col("total") > (100 - threshold) / 100)
    return counts.select("pack", "total", "live", F.when(F.col("live") == 0, "delete").when(keep, "keep").otherwise("rewrite").alias("decision"))


def discarded_percent(plan: DataFrame) -> DataFrame:
    """(percent): share of all objects that the plan does away with; kept packs lose none."""
    lost = F.sum(F.when(F.col("decision") == "keep", 0).otherwise(F.col("total") - F.col("live")))
    return plan.agg(F.round(100.0 * lost / F.sum("total"), 6).alias("percent"))


def subtree_ids(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """(root, path, oid): what each path (root: tree id, path: names with '/') leads to; null where a name is not there.
    One join for each component of the longest path; entries: (tree, name, oid)."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    now = paths.select("root", "path", parts.alias("parts"), F.col("root").alias("oid"))
    for i in range(now.agg(F.max(F.size("parts"))).first()[0] or 0):
        step = entries.select(F.col("tree").alias("t"), F.col("name").alias("n"), F.col("oid").alias("o"))
        joined = now.join(step, (F.col("oid") == F.col("t")) & (F.get("parts", F.lit(i)) == F.col("n")), "left")
        now = joined.select("root", "path", "parts", F.when(F.size("parts") > i, F.col("o")).otherwise(F.col("oid")).alias("oid"))
    return now.select("root", "path", "oid")
