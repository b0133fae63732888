"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import drop_settled, settle


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of every u; aggregated before it is shuffled, so that a hot node costs no task more than others."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges has u > v."""
    least = _least(edges)
    linked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns (node, root) for every node of an edge of `edges` (u, v: BIGINT): root is the least node of its component.

    Each round joins the edge list with the least neighbours of its nodes, twice; the list only shrinks, and O(log^2 n)
    rounds suffice. The edges of a hot node are never brought together: its least neighbour is aggregated map-side, and the
    join may split them. Every round is written to the shared folder. Self loops and repeated edges are allowed; edges with
    a null end are ignored; no edges give no rows. A node whose edges are all self loops is its own root.
    """
    spark = edges.sparkSession
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL")
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = now.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("root"))
    first, seen = now, now.where("u <> v").agg(*mark).first()
    while seen["n"]:
        new = settle(_small_star(_large_star(now.where("u <> v"))), "edges")
        found = new.agg(*mark).first()
        if now is not first:
            drop_settled(spark, now)
        now = new
        if found == seen:
            break
        seen = found
    stars = now.where("u <> v") if now is first else now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct()).union(
        loops.join(stars.select(F.explode(F.array("u", "v")).alias("node")), "node", "left_anti")
    )
