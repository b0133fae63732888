"""Merged indexes and Bloom filters as stored tables: what they are made of is stored with them, and tells whether they still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.operators import membership

_FILTER = "bits int, k int, entries long, packs long"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


# -- merged indexes


def write_merged(index: DataFrame, folder: str) -> None:
    """Stores index (oid, pack) as one table of (oid, pack, which) in ranges of ids, sorted, so that a lookup reads few row groups."""
    membership.merge_sources(index).repartitionByRange("oid").sortWithinPartitions("oid").write.mode("overwrite").parquet(f"{folder}/entries")
    index.select("pack").distinct().coalesce(1).write.mode("overwrite").parquet(f"{folder}/packs")


def read_merged(spark: SparkSession, folder: str, present: DataFrame | None = None, ignore_missing: bool = False) -> DataFrame | None:
    """(oid, pack, which) of a merged index. If it names a pack that is not among `present` (pack), it no longer holds: None with
    ignore_missing, otherwise an error."""
    if present is not None:
        gone = spark.read.parquet(f"{folder}/packs").join(present.select("pack"), "pack", "left_anti").limit(3).collect()
        if gone and ignore_missing:
            return None
        if gone:
            raise ValueError("the merged index names packs that are gone: " + ", ".join(r["pack"] for r in gone))
    return spark.read.parquet(f"{folder}/entries")


# -- Bloom filters


def write_filter(index: DataFrame, folder: str, k: int | None = None) -> None:
    """Stores a filter of index's ids (oid, pack): its bits, and how many ids and packs it covers."""
    spark, ids = index.sparkSession, index.select("oid").distinct()
    entries = ids.count()
    bits, k = membership.bloom_shape(entries, k)
    membership.bloom_bits(ids, bits, k).write.mode("overwrite").parquet(f"{folder}/bits")
    index.select("pack").distinct().coalesce(1).write.mode("overwrite").parquet(f"{folder}/packs")
    packs = spark.read.parquet(f"{folder}/packs").count()
    spark.createDataFrame([(bits, k, entries, packs)], _FILTER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shape")


def filter_shape(spark: SparkSession, folder: str) -> dict | None:
    """bits, k, entries and packs of a stored filter; None where there is none."""
    return spark.read.parquet(f"{folder}/shape").first().asDict() if _exists(spark, f"{folder}/shape") else None


def keep_filter(index: DataFrame, folder: str) -> str:
    """Brings a stored filter up to date with index (oid, pack), and returns what that took: nothing, add (ids of new packs are
    added to it) or regenerate."""
    spark, shape = index.sparkSession, filter_shape(index.sparkSession, folder)
    if shape is None:
        write_filter(index, folder)
        return "regenerate"
    covered = spark.read.parquet(f"{folder}/packs")
    fresh = index.join(covered, "pack", "left_anti")
    gone = covered.join(index.select("pack"), "pack", "left_anti")
    old = index.join(covered, "pack", "left_semi").select("oid").distinct()
    added = fresh.select("oid").distinct().join(old, "oid", "left_anti")
    number = added.count()
    row = spark.range(1).select(membership.bloom_decision(F.lit(shape["entries"]), F.lit(old.count() if gone.isEmpty() else -1), F.lit(number), F.lit(shape["bits"]), shape["k"]).alias("d"))
    decision = row.first()["d"] if number or not gone.isEmpty() or not fresh.isEmpty() else "nothing"
    if not gone.isEmpty() or decision == "regenerate":
        write_filter(index, folder, shape["k"])
        return "regenerate"
    if not fresh.isEmpty():
        membership.bloom_bits(added, shape["bits"], shape["k"]).write.mode("append").parquet(f"{folder}/bits")
        fresh.select("pack").distinct().coalesce(1).write.mode("append").parquet(f"{folder}/packs")
        packs = spark.read.parquet(f"{folder}/packs").count()
        spark.createDataFrame([(shape["bits"], shape["k"], shape["entries"] + number, packs)], _FILTER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shape")
        return "add"
    return "nothing"


def probe_filter(probe: DataFrame, folder: str) -> DataFrame:
    """(oid, maybe) for the distinct ids of probe."""
    shape = filter_shape(probe.sparkSession, folder)
    return membership.bloom_probe(probe, probe.sparkSession.read.parquet(f"{folder}/bits").distinct(), shape["bits"], shape["k"])


def worth_asking(spark: SparkSession, folder: str, packs: int) -> bool:
    """Whether a stored filter covers as many packs as there are; one that lags behind answers for too few."""
    shape = filter_shape(spark, folder)
    return shape is not None and shape["packs"] >= packs


def clear_filter(spark: SparkSession, folder: str) -> None:
    for part in ("bits", "packs", "shape"):
        _delete(spark, f"{folder}/{part}")


def ruin_filter(spark: SparkSession, folder: str) -> None:
    """For fault tests: a filter without a bit, which denies everything."""
    spark.createDataFrame([], "byte long, bit int").write.mode("overwrite").parquet(f"{folder}/bits")
