"""What fault tests and examples need: damaged bytes, missing objects, names that split, paths at random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def damage(content: Column, at: Column, byte: Column) -> Column:
    """Binary content with the byte at offset `at` (modulo its length) replaced by `byte` (0 to 255); empty and null ones stay."""
    place = F.pmod(at, F.greatest(F.octet_length(content), F.lit(1))).cast("int") + 1
    return F.when(F.octet_length(content) == 0, content).otherwise(F.overlay(content, F.unhex(F.lpad(F.hex(byte), 2, F.lit("0"))), place, F.lit(1)))


def perforate(objects: DataFrame, gone: DataFrame, oid: str = "oid") -> DataFrame:
    """objects without those whose ids are in gone."""
    return objects.join(gone.select(oid).distinct(), oid, "left_anti")


def splittable_names(spark: SparkSession, n: int = 10_000, width: int = 4) -> DataFrame:
    """(name): n names in order, of which a directory is large enough to be split."""
    return spark.range(n).select(F.lpad(F.hex("id"), F.greatest(F.length(F.hex("id")), F.lit(width)), F.lit("0")).alias("name"))


def random_paths(spark: SparkSession, n: int, seed: int = 0, depth: int = 4) -> DataFrame:
    """(id, path): n absolute paths of 1 to depth components that depend on seed alone."""
    part = lambda k: F.lower(F.hex(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 16))))
    many = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(depth)) + 1
    return spark.range(n).select("id", F.concat(F.lit("/"), F.array_join(F.slice(F.array(*(part(k) for k in range(depth))), F.lit(1), many.cast("int")), "/")).alias("path"))
