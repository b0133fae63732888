"""Content identities as SQL expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTORY, FILE, EXECUTABLE, SYMLINK = 0o040000, 0o100644, 0o100755, 0o120000
EMPTY_BLOB = "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
_NUL = "00"


def object_id(content: Column, kind: str = "blob") -> Column:
    """Hex SHA-1 of kind, length and content; null content has no id."""
    head = F.encode(F.concat(F.lit(f"{kind} "), F.octet_length(content).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit(_NUL)), content))


def text_id(text: Column) -> Column:
    """object_id of a string's UTF-8 bytes."""
    return object_id(F.encode(text, "UTF-8"))


def entry_key(name: Column, mode: Column) -> Column:
    """What entries of a directory are ordered by: directories as if their names ended in a slash."""
    return F.when(mode.bitwiseAND(F.lit(0o170000)) == DIRECTORY, F.concat(name, F.lit("/"))).otherwise(name)


def entry_hex(mode: Column, name: Column, oid: Column) -> Column:
    """One directory entry in hex: octal mode, blank, name, NUL, twenty bytes of id."""
    return F.concat(F.hex(F.encode(F.concat(F.conv(mode.cast("string"), 10, 8), F.lit(" "), name), "UTF-8")), F.lit(_NUL), F.upper(oid))


def tree_ids(entries: DataFrame, by: list[str], content: bool = False) -> DataFrame:
    """(*by, oid, entries) of each directory of entries (*by, mode, name, oid): the id of its encoded, ordered entries. With
    `content` these follow as a column of that name."""
    one = F.struct(F.encode(entry_key(F.col("name"), F.col("mode")), "UTF-8").alias("k"), entry_hex(F.col("mode"), F.col("name"), F.col("oid")).alias("h"))
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["h"]), ""))
    return entries.groupBy(*by).agg(object_id(whole, "tree").alias("oid"), F.count(F.lit(1)).alias("entries"), *([whole.alias("content")] if content else []))


def leading_bits(oid: Column, n: int) -> Column:
    """The first n <= 32 bits of a hex id."""
    return F.shiftright(F.conv(F.substring(oid, 1, 8), 16, 10).cast("long"), 32 - n)


def common_bits(a: Column, b: Column) -> Column:
    """Leading bits that two hex ids of 40 digits share; 160 if they are equal."""
    differs = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    at = F.array_position(differs, True).cast("int")
    digit = lambda x: F.conv(F.substr(x, at, F.lit(1)), 16, 10).cast("int")
    apart = digit(a).bitwiseXOR(digit(b))
    zeros = F.when(apart >= 8, 0).when(apart >= 4, 1).when(apart >= 2, 2).otherwise(3)
    return F.when(at == 0, 160).otherwise(4 * (at - 1) + zeros)
