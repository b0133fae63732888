"""Which ids are stored where: semi and anti joins, merged indexes, prefix tables, and a Bloom filter of a fixed layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.hashing import common_bits, leading_bits

MOST_BITS = {4: 37, 5: 29}
MOST_RATE = 1.0
ID_BYTES = 20
_PER_PREFIX = 4096 / ID_BYTES


def exists(probe: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of probe whose oid is in index."""
    return probe.join(index.select("oid"), "oid", "left_semi")


def locate(probe: DataFrame, index: DataFrame) -> DataFrame:
    """probe with `pack` and `ofs` of one stored copy: the first pack by name, and its first offset. Absent ids have no row."""
    one = index.groupBy("oid").agg(F.min(F.struct("pack", "ofs")).alias("at"))
    return probe.join(one, "oid").select(*probe.columns, "at.pack", "at.ofs")


def missing(probe: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct rows of probe whose oid is not in index."""
    return probe.join(index.select("oid"), "oid", "left_anti").distinct()


def store_new(incoming: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Rows of incoming to write: the first of each oid by `order`, where it is not stored."""
    first = incoming.withColumn("__n", F.row_number().over(Window.partitionBy("oid").orderBy(order))).where("__n = 1").drop("__n")
    return first.join(stored.select("oid"), "oid", "left_anti")


def sync_sets(local: DataFrame, remote: DataFrame, name: str = "name") -> DataFrame:
    """(name, action): 'fetch' for what only the remote side has, 'drop' for what only the local one has."""
    l, r = local.select(name).distinct(), remote.select(name).distinct()  # noqa: E741
    return r.join(l, name, "left_anti").withColumn("action", F.lit("fetch")).unionByName(l.join(r, name, "left_anti").withColumn("action", F.lit("drop")))


def fanout(index: DataFrame, bits: int = 8, distinct: bool = False) -> DataFrame:
    """(prefix, n): how many ids have a prefix of `bits` bits up to each; every prefix has a row.

    The counts are grouped before the running sum, which so covers 2**bits rows whatever the input."""
    ids = index.select("oid").distinct() if distinct else index.select("oid")
    counts = ids.groupBy(leading_bits(F.col("oid"), bits).alias("prefix")).agg(F.count(F.lit(1)).alias("c"))
    every = index.sparkSession.range(1 << bits).withColumnRenamed("id", "prefix")
    full = every.join(counts, "prefix", "left").fillna(0, ["c"])
    return full.select("prefix", F.sum("c").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("n"))


def prefix_bits(ids: int) -> int:
    """Bits of a merged index's prefix table, for a page of ids a prefix."""
    return max(0, math.ceil(math.log2(max(1, int(ids / _PER_PREFIX)))))


def prefix_table(index: DataFrame) -> DataFrame:
    """fanout with as many bits as the number of rows asks for."""
    return fanout(index, prefix_bits(index.count()))


def merge_distinct(*indexes: DataFrame) -> DataFrame:
    """(oid) in any of the indexes, once."""
    out = indexes[0].select("oid")
    for x in indexes[1:]:
        out = out.unionByName(x.select("oid"))
    return out.distinct()


def merge_sources(index: DataFrame) -> DataFrame:
    """(oid, pack, which): all entries, copies included, with the number of each one's pack in name order."""
    packs = index.select("pack").distinct()
    which = packs.select("pack", (F.row_number().over(Window.orderBy("pack")) - 1).alias("which"))
    return index.select("oid", "pack").join(which, "pack").select("oid", "pack", "which")


def check_merged(merged: DataFrame, index: DataFrame) -> DataFrame:
    """(problem, oid): ids of index that merged lacks, and ids of merged that no index has."""
    lost = index.select("oid").distinct().join(merged.select("oid"), "oid", "left_anti").select(F.lit("lost").alias("problem"), "oid")
    extra = merged.select("oid").distinct().join(index.select("oid"), "oid", "left_anti").select(F.lit("unknown").alias("problem"), "oid")
    return lost.unionByName(extra)


def find_prefix(index: DataFrame, prefixes: DataFrame, digits: int) -> DataFrame:
    """(prefix, oid) of the ids that begin with one of the prefixes, all of them `digits` hex digits long: an equi-join."""
    return index.select("oid").distinct().withColumn("prefix", F.substring("oid", 1, digits)).join(prefixes.select("prefix").distinct(), "prefix").select("prefix", "oid")


def _ranges(ids: DataFrame, bits: int) -> DataFrame:
    return ids.select("oid").distinct().withColumn("cell", leading_bits(F.col("oid"), bits))


def margin(ids: DataFrame, bits: int = 12) -> DataFrame:
    """(bits): most leading bits that two neighbours of the ordered distinct ids share, the first being compared with zeros.

    Ids are hashes, so 2**bits prefix cells hold about as many each: neighbours are found within cells, and across them
    from the least and greatest id of each cell. No sort is global."""
    cells = _ranges(ids, bits)
    inside = cells.withColumn("prev", F.lag("oid").over(Window.partitionBy("cell").orderBy("oid"))).where("prev IS NOT NULL")
    edges = cells.groupBy("cell").agg(F.min("oid").alias("oid"), F.max("oid").alias("last"))
    across = edges.withColumn("prev", F.coalesce(F.lag("last").over(Window.orderBy("cell")), F.lit("0" * 40)))
    both = inside.select("oid", "prev").unionByName(across.select("oid", "prev"))
    return both.agg(F.max(common_bits(F.col("oid"), F.col("prev"))).cast("int").alias("bits"))


def margin_predict(ids: DataFrame, bits: int = 12) -> DataFrame:
    """(error): the greatest distance between an id's rank and the one that its first 64 bits predict."""
    cells = _ranges(ids, bits)
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("cell", (F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy(F.lit(1))).alias("total"))
    ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("oid")) - 1).join(before, "cell")
    place = F.conv(F.substring("oid", 1, 16), 16, 10).cast("decimal(20,0)")
    guess = F.expr("(place * cast(total AS decimal(17,0))) div cast('18446744073709551616' AS decimal(20,0))")
    return ranked.withColumn("place", place).agg(F.max(F.abs(F.col("before") + F.col("r") - guess)).cast("long").alias("error"))


def bloom_shape(expected: int, k: int | None = None) -> tuple[int, int]:
    """(bits, k): 2**bits bytes for `expected` ids."""
    bits = int(math.log2(max(1, expected * 32 // 8)))
    k = k or (5 if bits <= MOST_BITS[5] else 4)
    return min(bits, MOST_BITS[k]), k


def bloom_places(ids: DataFrame, bits: int, k: int, oid: str = "oid") -> DataFrame:
    """ids with (byte, bit) of each of the k slices of each id: the byte's address is the first bits of the slice, the bit's
    number the three bits below."""
    digits, width = (8, 32) if k == 5 else (10, 40)
    slices = F.array(*(F.struct(F.shiftright(v, width - bits).alias("byte"), F.shiftright(v, width - 3 - bits).bitwiseAND(F.lit(7)).cast("int").alias("bit")) for v in (F.conv(F.substring(oid, digits * j + 1, digits), 16, 10).cast("long") for j in range(k))))
    return ids.withColumn("__place", F.explode(slices)).select(*ids.columns, "__place.byte", "__place.bit")


def bloom_bits(ids: DataFrame, bits: int, k: int) -> DataFrame:
    """(byte, bit) of every bit that is set."""
    return bloom_places(ids.select("oid"), bits, k).select("byte", "bit").distinct()


def bloom_probe(probe: DataFrame, filter_bits: DataFrame, bits: int, k: int) -> DataFrame:
    """(oid, maybe) for the distinct ids of probe: whether all of an id's bits are set."""
    places = bloom_places(probe.select("oid").distinct(), bits, k)
    marked = places.join(filter_bits.withColumn("on", F.lit(True)), ["byte", "bit"], "left")
    return marked.groupBy("oid").agg(F.min(F.coalesce("on", F.lit(False))).alias("maybe"))


def bloom_decision(entries: Column, covered: Column, added: Column, bits: Column, k: int, wanted_k: int | None = None) -> Column:
    """What upkeep does to a filter of `entries` ids whose indexes hold `covered`, when `added` more come: nothing, add, or regenerate."""
    from stratalith.functions.scalars import bloom_rate

    again = (entries != covered) | ((bits < MOST_BITS[k]) & (bloom_rate(entries + added, k, bits) > MOST_RATE)) | F.lit(wanted_k is not None and wanted_k != k)
    return F.when(added == 0, "nothing").when(again, "regenerate").otherwise("add")


def merge_plan(sizes: list[tuple[str, int]], high: int = 5, low: int = 2) -> list[list[str]]:
    """Groups of indexes (name, entries) to merge, in turn: while there are more than `high`, all but the largest low - 1 become one."""
    now, groups = [(n, name) for name, n in sizes], []
    while len(now) > high:
        now.sort()
        cut = len(now) - low + 1
        small, rest = now[:cut], now[cut:]
        groups.append([name for _, name in small])
        now = [(sum(n for n, _ in small), "+".join(name for _, name in small)), *rest]
    return groups


def redundant(covers: list[tuple[str, int, int, list[str]]]) -> list[str]:
    """Merged indexes (name, entries, mtime, members) whose members larger or newer ones cover."""
    seen: set[str] = set()
    out = []
    for name, _, _, members in sorted(covers, key=lambda c: (-c[1], -c[2])):
        if seen.issuperset(members):
            out.append(name)
        seen.update(members)
    return out


def bloom_absent(ids: DataFrame, filter_bits: DataFrame, bits: int, k: int) -> DataFrame:
    """(oid) of ids that the filter denies: none, if it was made of them."""
    return bloom_probe(ids, filter_bits, bits, k).where("NOT maybe").select("oid")


def suggest_packs(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """(pack) whose index would have told the sender that an object need not be sent, each once."""
    return index.join(incoming.select("oid").distinct(), "oid", "left_semi").select("pack").distinct()


def stray_files(files: DataFrame, name: str = "name") -> DataFrame:
    """Rows of files 'pack-<id>.<kind>' whose '.pack' is not among them."""
    keyed = files.withColumn("__id", F.regexp_extract(name, r"^pack-([0-9a-f]{40})\.(.+)$", 1)).where("__id <> ''")
    whole = keyed.where(F.endswith(F.col(name), F.lit(".pack"))).select("__id").distinct()
    return keyed.join(whole, "__id", "left_anti").drop("__id")


def sorted_buckets(ids: DataFrame, buckets: int = 256) -> DataFrame:
    """ids in range partitions by oid, sorted within each: together they are in order, and no sort is global."""
    return ids.repartitionByRange(buckets, "oid").sortWithinPartitions("oid")


def find_in_batches(ids: DataFrame, size: int) -> DataFrame:
    """ids with `batch`: groups of about `size` by prefix, for requests that go out together."""
    bits = max(0, math.ceil(math.log2(max(1, ids.count() / size))))
    return ids.withColumn("batch", leading_bits(F.col("oid"), bits) if bits else F.lit(0).cast("long"))
