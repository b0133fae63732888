"""Near-duplicate groups by MinHash: bands propose, signatures decide, star contraction groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import few, group_bounds, matching, settle, sorted_groups
from stratalith.llm.components import components
from stratalith.llm.minhash import BLOCK_ROWS, MinHash, in_cells, sequences, shared_bands, signatures

#: Share of equal minima from which a pair counts as near duplicates.
THRESHOLD = 0.45


def alike_edges(sketches: np.ndarray, threshold: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph that joins rows whose estimated Jaccard similarity reaches the threshold; with `side`,
    of its edges between rows of different sides only.

    Breadth first over the implicit graph: each row taken from the queue is compared with the rows that no tree holds
    yet, so a bucket of close copies costs a few passes, and no pair that could join two trees goes uncompared."""
    need = threshold * (1 - 1 / 256) + 1 / 256  # a byte agrees by chance once in 256
    n, size = sketches.shape
    if n == 2 and side is None:
        return [(0, 1)] if np.count_nonzero(sketches[0] == sketches[1]) >= need * size else []
    edges: list[tuple[int, int]] = []
    if side is None:
        left, side = [np.arange(n)], np.zeros(n, dtype=np.int64)
    else:
        left = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    across = len(left) > 1
    while len(left[0]) and (across or len(left[0]) > 1):
        queue, left[0] = [int(left[0][0])], left[0][1:]
        while queue:
            x = queue.pop()
            other = 1 - int(side[x]) if across else 0
            hit = np.count_nonzero(sketches[left[other]] == sketches[x], axis=1) >= need * size
            if hit.any():
                found = left[other][hit]
                edges += [(x, int(y)) for y in found]
                queue += found.tolist()
                left[other] = left[other][~hit]
    return edges


def _verifier(size: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "cell"):
            side, same = table.column("side").to_numpy(), table.column("same").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, size)
            bounds = group_bounds(table.column("cell").to_numpy())
            pairs = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                pairs += [(lo + x, lo + y) for x, y in alike_edges(sketches[lo:hi], threshold, None if side[lo] == 2 else side[lo:hi])]
            if pairs:
                at = np.array(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(same[at[:, 0]]), pa.array(same[at[:, 1]])], names=["u", "v"])

    return verify


def alike(single: DataFrame, p: MinHash, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of word sequences that share a band and whose signatures agree in
    at least `threshold` of the hash functions."""
    cells = in_cells(shared_bands(single), "key", "same", block_rows).drop("key")
    rows = cells.join(single.select("same", "sketch"), "same").select("cell", "side", "same", "sketch")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_verifier(p.size, threshold), "u long, v long")


def near_duplicates(docs: DataFrame, p: MinHash = MinHash(), threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size): every document that goes, and the document of its group that stays.

    Groups are the connected components of the pairs that share a band and whose signatures agree in at least
    `threshold` of the hash functions; the least doc_id stays. Texts are compared as lower-cased words without
    punctuation. Copies of one word sequence are one node, so that they cost nothing further.

    A band value of more than block_rows sequences is compared in cells of two blocks, so that no task holds more than two
    blocks of it; its unlike members still cost the square of their number, spread over the tasks.

    Null ids and null, empty or wordless texts are never grouped. Repeated rows of one doc_id are one document. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    signed = settle(signatures(docs, p), "signatures")
    single = settle(sequences(signed), "sequences")
    roots = few(settle(components(alike(single, p, threshold, block_rows)), "roots"))
    ids = signed.select("doc_id", "same").distinct()
    placed = ids.join(roots, ids["same"] == roots["node"], "left").select("doc_id", F.coalesce("root", "same").alias("root"))
    # A doc_id that stands for several texts joins their groups.
    several = settle(placed.groupBy("doc_id").agg(F.min("root").alias("u"), F.max("root").alias("v")), "placed")
    bridges = several.where("u <> v").select("u", "v")
    grouped = several.select("doc_id", F.col("u").alias("root"))
    if not bridges.isEmpty():
        links = placed.join(several.select("doc_id", "u"), "doc_id").select("u", F.col("root").alias("v"))
        merged = components(links.where("u <> v"))
        grouped = settle(several.join(merged, several["u"] == merged["node"], "left").select("doc_id", F.coalesce("root", "u").alias("root")), "placed")
    groups = settle(grouped.groupBy("root").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    return grouped.join(few(groups), "root").where("doc_id <> keep_id").select("doc_id", "keep_id", "group_size")


def drop_near_duplicates(docs: DataFrame, p: MinHash = MinHash(), threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that near_duplicates names; all columns stay, and rows with a null id stay. Texts are not shuffled
    where the documents that go are counted to be few enough for a broadcast."""
    gone = settle(near_duplicates(docs, p, threshold).select("doc_id"), "gone")
    return matching(docs, gone, {"doc_id": docs["doc_id"]}, "left_anti")
