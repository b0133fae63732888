"""Packing documents into training windows, online and in bounded space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import settle

WINDOW = 4096
OPEN = 64
#: Open windows that were left by so many partitions are merged in one task.
MERGED_PARTITIONS = 64

_PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
_SCHEMA = pa.schema([("window_id", pa.int64()), ("used", pa.int64()), ("open", pa.bool_()), ("pieces", _PIECES)])
_DDL = "window_id long, used long, open boolean, pieces array<struct<doc_id:long,start:long,length:long>>"

Piece = tuple[int, int, int]


def pack(items: Iterator[tuple[int, list[Piece]]], window: int, most_open: int) -> Iterator[tuple[int, bool, list[Piece]]]:
    """(used, left over, pieces) of the windows that items (length, pieces) of at most `window` tokens fill.

    An item goes into the open window that it leaves the least room in (best fit; of equals the oldest). Where it fits
    none and most_open are open, the fullest is emitted and a new one opened. Full windows leave at once."""
    opened: list[list] = []  # [used, pieces]
    for length, pieces in items:
        best = max((w for w in opened if w[0] + length <= window), key=lambda w: w[0], default=None)
        if best is None:
            if len(opened) == most_open:
                fullest = max(opened, key=lambda w: w[0])
                opened.remove(fullest)
                yield fullest[0], False, fullest[1]
            best = [0, []]
            opened.append(best)
        best[0] += length
        best[1].extend(pieces)
        if best[0] == window:
            opened.remove(best)
            yield best[0], False, best[1]
    for used, pieces in opened:
        yield used, True, pieces


def _emit(windows: Iterator[tuple[int, bool, list[Piece]]], level: int) -> Iterator[pa.RecordBatch]:
    base, held, number = level << 62 | TaskContext.get().partitionId() << 36, [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    for used, left, pieces in windows:
        held.append({"window_id": base | number, "used": used, "open": left, "pieces": [{"doc_id": d, "start": s, "length": n} for d, s, n in pieces]})
        number += 1
        if len(held) == 2000:
            yield batch()
            held = []
    yield batch()


def _first(window: int, most_open: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple[int, list[Piece]]]:
            for batch in batches:
                for doc_id, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for start in range(0, tokens, window):
                        length = min(window, tokens - start)
                        yield length, [(doc_id, start, length)]

        yield from _emit(pack(items(), window, most_open), 0)

    return run


def _merge(window: int, most_open: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple[int, list[Piece]]]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["used"], [(p["doc_id"], p["start"], p["length"]) for p in row["pieces"]]

        yield from _emit(pack(items(), window, most_open), 1)

    return run


def word_count() -> Column:
    return F.regexp_count("text", F.lit(r"\S+")).cast("long")


def pack_lengths(lengths: DataFrame, window: int = WINDOW, most_open: int = OPEN, merged: int = MERGED_PARTITIONS) -> DataFrame:
    """As pack_documents, of rows (doc_id, tokens); those with a null, or without tokens, have no piece."""
    lengths = lengths.where("doc_id IS NOT NULL AND tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens"))
    windows = settle(lengths.mapInArrow(_first(window, most_open), _DDL), "windows")
    left = windows.where("open").withColumn("task", F.shiftright("window_id", 36) / merged)
    # Deterministic: the rows of a task are sorted by how full they are, then by window.
    again = left.withColumn("task", F.floor("task")).repartition("task").sortWithinPartitions(F.desc("used"), "window_id").drop("task")
    packed = windows.where("NOT open").unionByName(again.mapInArrow(_merge(window, most_open), _DDL))
    return packed.select("window_id", "used", F.size("pieces").alias("n_pieces"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.start").alias("starts"), F.col("pieces.length").alias("lengths"))


def pack_documents(docs: DataFrame, tokens: Column | None = None, window: int = WINDOW, most_open: int = OPEN, merged: int = MERGED_PARTITIONS) -> DataFrame:
    """(window_id, used, n_pieces, doc_ids, starts, lengths): windows of at most `window` tokens that hold every token of docs once.

    Each partition of the input packs online with most_open open windows. What is left open at its end is packed again,
    fullest first, `merged` partitions' leftovers a task. A document longer than a window is cut at every `window` tokens;
    starts are token offsets within the documents. tokens defaults to the number of words (runs of non-white space).

    Null, empty and wordless texts, and rows with a null doc_id, have no piece. Repeated rows are packed as often as they
    occur; ties fall to the older window. An empty table gives no rows. Other columns are ignored. window_id is unique;
    which documents share a window depends on how the input is partitioned, and is the same whenever that is.
    """
    lengths = docs.where("text IS NOT NULL").select("doc_id", (word_count() if tokens is None else tokens).alias("tokens"))
    return pack_lengths(lengths, window, most_open, merged)
