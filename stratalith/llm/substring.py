"""Passages that documents share, by level-wise doubling of window lengths.

A window of L words is compared with others through its *class*: the least hash among the windows of half its length
inside it. Equal windows have equal classes, and neighbouring windows mostly share one, so a run of windows travels as
one row: the class, the document, the first position and eight bytes a window, its whole hash. At the next level only positions whose
windows were repeated are left, and a window of 2L words is a candidate where every window of L words inside it survived;
its hash is made of the names of its two halves (Karp, Miller and Rosenberg), so texts are read once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm import textkernel as K
from stratalith.llm.common import drop_settled, few, free_name, group_bounds, has_text, settle, sorted_groups

MIN_WORDS = 50
#: Runs of one class that a task holds at once.
PART_ROWS = 100_000
_RUN = "class long, doc_id long, start int, hashes binary"
_NAMED = "doc_id long, start int, names binary, later boolean"


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _runs(cls: np.ndarray, run: np.ndarray, doc_ids: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """Rows of neighbouring windows with one class; run numbers the stretches in which positions follow each other."""
    bounds = np.r_[0, np.flatnonzero((cls[1:] != cls[:-1]) | (run[1:] != run[:-1])) + 1, len(cls)]
    first = bounds[:-1]
    return pa.RecordBatch.from_arrays(
        [pa.array(cls[first].view(np.int64)), pa.array(doc_ids[first]), pa.array(at[first].astype(np.int32)), _binary(hashes, bounds)],
        names=["class", "doc_id", "start", "hashes"],
    )


def _first_level(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch, "text"):
                words = K.split(block.column("text"), letters_only=False)
                hashes, inside = words.window_hashes(length)
                if not inside.any():
                    continue
                halves, _ = words.window_hashes(half)
                cls = K.sliding_min(halves, length - half + 1)
                doc = words.doc_of_word()[: len(hashes)]
                at = np.arange(len(hashes)) - words.bounds[doc]
                ids = block.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
                yield _runs(cls[inside], doc[inside], ids[doc[inside]], at[inside], hashes[inside])

    return run


def _windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, document, position) of every window of runs."""
    raw = table.column("hashes").combine_chunks()
    flat = np.frombuffer(b"".join(raw.to_pylist()), dtype=K.U64)
    sizes = np.asarray(pc.binary_length(raw)).astype(np.int64) // 8
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = table.column("start").to_numpy()[row] + np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[row]
    names = K.mix(table.column("class").to_numpy().view(K.U64)[row] + flat * K.U64(0xD1342543DE82EF95))
    return names, table.column("doc_id").to_numpy()[row], at


def _named(names: np.ndarray, doc: np.ndarray, at: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    cut = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (later[1:] != later[:-1])
    stretch = np.r_[0, np.flatnonzero(cut) + 1, len(doc)]
    first = stretch[:-1]
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first].astype(np.int32)), _binary(names, stretch), pa.array(later[first])], names=["doc_id", "start", "names", "later"])


class _Repeats:
    """Windows met so far that only one document has had, and two documents (or the one) of every name met."""

    def __init__(self) -> None:
        self.pending = self.known = (np.zeros(0, dtype=K.U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def add(self, names: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows, of these and of those met before, that are found to be repeated now, and whether a document with a lesser
        id has the window too (documents come in order of their ids)."""
        own, kept = len(names), len(self.pending[0])
        names, doc, at = (np.concatenate(x) for x in zip((names, doc, at), self.pending, self.known, strict=True))
        order = np.argsort(names, kind="stable")
        groups = group_bounds(names[order])
        least, most = np.minimum.reduceat(doc[order], groups[:-1]), np.maximum.reduceat(doc[order], groups[:-1])
        twice, later = np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=bool)
        twice[order] = np.repeat(least != most, np.diff(groups))
        later[order] = doc[order] > np.repeat(least, np.diff(groups))
        window = np.arange(len(names)) < own + kept
        found, rest = twice & window, ~twice & window
        self.pending = names[rest], doc[rest], at[rest]
        first = names[order][groups[:-1]]
        several = least != most
        self.known = np.r_[first, first[several]], np.r_[least, most[several]], np.zeros(len(first) + int(several.sum()), dtype=np.int64)
        return names[found], doc[found], at[found], later[found]


def _repeated(part_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of runs sorted by class and document, the windows that occur in two documents at least, with a 64-bit name for each. A class of
    more than part_rows runs is taken in parts, with only its distinct windows in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, repeats = None, _Repeats()
        for table in sorted_groups(batches, "class", part_rows):
            cls, doc = table.column("class").to_numpy(), table.column("doc_id").to_numpy()
            bounds = group_bounds(cls)
            if cls[0] != carried:
                carried, repeats = None, _Repeats()
            several = np.minimum.reduceat(doc, bounds[:-1]) != np.maximum.reduceat(doc, bounds[:-1])
            large = carried is not None or len(table) >= part_rows
            if large and len(bounds) == 2:
                carried = cls[0]
                found = repeats.add(*_windows(table))
            else:
                rows = np.flatnonzero(np.repeat(several, np.diff(bounds)))
                found = _Repeats().add(*_windows(table.take(pa.array(rows)))) if len(rows) else ()
            if len(found) and len(found[0]):
                yield _named(*found)

    return run


def _positions(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, name, stretch) of each surviving window of whole documents, in order; positions in one
    stretch follow each other. Rows of repeated documents may overlap: one window of each position stays."""
    raw = table.column("names").combine_chunks()
    sizes = np.asarray(pc.binary_length(raw)).astype(np.int64) // 8
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = table.column("start").to_numpy()[row] + np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    doc = table.column("doc_id").to_numpy()[row]
    names = np.frombuffer(b"".join(raw.to_pylist()), dtype=K.U64)
    order = np.lexsort((at, doc))
    doc, at, names = doc[order], at[order], names[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]
    doc, at, names = doc[first], at[first], names[first]
    stretch = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) - 1
    return doc, at, names, stretch


def _doubled(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs of windows of twice `length` from surviving windows of `length`, sorted by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "doc_id"):
            doc, at, names, stretch = _positions(table)
            if len(names) <= length:
                continue
            whole = stretch[length:] == stretch[:-length]
            if not whole.any():
                continue
            hashes = K.mix(names[:-length] * K.U64(0x9E6C63D0876A9A63) + names[length:])
            cls = K.sliding_min(names, length + 1)
            n = len(hashes)
            yield _runs(cls[whole], stretch[:n][whole], doc[:n][whole], at[:n][whole], hashes[whole])

    return run


def _spans(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "doc_id"):
            doc, at, _, _ = _positions(table)
            # Windows that overlap or touch are one passage.
            bounds = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)) + 1, len(doc)]
            first, last = bounds[:-1], bounds[1:] - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(at[first].astype(np.int32)), pa.array((at[last] + length).astype(np.int32))], names=["doc_id", "start_word", "end_word"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, start_word, end_word, longest): the stretches of each document that other documents repeat.

    A stretch is a maximal union of overlapping or touching windows of min_words words each of which occurs in another document too;
    words are runs of anything but ASCII white space, compared as they are, and counted from 0 (end_word exclusive).
    longest is the greatest min_words * 2**k such that a window of so many words, inside the stretch, is repeated as a
    whole. Every occurrence is reported, the first as well; repetition inside one document alone is not.

    Null ids and null, empty or shorter texts have no stretch. Repeated rows of one doc_id are one document, and where
    they have several texts, their stretches are united. An empty table gives no rows. Other columns are ignored.
    Windows are equal when their classes and their names, 64 bits of class and hash, are; a class, which all windows
    around a frequent passage share, tells nothing apart, so unlike windows of one class are taken for equal with
    probability 2**-64 a pair. The words are not compared again. However often a passage occurs, a task holds part_rows of its runs.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    spark = docs.sparkSession
    runs = has_text(docs).mapInArrow(_first_level(min_words), _RUN)
    length, found, spans = min_words, [], None
    while True:
        kept = settle(runs.repartition("class").sortWithinPartitions("class", "doc_id").mapInArrow(_repeated(part_rows), _NAMED), "windows")
        by_doc = kept.repartition("doc_id").sortWithinPartitions("doc_id")
        level = settle(by_doc.mapInArrow(_spans(length), "doc_id long, start_word int, end_word int"), "spans")
        if spans is None:
            spans = level
        if level.isEmpty():
            drop_settled(spark, kept)
            break
        found.append(level.withColumn("longest", F.lit(length)))
        runs = settle(by_doc.mapInArrow(_doubled(length), _RUN), "runs")
        drop_settled(spark, kept)
        if runs.isEmpty():
            break
        length *= 2
    if len(found) < 2:
        return spans.withColumn("longest", F.lit(min_words))
    longer = found[1]
    for level in found[2:]:
        longer = longer.unionByName(level)
    longer = longer.select(F.col("doc_id").alias("d"), F.col("start_word").alias("s"), F.col("end_word").alias("e"), "longest")
    joined = spans.join(longer, (F.col("doc_id") == F.col("d")) & (F.col("s") >= F.col("start_word")) & (F.col("e") <= F.col("end_word")), "left")
    return joined.groupBy("doc_id", "start_word", "end_word").agg(F.coalesce(F.max("longest"), F.lit(min_words)).alias("longest"))


def later_passages(docs: DataFrame, min_words: int = MIN_WORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, start_word, end_word): the stretches of repeated_passages without first occurrences: maximal unions of windows of
    min_words words each of which a document with a lesser id has too. See repeated_passages for the rest."""
    runs = has_text(docs).mapInArrow(_first_level(min_words), _RUN).repartition("class").sortWithinPartitions("class", "doc_id")
    kept = runs.mapInArrow(_repeated(part_rows), _NAMED).where("later").drop("later")
    return kept.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_spans(min_words), "doc_id long, start_word int, end_word int")


_WORD = re.compile(rb"[^\t\n\x0b\x0c\r ]+")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of spans (start, end), and without the white space behind each of them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at : words[a][0]])
        at = words[b][0] if b < len(words) else len(text)
    return b"".join(out) + text[at:]


def _cutter(text: int, spans: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else cut_words(t.encode(), [(x["start_word"], x["end_word"]) for x in s]).decode() for t, s in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == text else batch.column(i) for i in range(batch.num_columns) if i != spans], names=[n for i, n in enumerate(batch.schema.names) if i != spans])

    return run


def drop_repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, part_rows: int = PART_ROWS) -> DataFrame:
    """docs with every repeated passage cut from all documents but the one with the least id: the words of later_passages go,
    with the white space behind each stretch. All columns and rows stay, documents left without words too.

    Null ids and texts stay as they are, and so do the rows of a doc_id that has several texts; their passages still count as
    occurrences for others. Only rows that are cut travel beyond their task where the stretches are counted to be few."""
    spans = later_passages(docs, min_words, part_rows)
    several = has_text(docs).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a <> b").select("doc_id")
    spans = settle(spans.join(few(settle(several, "several")), "doc_id", "left_anti"), "later")
    doc, cuts = free_name(docs, "__sl_doc"), free_name(docs, "__sl_cuts")
    grouped = settle(spans.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(cuts)), "cuts")  # a document's own
    joined = docs.join(few(grouped), docs["doc_id"] == F.col(doc), "left").drop(doc)
    return joined.mapInArrow(_cutter(docs.columns.index("text"), len(docs.columns)), docs.schema)
