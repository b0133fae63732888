"""Document fingerprints: MinHash bands joined in Spark, every pair of a candidate group verified by exact Jaccard similarity.

Documents with one word sequence are a class; links join different classes. The result has a row a document, with its class
and the number of its links, so it grows with the documents and not with the pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm import textkernel as K
from stratalith.llm.common import few, group_bounds, has_text, settle, sorted_groups
from stratalith.llm.components import components
from stratalith.llm.minhash import MinHash, in_cells, sequences, shingles, signatures
from stratalith.llm.neardup import alike

THRESHOLD = 0.5
#: Classes of a block; two blocks meet in one task, which so holds at most twice as many shingle sets.
BLOCK_DOCS = 1024
#: A pair is a candidate if its signatures agree in so many standard deviations less than the threshold (one pair in 30,000 at
#: the threshold itself has less).
DEVIATIONS = 4


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (text, same, root, n), those whose text is the word sequence `same`, with its sorted distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch, "text"):
                words = K.split(block.column("text"), letters_only=True)
                hashes, doc, _ = shingles(words, k)
                if not len(hashes):
                    continue
                order = np.lexsort((hashes, doc))
                hashes, doc = hashes[order], doc[order]
                first = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
                hashes, doc = hashes[first], doc[first]
                bounds = group_bounds(doc)
                which = doc[bounds[:-1]]
                rows = block.take(pa.array(which))
                sets = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(hashes)])
                own = words.sequences(which).view(np.int64) == rows.column("same").to_numpy()
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("same", "root", "n")), sets], names=["same", "root", "n", "shingles"]).filter(pa.array(own))

    return run


def similarities(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of each of sets[left] (rows) with each other of sets[right] (columns), all sorted and not empty.

    Intersections are products of 0/1 matrices over the elements that more than one set holds, a slab of columns at a time."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        common = np.array([[sizes[0], shared], [shared, sizes[1]]], dtype=np.float32)
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        bounds = group_bounds(flat)
        counts = np.diff(bounds)
        column = np.repeat(np.cumsum(counts > 1) - 1, counts)
        many = np.repeat(counts > 1, counts)
        column, owner = column[many], owner[many]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (lo, lo + 4096))
            matrix = np.zeros((len(sets), min(4096, int(column[b - 1]) - lo + 1)), dtype=np.float32)
            matrix[owner[a:b], column[a:b] - lo] = 1
            common += matrix @ matrix.T
    common = common[np.ix_(left, right)].astype(np.int64)
    return common / (sizes[left][:, None] + sizes[right][None, :] - common)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per cell the classes of its rows, of its columns, and their similarities; a class's with itself are -1."""
    for table in sorted_groups(batches, "cell"):
        bounds = group_bounds(table.column("cell").to_numpy())
        same, side = table.column("same").to_numpy(), table.column("side").to_numpy()
        raw = table.column("shingles").to_pylist()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            # A repeated row of the document that stands for its class brings the set twice.
            names, first = np.unique(same[lo:hi], return_index=True)
            sides, sets = side[lo:hi][first], [np.frombuffer(raw[lo + x], dtype=K.U64) for x in first]
            left, right = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
            if len(names) < 2 or not len(left) or not len(right):
                continue
            found = similarities(sets, left, right)
            found[left[:, None] == right[None, :]] = -1
            yield names[left], names[right], found


def _pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, found in _cells(batches):
            x, y = np.nonzero(found >= threshold)
            once = left[x] < right[y] if np.array_equal(left, right) else np.ones(len(x), dtype=bool)
            x, y = x[once], y[once]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(left[x]), pa.array(right[y]), pa.array(found[x, y])], names=["a", "b", "jaccard"])

    return run


def _counts(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, found in _cells(batches):
            sides = ((left, found),) if np.array_equal(left, right) else ((left, found), (right, found.T))
            for names, rows in sides:
                links = np.count_nonzero(rows >= threshold, axis=1)
                any_ = links > 0
                if any_.any():
                    yield pa.RecordBatch.from_arrays([pa.array(names[any_]), pa.array(links[any_].astype(np.int64)), pa.array(rows[any_].max(axis=1))], names=["same", "links", "closest"])

    return run


def _candidates(docs: DataFrame, p: MinHash, threshold: float, block_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, same) of every document, (same, class_id, class_size) of every class, and cells of shingle sets to compare."""
    signed = settle(signatures(docs, p), "signatures")
    single = settle(sequences(signed), "sequences")
    need = max(0.0, threshold - DEVIATIONS * (threshold * (1 - threshold) / p.size) ** 0.5)
    roots = components(alike(single, p, need))
    ids = settle(signed.groupBy("doc_id").agg(F.min("same").alias("same")), "ids")
    classes = settle(ids.groupBy("same").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    members = settle(roots.join(classes, F.col("node") == F.col("same")).select("root", "same", "class_id"), "members")
    sizes = settle(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    members = settle(members.join(few(sizes), "root"), "members")
    texts = has_text(docs).join(few(members), F.col("doc_id") == F.col("class_id")).select("text", "same", "root", "n")
    sets = texts.mapInArrow(_sets(p.shingle), "same long, root long, n long, shingles binary")
    cells = in_cells(sets, "root", "same", block_docs).select("cell", "side", "same", "shingles")
    return ids, classes, cells.repartition("cell").sortWithinPartitions("cell")


def fingerprints(docs: DataFrame, p: MinHash = MinHash(), threshold: float = THRESHOLD, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, class_id, class_size, n_links, closest), a row a document with words: class_id is the least doc_id with the same
    word sequence, class_size the number of documents that have it, n_links the number of other classes whose sets of word
    shingles are at least `threshold` similar, and closest the greatest such similarity (null without a link).

    Pairs that share a band, and whose signatures come near the threshold, link candidate groups (transitively). In a group
    every pair is verified on its whole shingle sets, in cells of two blocks of about block_docs classes, so no group is too
    large for a task; only counts leave a cell. fingerprint_pairs() lists the links themselves.

    Null ids and null, empty or wordless texts have no row. Of repeated rows of one doc_id, with several texts, the
    first in the order of the word sequences' hashes counts. An empty table gives no rows. Other columns are ignored.
    """
    ids, classes, cells = _candidates(docs, p, threshold, block_docs)
    linked = cells.mapInArrow(_counts(threshold), "same long, links long, closest double").groupBy("same").agg(F.sum("links").alias("n_links"), F.max("closest").alias("closest"))
    facts = settle(classes.join(settle(linked, "linked"), "same", "left").where("class_size > 1 OR n_links > 0"), "facts")
    return ids.join(few(facts), "same", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "closest")


def fingerprint_pairs(docs: DataFrame, p: MinHash = MinHash(), threshold: float = THRESHOLD, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: the links that fingerprints() counts, between the class_ids of their classes, and
    of every copy one pair of similarity 1 with its class_id. See there for the rest."""
    ids, classes, cells = _candidates(docs, p, threshold, block_docs)
    named = classes.select("same", "class_id")
    pairs = settle(cells.mapInArrow(_pairs(threshold), "a long, b long, jaccard double"), "pairs")
    a, b = named.select(F.col("same").alias("a"), F.col("class_id").alias("x")), named.select(F.col("same").alias("b"), F.col("class_id").alias("y"))
    links = pairs.join(a, "a").join(b, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    copies = ids.join(few(settle(classes.where("class_size > 1").select("same", "class_id"), "copied")), "same").where("doc_id <> class_id")
    return links.unionByName(copies.select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")))
