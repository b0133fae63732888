"""MinHash signatures over word shingles, in vectorised numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm import textkernel as K
from stratalith.llm.common import few, has_text, settle, tidy


@dataclass(frozen=True)
class MinHash:
    """shingle words a shingle; bands x rows hash functions x -> (a x + b) mod 2**64 with odd a, drawn from seed.

    With 40 bands of 4 rows, a pair of Jaccard similarity 0.5 shares a band with probability 0.92, of 0.6 with 0.996,
    and a pair of 0.05 with 0.0003."""

    shingle: int = 3
    bands: int = 40
    rows: int = 4
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, 1 << 63, (2, self.size), dtype=np.uint64)
        return (a << K.U64(1)) | K.U64(1), b


def shingles(words: K.Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each shingle, document of each, documents without words). Texts of 1 to k-1 words are one shingle."""
    counts = np.diff(words.bounds)
    hashes, inside = words.window_hashes(k)
    doc = words.doc_of_word()[: len(hashes)]
    hashes, doc = hashes[inside], doc[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = words.sequences(short)
        at = np.searchsorted(doc, short)
        hashes, doc = np.insert(hashes, at, whole), np.insert(doc, at, short)
    return hashes, doc, np.flatnonzero(counts == 0)


def minima(hashes: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per document (rows of the result) the least value of each function over its shingles."""
    out = np.empty((len(a), len(starts)), dtype=K.U64)
    buffer = np.empty_like(hashes)
    for i in range(len(a)):
        np.multiply(hashes, a[i], out=buffer)
        np.add(buffer, b[i], out=buffer)
        np.minimum.reduceat(buffer, starts, out=out[i])
    return out.T


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(least), bands), dtype=K.U64)
    for r in range(rows):
        keys = K.mix(keys ^ least[:, r::rows][:, :bands]) * K.U64(0x9FB21C651E98DF25)
    return K.mix(keys + np.arange(bands, dtype=K.U64) * K.U64(0xA24BAED4963EE407))


def _signer(p: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = p.functions()
        for batch in batches:
            for block in K.blocks(batch, "text", K.BLOCK_BYTES // 2):
                words = K.split(block.column("text"), letters_only=True)
                hashes, doc, _ = shingles(words, p.shingle)
                if not len(hashes):
                    continue
                starts = np.r_[0, np.flatnonzero(doc[1:] != doc[:-1]) + 1]
                which = doc[starts]
                least = minima(hashes, starts, a, b)
                same = words.sequences(which)
                keys = band_keys(least, p.bands, p.rows).view(np.int64)
                sketch = np.ascontiguousarray((K.mix(least) >> K.U64(56)).astype(np.uint8))  # minima are small numbers: only mixed ones tell sets apart in a byte
                n = len(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").take(pa.array(which)).cast(pa.int64()),
                        pa.array(same.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.bands), pa.array(keys.ravel())),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * p.size), pa.py_buffer(sketch)]),
                    ],
                    names=["doc_id", "same", "bands", "sketch"],
                )

    return sign


def signatures(docs: DataFrame, p: MinHash) -> DataFrame:
    """(doc_id, same, bands, sketch): `same` hashes the normalised word sequence, so copies share it; sketch has a
    byte of each mixed minimum. Null or wordless texts have no row."""
    return has_text(docs).mapInArrow(tidy(_signer(p)), "doc_id long, same long, bands array<long>, sketch binary")


#: Rows of a bucket that are compared in one task; larger buckets are cut into blocks, and every two blocks meet in a task.
BLOCK_ROWS = 4096


def sequences(signed: DataFrame) -> DataFrame:
    """(same, bands, sketch, first_doc): one row a word sequence. Copies are put together before they are shuffled."""
    return signed.groupBy("same").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first_doc"))


def shared_bands(single: DataFrame) -> DataFrame:
    """(key, same, n) for band values that n > 1 word sequences share, of a table of sequences(); of several keys with exactly the
    same members, one stays. Members are the same where their number, their least and the exclusive or of their hashes are."""
    rows = single.select(F.explode("bands").alias("key"), "same")
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("least"), F.bit_xor(F.xxhash64("same")).alias("members")).where("n > 1")
    keys = settle(counted.groupBy("n", "least", "members").agg(F.min("key").alias("key")).select("key", "n"), "keys")
    return rows.join(few(keys), "key")


def in_cells(rows: DataFrame, group: str, member: str, block_rows: int) -> DataFrame:
    """rows (with n, the size of the group) with `cell` and `side`: each group of at most block_rows is a cell; of a larger one
    every two blocks are, and every block with itself. Members fall into blocks by hash, so no group is brought together.

    side: 2 in a group's or block's own cell, else 0 in the lower and 1 in the higher block."""
    blocks = F.ceil(F.col("n") / block_rows)
    placed = rows.withColumn("block", F.pmod(F.xxhash64(group, member), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    own = F.col("block") == F.col("other")
    cell = F.when(blocks == 1, F.col(group)).otherwise(F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")))
    return placed.withColumn("cell", cell).withColumn("side", F.when(own, 2).when(F.col("block") < F.col("other"), 0).otherwise(1)).drop("block", "other", "n")
