"""Vectorised word splitting and hashing over Arrow string columns.

Everything works on blocks of whole documents as one byte array, so the cost is a few numpy passes per byte and
no Python work per word. Hashes are 64-bit polynomials evaluated through prefix sums: the base is odd, hence
invertible modulo 2**64, so the sum over any slice can be shifted back to position 0 and equal slices get equal
hashes wherever they stand. Such polynomials have made collisions from 1024 values on (Thue-Morse words), so whatever may
be that long is hashed by sequence_hashes() instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_WORDS = 0xD6E8FEB86659FD93
_KEY = 0xC6A4A7935BD1E995
BLOCK_BYTES = 1 << 20
#: Longest slice that polynomial hashes are used for.
SHORT = 256

_SPACE = np.ones(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser); returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _power_table(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    tables = []
    for b in (base, inverse):
        t = np.full(size, b, dtype=U64)
        t[0] = 1
        tables.append(np.cumprod(t, dtype=U64))
    return tables[0], tables[1]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 16
    while size < n + 1:
        size *= 2
    return _power_table(base, size)


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Unmixed polynomial hash of values[starts[i]:ends[i]] for every i."""
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64) * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of values[starts[i]:ends[i]] for every i, of any length: the sum of a random-looking number for each value
    at its position, which no pattern of values makes collide."""
    lengths = ends - starts
    out = mix(lengths.astype(U64) + U64(_KEY))
    if not lengths.any():
        return out
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    each = mix(values[place + np.repeat(starts, lengths)].astype(U64) ^ mix(place.astype(U64) + U64(_KEY)))
    full = lengths > 0
    out[full] += np.add.reduceat(each, first[full])
    return mix(out)


class Words:
    """The words of a block of documents: hash of each, byte span of each, and where each document's words begin."""

    __slots__ = ("bounds", "doc_bytes", "ends", "hashes", "starts")

    def __init__(self, hashes, starts, ends, bounds, doc_bytes):
        self.hashes, self.starts, self.ends, self.bounds, self.doc_bytes = hashes, starts, ends, bounds, doc_bytes

    def window_hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Mixed hash of the k words from each position on, and a mask of the positions whose window stays inside its document."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=bool)
        at = np.arange(n - k + 1)
        h = mix(slice_hashes(self.hashes, at, at + k, _BASE_WORDS))
        inside = np.ones(n + 1, dtype=bool)
        begin, end = self.bounds[:-1], self.bounds[1:]
        begin, end = begin[end > begin], end[end > begin]  # a document without words has no position to mask
        for back in range(1, k):
            inside[np.maximum(end - back, begin)] = False
        # A document shorter than k has no window: everything from its first word on is masked above.
        return h, inside[: n - k + 1]

    def sequences(self, which: np.ndarray) -> np.ndarray:
        """Hash of all words, in order, of each of the documents `which`."""
        return sequence_hashes(self.hashes, self.bounds[which], self.bounds[which + 1])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split(texts: pa.Array, *, letters_only: bool) -> Words:
    """Words of an Arrow string array without nulls. letters_only: lower-cased runs of letters and digits (all bytes
    from 128 up count as letters); otherwise runs of anything but ASCII white space, as they are."""
    if letters_only:
        texts = pc.utf8_lower(texts)
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=hi)[lo:hi] if hi else np.zeros(0, dtype=np.uint8)
    offsets = offsets - lo
    inside = (_ALNUM if letters_only else _SPACE)[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0] = after[-1] = False
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[1:-1]
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = mix(slice_hashes(data, starts, ends))
    long = np.flatnonzero(ends - starts > SHORT)
    if len(long):
        hashes[long] = sequence_hashes(data, starts[long], ends[long])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), offsets)


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows with about `most` bytes of the column each (one row if it alone is longer)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for every full window, in log2(width) passes."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
