"""Exact token counts of every prefix of a text, under a public byte-pair vocabulary.

Texts are cut into units at which no prefix's tokenisation can differ from the text's: a unit is a piece of the
pre-tokeniser with the white space before it. Inside a piece, dynamic programming over prefixes finds the last token of
each: the one token that ends there and that byte-pair encoding would leave beside the last token of the prefix before
it. So the counts inside a unit do not depend on what stands around it, and a text's are the sums along its units.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from stratalith.llm import textkernel as K
from stratalith.llm.common import tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUDGETS = (512, 2048, 8192)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct units, and pairs of tokens, of each of the two generations that a worker remembers.
_REMEMBERED = 250_000
#: Longer units are remembered for a block only, by their text; shorter ones are looked up by hash and compared.
LONG_UNIT = 64
_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE = range(5)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of every code point under the pre-tokeniser's own notions of letter, number and white space."""
    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, expression in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
        for found in regex.finditer(expression, every):
            a, b = ord(found[0][0]), ord(found[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = _OTHER
    table[32] = _SPACE
    return table


class Generations:
    """A dictionary that forgets what has not been asked for of late."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


def unit_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units begin in the code points of texts laid end to end that begin at `begins`.

    A unit is white space with the run of letters, of numbers or of others after it, or a contraction with the white
    space before it. White space that ends in a space gives that space to the run, so a contraction has none before it
    then, but begins a run of others."""
    n = len(points)
    kind = _class_table()[points]
    blank = kind >= _BLANK
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    first = first[:n]
    before = np.empty(n, dtype=np.uint8)
    before[:1], before[1:] = _BLANK, kind[:-1]
    start = first | (blank & (before < _BLANK)) | (~blank & (before < _BLANK) & (kind != before))
    for at in np.flatnonzero(points == 39):
        # An apostrophe that is a run of its own, not joined to a space, before letters.
        if at + 1 >= n or first[at + 1] or kind[at + 1] != _LETTER or not (first[at] or (before[at] != _SPACE and before[at] != _OTHER)):
            continue
        c, d = int(points[at + 1]), int(points[at + 2]) if at + 2 < n and not first[at + 2] else 0
        size = 2 if c in (115, 116, 109, 100) else 3 if (c, d) in ((114, 101), (118, 101), (108, 108)) else 0
        if size:
            start[at + 1] = False
            if at + size < n:
                start[at + size] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("prefix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class PrefixCounter:
    """Prefix counts under one vocabulary. encode() and prefix_counts() agree: prefix_counts(t)[i] == len(encode(t[:i]))."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.encoding = encoding(vocabulary)
        self.ranks = self.encoding._mergeable_ranks
        self.encode = self.encoding.encode_ordinary
        #: Rank of each token, -1 for what only begins one.
        self.trie = {token[:i]: -1 for token in self.ranks for i in range(1, len(token))} | self.ranks
        self.beside: dict[int, bool] = {}
        self.units = Generations(_REMEMBERED)

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] taken as one piece, for i = 0 ... len(piece).

        A token that begins at i is the last of the prefix that it ends exactly where encoding leaves it beside the last
        token of piece[:i]; every prefix is so reached once."""
        n = len(piece)
        look, single = self.trie.get, self.encoding._core_bpe.encode_single_piece
        beside = self.beside
        if len(beside) > 2 * _REMEMBERED:
            beside.clear()
        counts, last, begin = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            count, base = counts[i] + 1, last[i] << 32
            for end in range(i + 1, n + 1):
                rank = look(piece[i:end])
                if rank is None:
                    break
                if rank < 0 or counts[end]:
                    continue
                if i:
                    fits = beside.get(base | rank)
                    if fits is None:
                        fits = beside[base | rank] = single(piece[begin[i] : end]) == [last[i], rank]
                    if not fits:
                        continue
                counts[end], last[end], begin[end] = count, rank, i
        return counts

    def _unit_counts(self, unit: str) -> list[int]:
        """Tokens of unit[:i], i = 0 ... len(unit)."""
        plain = unit[1:2] if unit[0] == " " else unit[0]
        if plain and not plain.isspace() and plain != "'" and not "\x1c" <= plain <= "\x1f":  # nearly all: one piece
            return self._piece(unit)
        points = np.frombuffer(unit.encode("utf-32-le"), dtype=np.uint32)
        blank = _class_table()[points] >= _BLANK
        at = int(np.argmin(blank)) if not blank.all() else len(unit)
        space, body = unit[:at], unit[at:]
        if body[:1] == "'" and body[1:] and _class_table()[ord(body[1])] == _LETTER:  # a contraction: its prefixes are other pieces
            return [len(self.encode(unit[:i])) for i in range(len(unit) + 1)]
        counts = self._piece(space)
        if not body:
            return counts
        if not space:
            return self._piece(body)
        done = self._piece(space[:-1])[-1]
        if space[-1] == " ":
            tail = self._piece(" " + body)[2:]
        else:  # a last white space other than a space is a piece of its own
            done += self._piece(space[-1])[-1]
            tail = self._piece(body)[1:]
        return counts + [done + c for c in tail]

    def _piece(self, text: str) -> list[int]:
        counts = self.piece_counts(raw := text.encode())
        if len(raw) == len(text):
            return counts
        return [0, *(counts[i] for i in np.cumsum([len(c.encode()) for c in text]))]

    def deltas(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(change of the count with each character, of all texts end to end; where each text begins, and the end).

        int16, as a longer prefix can have fewer tokens by a few."""
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(points):
            return np.zeros(0, dtype=np.int16), bounds
        starts = unit_starts(points, bounds[:-1][np.diff(bounds) > 0])
        ends = np.r_[starts[1:], len(points)]
        size = ends - starts
        hashes = K.mix(K.slice_hashes(points, starts, ends) + size.astype(K.U64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        odd = self._unlike(points, starts, size, first, which)
        if len(odd):  # long units, and any that a hash alone would take for another: each its own
            first, which = np.r_[first, odd], which.copy()
            which[odd] = np.arange(len(distinct), len(distinct) + len(odd))
            distinct = np.r_[distinct, np.zeros(len(odd), dtype=distinct.dtype)]
        parts, long = [], {}
        get, put = self.units.get, self.units.put
        for key, a, b in zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True):
            unit = joined[a:b]
            known = get(key) if b - a <= LONG_UNIT else (unit, long[unit]) if unit in long else None
            if known is not None and known[0] == unit:
                parts.append(known[1])
                continue
            part = np.diff(self._unit_counts(unit)).astype("<i2").tobytes()
            if b - a > LONG_UNIT:
                long[unit] = part
            elif known is None:
                put(key, (unit, part))
            parts.append(part)
        flat = np.frombuffer(b"".join(parts), dtype="<i2")
        sizes = size[first]
        offset = (np.cumsum(sizes) - sizes)[which] - starts
        return flat[np.arange(len(points)) + np.repeat(offset, size)], bounds

    @staticmethod
    def _unlike(points: np.ndarray, starts: np.ndarray, size: np.ndarray, first: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Units that differ from the first one of their hash, and all long ones but the first of a hash."""
        model = first[which]
        same_size = size == size[model]
        repeated = (model != np.arange(len(starts))) & same_size & (size <= LONG_UNIT)
        at = np.flatnonzero(repeated)
        sizes = size[at]
        begin = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        differ = points[place + np.repeat(starts[at], sizes)] != points[place + np.repeat(starts[model[at]], sizes)]
        wrong = np.logical_or.reduceat(differ, begin) if len(at) else np.zeros(0, dtype=bool)
        return np.sort(np.r_[at[wrong], np.flatnonzero((model != np.arange(len(starts))) & ~repeated)])

    def prefix_counts(self, text: str) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.deltas([text])[0], dtype=np.int64)])


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> PrefixCounter:
    return PrefixCounter(vocabulary)


def _sent(spark: SparkSession, vocabulary: str) -> str:
    """Has the vocabulary file sent to every executor; returns the name that _there() finds it by."""
    sent = spark.__dict__.setdefault("_stratalith_files", set())
    if vocabulary not in sent:
        spark.sparkContext.addFile(vocabulary)
        sent.add(vocabulary)
    return vocabulary.rsplit("/", 1)[-1]


def _there(name: str) -> str:
    return SparkFiles.get(name)


def pack_counts(deltas: np.ndarray) -> bytes:
    """Deltas in a byte each (in two where a byte is too small), deflated."""
    small = not len(deltas) or (deltas.min() >= -128 and deltas.max() <= 127)
    return (b"\x01" if small else b"\x02") + zlib.compress((deltas.astype("i1") if small else deltas.astype("<i2")).tobytes(), 1)


def unpack_counts(packed: bytes) -> np.ndarray:
    """Tokens of text[:i] for i = 0 ... len(text)."""
    deltas = np.frombuffer(zlib.decompress(packed[1:]), dtype="i1" if packed[:1] == b"\x01" else "<i2")
    return np.concatenate([[0], np.cumsum(deltas, dtype=np.int64)])


def fitting(counts: np.ndarray, budget: int) -> int:
    """The greatest i for which text[:i] has at most `budget` tokens."""
    return int(len(counts) - 1 - np.argmax(counts[::-1] <= budget))


def _totals(name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(_there(name)).encode_to_numpy  # no list of integers a text
        try:
            for batch in batches:
                for block in K.blocks(batch, "text"):
                    counts = [None if t is None else len(encode(t, disallowed_special=())) for t in block.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])
        finally:
            encoding.cache_clear()  # what the encoder keeps of long texts goes with the task

    return run


def token_totals(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) for every row of docs: n_tokens of token_counts() alone, by encoding each text once. See there for nulls,
    repeated rows and empty tables."""
    name = _sent(docs.sparkSession, vocabulary)
    return docs.select("doc_id", "text").mapInArrow(tidy(_totals(name)), "doc_id long, tokens long")


def _counter(name: str, budgets: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(_there(name))
        for batch in batches:
            for block in K.blocks(batch, "text"):
                totals, packed, cuts = [], [], []
                texts = block.column("text").to_pylist()
                changes, bounds = count.deltas([t or "" for t in texts])
                for i, text in enumerate(texts):
                    if text is None:
                        totals.append(None)
                        packed.append(None)
                        cuts.append(None)
                        continue
                    deltas = changes[bounds[i] : bounds[i + 1]]
                    counts = np.cumsum(deltas, dtype=np.int32)
                    totals.append(int(counts[-1]) if len(counts) else 0)
                    packed.append(pack_counts(deltas))
                    most = int(counts.max()) if len(counts) else 0
                    cuts.append([len(text) if b >= most else fitting(np.r_[0, counts], b) for b in budgets])
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").cast(pa.int64()), pa.array(totals, pa.int64()), pa.array(packed, pa.binary()), pa.array(cuts, pa.list_(pa.int32()))],
                    names=["doc_id", "n_tokens", "prefix_counts", "cut_at"],
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """(doc_id, n_tokens, prefix_counts, cut_at) for every row of docs, in its order.

    n_tokens is the exact count of the whole text; prefix_counts holds that of every prefix (unpack_counts() reads it);
    cut_at gives, for each of budgets, the length in characters of the longest prefix with at most so many tokens.

    A null text has nulls, the empty text 0 tokens. Null and repeated doc_ids stay as they are. An empty table gives no
    rows. Other columns are ignored, whatever their names. vocabulary is a path on the driver; the file is sent to the executors.
    """
    name = _sent(docs.sparkSession, vocabulary)
    return docs.select("doc_id", "text").mapInArrow(tidy(_counter(name, tuple(budgets))), "doc_id long, n_tokens long, prefix_counts binary, cut_at array<int>")
