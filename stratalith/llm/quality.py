"""Quality classifier: histogram gradient-boosted trees over statistics of documents, flattened into arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm import textkernel as K
from stratalith.llm.common import has_text, tidy

#: Labelled documents the model is fitted on at most: those with the least hash of doc_id.
TRAIN_ROWS = 20_000

_CLASSES = ("lower", "upper", "digit", "blank", "newline", "period", "comma", "exclamation", "bar", "symbol", "punctuation", "beyond_ascii")
_TABLE = np.full(256, _CLASSES.index("punctuation"), dtype=np.int64)
_TABLE[97:123], _TABLE[65:91], _TABLE[48:58], _TABLE[128:] = 0, 1, 2, 11
_TABLE[[0, 9, 11, 12, 13, 32]], _TABLE[10] = 3, 4
_TABLE[ord(".")], _TABLE[ord(",")], _TABLE[ord("!")], _TABLE[ord("|")] = 5, 6, 7, 8
_TABLE[[ord(c) for c in "#$%&*@^~<>{}[]=+\\_/"]] = 9

FEATURES = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "mean_word", "longest_word", "short_words", "distinct_words", "distinct_triples", "commonest_word", "distinct_lines", "mean_line",
    "periods_a_word", "marks_a_word",
)


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the number of distinct hashes and the count of the commonest."""
    order = np.argsort(hashes ^ K.mix(doc.astype(K.U64)), kind="stable")
    d, h = doc[order], hashes[order]
    bounds = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.r_[bounds, len(h)])
    most = np.zeros(n)
    np.maximum.at(most, d[bounds], counts)
    return np.bincount(d[bounds], minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; a null text counts as empty, and every share of nothing is 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    words = K.split(texts, letters_only=False)
    offsets = words.doc_bytes
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    lo = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset] if n else 0
    data = raw[lo : lo + offsets[-1]]
    sizes = np.diff(offsets)
    counts = np.bincount(np.repeat(np.arange(n) * len(_CLASSES), sizes) + _TABLE[data], minlength=n * len(_CLASSES)).reshape(n, len(_CLASSES))
    of = lambda a, b: a / np.maximum(b, 1)
    n_words = np.diff(words.bounds)
    doc = words.doc_of_word()
    lengths = words.ends - words.starts
    longest = np.zeros(n)
    np.maximum.at(longest, doc, lengths)
    distinct, most = _distinct(doc, words.hashes, n)
    triples, inside = words.window_hashes(3)
    triple_doc = doc[: len(triples)][inside]
    distinct_triples, _ = _distinct(triple_doc, triples[inside], n)
    # Lines: pieces between line feeds, empty ones too.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.r_[offsets[:-1], feeds + 1], kind="stable")
    feed_doc = np.searchsorted(offsets, feeds, side="right") - 1
    line_doc = np.sort(np.r_[np.arange(n), feed_doc], kind="stable")
    line_ends = np.sort(np.r_[offsets[1:], feeds], kind="stable")
    distinct_lines, _ = _distinct(line_doc, K.mix(K.slice_hashes(data, line_starts, line_ends)), n)
    n_lines = np.bincount(line_doc, minlength=n)
    return np.column_stack(
        [
            of(counts, sizes[:, None]),
            np.log1p(sizes),
            np.log1p(n_words),
            of(np.bincount(doc, lengths, n), n_words),
            np.log1p(longest),
            of(np.bincount(doc, lengths <= 3, n), n_words),
            of(distinct, n_words),
            of(distinct_triples, np.bincount(triple_doc, minlength=n)),
            of(most, n_words),
            of(distinct_lines, n_lines),
            np.log1p(of(sizes, n_lines)),
            of(counts[:, 5], n_words),
            of(counts[:, 7] + counts[:, 8] + counts[:, 9], n_words),
        ]
    )


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth. Node i has children 2i+1 and 2i+2; a row goes right where its feature exceeds
    the threshold; leaf holds the values of the last level from left to right."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.base + self.leaf[trees, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def split(flat: np.ndarray, cuts: list[np.ndarray], bins: int, grad: np.ndarray, hess: np.ndarray, node: np.ndarray, many: int, penalty: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, threshold) of the best split of each of `many` nodes, by histograms; flat has each row's bin of each feature, plus
    `bins` times the feature. The threshold is infinite where no split gains and leaves `least` rows on both sides."""
    n, width = flat.shape
    feature, threshold = np.zeros(many, dtype=np.int64), np.full(many, np.inf)
    key = (node[:, None] * (width * bins) + flat).ravel()
    g, h, c = (np.bincount(key, np.repeat(w, width), many * width * bins).reshape(many, width, bins).cumsum(axis=2) for w in (grad, hess, np.ones(n)))
    gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
    gain = g**2 / (h + penalty) + (gt - g) ** 2 / (ht - h + penalty) - gt**2 / (ht + penalty)
    gain = np.where((c >= least) & (ct - c >= least), gain, -1.0).reshape(many, -1)
    best = gain.argmax(axis=1)
    for k in range(many):
        f, b = divmod(int(best[k]), bins)
        if gain[k, best[k]] > 1e-9 and b < len(cuts[f]):
            feature[k], threshold[k] = f, cuts[f][b]
    return feature, threshold


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0, least: int = 10) -> Forest:
    """Second-order boosting of the logistic loss; splits are sought over histograms of quantile bins."""
    prior = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    inner = (1 << depth) - 1
    none = np.zeros((0, inner))
    if len(np.unique(y)) < 2:
        return Forest(none.astype(np.int64), none, np.zeros((0, inner + 1)), base)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) for f in range(width)]
    binned = np.column_stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)])  # x > cuts[b] exactly where binned > b
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    all_features, all_thresholds, all_leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            feature[first : first + many], threshold[first : first + many] = split(flat, cuts, bins, grad, hess, node - first, many, penalty, least)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + penalty)
        margin += leaf[at]
        all_features.append(feature)
        all_thresholds.append(threshold)
        all_leaves.append(leaf)
    return Forest(np.array(all_features), np.array(all_thresholds), np.array(all_leaves), base)


def _featurer() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch, "text"):
                x = features(block.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([block.column("y"), flat], names=["y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Fits the model of labels.quality on `rows` labelled documents at most, those with the least hash of doc_id.

    A doc_id labelled several times counts with its majority (a tie is good), one with several texts with the least of them;
    null labels, ids and texts do not count.
    Without two classes the model is a constant: the clipped share of good ones, and 0.999 where there are none at all."""
    voted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    chosen = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("__sl_id"), "y")
    # `chosen` has at most `rows` rows, whatever the input.
    labelled = has_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("__sl_id")).groupBy("__sl_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text")
    table = labelled.mapInArrow(_featurer(), "y double, x array<double>").toPandas()
    if not len(table):
        return fit(np.zeros((1, len(FEATURES))), np.ones(1))
    x = np.array(table["x"].tolist()).reshape(-1, len(FEATURES))
    y = table["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # tasks may finish in any order; the model must not depend on it
    return fit(x[order], y[order])


def _scorer(model: Forest, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch, "text"):
                score = model.score(features(block.column("text")))
                yield pa.RecordBatch.from_arrays([block.column("doc_id").cast(pa.int64()), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "score", "keep"])

    return run


def _filter(model: Forest, threshold: float, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(column)], names=["text"])
            keep = [model.score(features(block.column("text"))) >= threshold for block in K.blocks(texts, "text")]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, keep) for every row of docs, repeated ones and null ids too; score is the modelled probability that
    the document is good, keep says whether it reaches the threshold.

    doc_id may be of any integer type. A null text is scored as the empty text. Labels that name no document, and documents without a label, are fine; see
    train() for ties and missing classes. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    model = train(docs, labels, rows)
    return docs.select("doc_id", "text").mapInArrow(tidy(_scorer(model, threshold)), "doc_id long, score double, keep boolean")


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all columns; the text decides, so repeated rows share their fate."""
    model = train(docs, labels, rows)
    return docs.mapInArrow(tidy(_filter(model, threshold, docs.columns.index("text"))), docs.schema)
