import random

import numpy as np
import pytest

from stratalith.llm import tokens
from tests.llm import tables


@pytest.fixture(scope="module")
def counter():
    return tokens.counter(tokens.VOCABULARY)


FIXED = ["", " ", "  ", "a", "Hello, world's  best!!\n\n  It'll don't 're  'x", "\t\tx  \n y ", "１２３ 漢字かな 🙂🙂 é  z", "a'b 's  'll", "x" * 300, " " * 90 + "end", "\x1c\x1d a\x85b", "<|endoftext|>"]


@pytest.mark.parametrize("text", FIXED)
def test_every_prefix(counter, text):
    assert counter.prefix_counts(text).tolist() == [len(counter.encode(text[:i])) for i in range(len(text) + 1)]


def test_random_texts(counter):
    r = random.Random(5)
    parts = ["the", " and", "'s", "'", "  ", "\n", " 12", "é", "漢", "🙂", "ing", ".", "...", " X", "\t", "'ll", " ", "zq"]
    for _ in range(150):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))
        assert counter.prefix_counts(text).tolist() == [len(counter.encode(text[:i])) for i in range(len(text) + 1)], text


def test_packing_round_trip(counter):
    deltas = np.array([1, 0, -2, 300, 5], dtype=np.int16)
    assert tokens.unpack_counts(tokens.pack_counts(deltas)).tolist() == [0, 1, 1, -1, 299, 304]
    assert tokens.unpack_counts(tokens.pack_counts(deltas[:0])).tolist() == [0]


def test_fitting_takes_the_last_prefix():
    assert tokens.fitting(np.array([0, 1, 2, 1, 2]), 1) == 3
    assert tokens.fitting(np.array([0, 1, 2]), 9) == 2


def test_table(spark, counter):
    d = tables.messy(spark)
    rows = tokens.token_counts(d, budgets=(5, 100)).collect()
    texts = [r["text"] for r in d.collect()]
    assert len(rows) == len(texts)
    for text, row in zip(texts, rows, strict=True):
        if text is None:
            assert row["n_tokens"] is None and row["prefix_counts"] is None and row["cut_at"] is None
            continue
        assert row["n_tokens"] == len(counter.encode(text))
        counts = tokens.unpack_counts(row["prefix_counts"])
        assert len(counts) == len(text) + 1 and counts[-1] == row["n_tokens"]
        for budget, cut in zip((5, 100), row["cut_at"], strict=True):
            assert counts[cut] <= budget and (cut == len(text) or (counts[cut + 1 :] > budget).all())


def test_empty_table(spark):
    assert tokens.token_counts(tables.empty(spark)).count() == 0


def _thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("letters", ["ab", "eq"])
def test_long_units_with_colliding_polynomials(counter, letters):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64."""
    words = [_thue_morse(4096, *letters), _thue_morse(4096, *reversed(letters)), "plain words", _thue_morse(4096, *letters)]
    changes, bounds = counter.deltas(words)
    for word, lo, hi in zip(words, bounds[:-1], bounds[1:], strict=True):
        assert changes[lo:hi].sum() == len(counter.encode(word))
        counts = np.r_[0, np.cumsum(changes[lo:hi])]
        assert all(counts[i] == len(counter.encode(word[:i])) for i in range(0, min(len(word), 300)))


def test_equal_hashes_are_told_apart(counter, monkeypatch):
    """With a hash of two values every lookup is wrong until it is compared."""
    monkeypatch.setattr(tokens.K, "slice_hashes", lambda points, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(2))
    monkeypatch.setattr(tokens.K, "mix", lambda x: x % np.uint64(2))
    fresh = tokens.PrefixCounter()
    for text in ["one two three, four! two one " * 3, "it's a dogs' dinner 12 34 12", "x" * 200 + " " + "y" * 200 + " " + "x" * 200]:
        assert fresh.prefix_counts(text).tolist() == [len(fresh.encode(text[:i])) for i in range(len(text) + 1)]


def test_totals_are_those_of_the_prefix_counts(spark):
    d = tables.messy(spark)
    whole = sorted((str(r["doc_id"]), r["n_tokens"] if r["n_tokens"] is not None else -1) for r in tokens.token_counts(d).collect())
    assert sorted((str(r["doc_id"]), r["tokens"] if r["tokens"] is not None else -1) for r in tokens.token_totals(d).collect()) == whole
    assert tokens.token_totals(tables.empty(spark)).count() == 0
