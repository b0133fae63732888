import random

import pytest

from stratalith.llm import packing
from tests.llm import tables


def _brute(lengths, window, most):
    """The same rule by rescanning lists."""
    opened, out = [], []
    for n in lengths:
        fits = [w for w in opened if sum(w) + n <= window]
        if fits:
            top = max(sum(w) for w in fits)
            w = next(w for w in fits if sum(w) == top)
        else:
            if len(opened) == most:
                top = max(sum(w) for w in opened)
                full = next(w for w in opened if sum(w) == top)
                opened = [w for w in opened if w is not full]
                out.append((sum(full), False))
            w = []
            opened.append(w)
        w.append(n)
        if sum(w) == window:
            opened = [x for x in opened if x is not w]
            out.append((window, False))
    return out + [(sum(w), True) for w in opened]


@pytest.mark.parametrize("most", [1, 3, 8])
def test_rule(most):
    r = random.Random(most)
    lengths = [r.randrange(1, 51) for _ in range(500)]
    found = list(packing.pack(((n, [(i, 0, n)]) for i, n in enumerate(lengths)), 50, most))
    assert [(u, left) for u, left, _ in found] == _brute(lengths, 50, most)
    assert sum(left for _, left, _ in found) <= most


def _check(spark, rows, window=64, **options):
    d = tables.docs(spark, rows)
    found = packing.pack_documents(d, window=window, **options).collect()
    tokens = {}
    for w in found:
        assert 0 < w["used"] <= window and w["used"] == sum(w["lengths"]) and w["n_pieces"] == len(w["doc_ids"])
        for i, s, n in zip(w["doc_ids"], w["starts"], w["lengths"], strict=True):
            tokens.setdefault(i, []).extend(range(s, s + n))
    expected = {}
    for i, text, *_ in rows:
        if i is not None and text is not None and text.split():
            expected.setdefault(i, []).extend(range(len(text.split())))
    assert {i: sorted(t) for i, t in tokens.items()} == {i: sorted(t) for i, t in expected.items()}
    assert len({w["window_id"] for w in found}) == len(found)
    return found


def test_every_token_once(spark):
    r = random.Random(9)
    rows = [(i, " ".join(tables.soup(i, r.choice([0, 1, 3, 20, 63, 64, 65, 200])))) for i in range(300)]
    found = _check(spark, rows)
    assert sum(w["used"] for w in found) / (64 * len(found)) > 0.9
    _check(spark, rows, most_open=1, merged=1)


def test_irregular_rows(spark):
    d = tables.messy(spark)
    _check(spark, [(r["doc_id"], r["text"]) for r in d.collect()], window=4096)


def test_empty_table(spark):
    assert packing.pack_documents(tables.empty(spark)).count() == 0
