import random

import numpy as np
import pytest

from stratalith.llm import fingerprint
from tests.llm import tables


def _sets(rows):
    import re

    out = {}
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if i is not None and words:
            out[i] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    return out


def _brute(rows, threshold):
    sets = _sets(rows)
    ids = sorted(sets)
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def _family(seed):
    r = random.Random(seed)
    rows = []
    for g in range(25):
        base = tables.soup(g, 100, 4000)
        for k in range(5):
            share = r.random() * 0.12
            rows.append((g * 10 + k, " ".join(f"n{r.random():.9f}".replace(".", "") if r.random() < share else w for w in base)))
    return rows


@pytest.mark.parametrize("block", [2, 1024])
def test_against_brute_force(spark, block):
    rows = _family(1)
    found = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in fingerprint.fingerprint_pairs(tables.docs(spark, rows), block_docs=block).collect()}
    true = _brute(rows, fingerprint.THRESHOLD)
    assert set(found) <= set(true)
    assert all(abs(found[k] - true[k]) < 1e-12 for k in found)
    assert len(found) / len(true) >= 0.95


def test_similarities_of_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (30, 40, 5, 60, 1, 30)]
    found = fingerprint.similarities(sets, np.arange(6), np.arange(6))
    for a in range(6):
        for b in range(6):
            assert a == b or found[a, b] == len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    assert (fingerprint.similarities(sets[:2], np.array([0]), np.array([1])) == found[0, 1]).all()


def test_copies_are_paired_with_their_first(spark):
    text = " ".join(tables.soup(1, 50))
    found = fingerprint.fingerprint_pairs(tables.docs(spark, [(i, text) for i in (4, 9, 2, 7)])).collect()
    assert sorted((r["doc_a"], r["doc_b"], r["jaccard"]) for r in found) == [(2, 4, 1.0), (2, 7, 1.0), (2, 9, 1.0)]


def test_irregular_rows(spark):
    found = fingerprint.fingerprint_pairs(tables.messy(spark)).collect()
    assert sorted((r["doc_a"], r["doc_b"], r["jaccard"]) for r in found) == [(1, 2, 1.0), (1, 3, 1.0)]


def test_empty_table(spark):
    assert fingerprint.fingerprint_pairs(tables.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [2, 1024])
def test_classes_and_links(spark, block):
    """Copies of texts and copies of near copies: every document has its class, and the links of its class, against brute force."""
    base = _family(2)[:60]
    rows = base + [(1000 + 10 * i + k, base[i][1].upper() if k % 2 else base[i][1]) for i in range(0, 60, 2) for k in range(i % 7)]
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(tables.docs(spark, rows), block_docs=block).collect()}
    assert sorted(found) == sorted(i for i, _ in rows)
    classes = {}
    for i, text in rows:
        classes.setdefault(text.lower(), []).append(i)
    links = {min(c): {} for c in classes.values()}
    for (a, b), s in _brute([(min(c), t) for t, c in classes.items()], fingerprint.THRESHOLD).items():
        links[a][b] = links[b][a] = s
    lost = 0
    for members in classes.values():
        for i in members:
            assert (found[i]["class_id"], found[i]["class_size"]) == (min(members), len(members))
            mine = links[min(members)]
            assert found[i]["n_links"] <= len(mine) and (found[i]["closest"] is None) == (found[i]["n_links"] == 0)
            assert found[i]["closest"] is None or any(abs(found[i]["closest"] - s) < 1e-12 for s in mine.values())
            lost += len(mine) - found[i]["n_links"]
    assert lost <= 0.05 * sum(len(links[min(c)]) * len(c) for c in classes.values())


def test_counts_are_those_of_the_pairs(spark):
    rows = [(i, t) for t, i in {t: i for i, t in _family(3)}.items()]  # each text once
    pairs = fingerprint.fingerprint_pairs(tables.docs(spark, rows)).collect()
    counted = {r["doc_id"]: r["n_links"] for r in fingerprint.fingerprints(tables.docs(spark, rows), block_docs=2).collect()}
    assert counted == {i: sum(i in (p["doc_a"], p["doc_b"]) for p in pairs) for i, _ in rows}


def test_rows_of_irregular_documents(spark):
    found = sorted((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in fingerprint.fingerprints(tables.messy(spark)).collect())
    assert found == [(1, 1, 3, 0), (2, 1, 3, 0), (3, 1, 3, 0), (8, 8, 1, 0), (9, 9, 1, 0), (10, 10, 1, 0), (11, 11, 1, 0), (12, 12, 1, 0)]
    assert fingerprint.fingerprints(tables.empty(spark)).count() == 0


def test_the_text_that_counts_is_the_one_compared(spark):
    """Of a doc_id with two texts, the pairs and their similarities are those of one text, whatever the order of the rows."""
    base = tables.soup(1, 60, 4000)
    one, other = " ".join(base[:55] + ["q"] * 5), " ".join(base + ["z"] * 40)
    found = []
    for rows in ([(1, one), (1, other), (2, " ".join(base))], [(1, other), (1, one), (2, " ".join(base))]):
        found.append([tuple(r) for r in fingerprint.fingerprint_pairs(tables.docs(spark, rows).coalesce(1)).collect()])
    assert len(found[0]) == 1 and found[0] == found[1]
