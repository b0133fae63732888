import random

import numpy as np
import pytest

from stratalith.llm import neardup
from stratalith.llm.components import components
from stratalith.llm.minhash import MinHash
from tests.llm import tables


def _groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(7, 7), (300, 300), (None, 1)]
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == _groups([e for e in edges if None not in e])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_forest_spans_the_similarity_graph():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (4, 160), dtype=np.uint8)
    rows = np.vstack([np.where(rng.random(160) < 0.3, rng.integers(0, 256, 160), base[i % 4]).astype(np.uint8) for i in range(30)])
    need = 0.45 * (1 - 1 / 256) + 1 / 256
    full = [(i, j) for i in range(30) for j in range(i + 1, 30) if (rows[i] == rows[j]).mean() >= need]
    assert _groups(neardup.alike_edges(rows, 0.45)) == _groups(full)


def _edit(words, share, seed):
    r = random.Random(seed)
    return [f"new{r.random()}" if r.random() < share else w for w in words]


def _jaccard(a, b):
    x, y = ({tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_against_brute_force(spark):
    """Near copies are grouped, documents that share a passage or nothing are not."""
    words = {}
    for g in range(40):
        base = tables.soup(g, 150, 5000)
        words[10 * g] = base
        words[10 * g + 1] = _edit(base, 0.04, g)
        words[10 * g + 2] = [*base, "and", "more"]
        words[10 * g + 3] = tables.soup(1000 + g, 400, 5000)[:300] + base[:60]
    found = {r["doc_id"]: r["keep_id"] for r in neardup.near_duplicates(tables.docs(spark, [(i, " ".join(w)) for i, w in words.items()])).collect()}
    ids = sorted(words)
    true = _groups([(i, j) for i in ids for j in ids if i < j < i + 10 and _jaccard(words[i], words[j]) >= 0.5])
    expected = {i: r for i, r in true.items() if i != r}
    hit = sum(found.get(i) == r for i, r in expected.items())
    assert hit / len(expected) >= 0.95
    assert all(i in expected for i in found)


@pytest.mark.parametrize("seed", range(3))
def test_forest_across_two_blocks(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 256, (4, 160), dtype=np.uint8)
    rows = np.vstack([np.where(rng.random(160) < 0.3, rng.integers(0, 256, 160), base[i % 4]).astype(np.uint8) for i in range(30)])
    side = rng.integers(0, 2, 30)
    need = 0.45 * (1 - 1 / 256) + 1 / 256
    full = [(i, j) for i in range(30) for j in range(i + 1, 30) if side[i] != side[j] and (rows[i] == rows[j]).mean() >= need]
    assert _groups(neardup.alike_edges(rows, 0.45, side)) == _groups(full)


def test_hot_bands_of_unlike_documents(spark):
    """Documents that share a third and so some bands: cutting their buckets into blocks changes no group."""
    shared = tables.soup(1, 60, 10**9)
    rows = [(i, " ".join(shared + tables.soup(10 + i % 250, 110, 10**9) + [f"end{i}"])) for i in range(300)]
    found = [sorted(tuple(r) for r in neardup.near_duplicates(tables.docs(spark, rows), block_rows=b).collect()) for b in (8, 4096)]
    assert found[0] == found[1] and len(found[0]) >= 50


def test_case_and_punctuation_do_not_count(spark):
    a = tables.soup(5, 60)
    found = neardup.near_duplicates(tables.docs(spark, [(1, " ".join(a)), (2, ", ".join(a).upper() + "!")])).collect()
    assert [(r["doc_id"], r["keep_id"], r["group_size"]) for r in found] == [(2, 1, 2)]


def test_a_large_bucket(spark):
    base = tables.soup(8, 100, 3000)
    rows = [(i, " ".join(_edit(base, 0.02, i))) for i in range(400)]
    assert neardup.near_duplicates(tables.docs(spark, rows)).count() == 399


def test_irregular_rows(spark):
    d = tables.messy(spark)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in neardup.near_duplicates(d).collect()) == [(2, 1, 3), (3, 1, 3)]
    kept = neardup.drop_near_duplicates(d)
    assert kept.schema == d.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", *map(str, [1, 4, 5, 6, 7, 8, 9, 10, 11, 12])])


def test_an_id_of_several_texts_joins_their_groups(spark):
    a, b = (" ".join(tables.soup(s, 60, 3000)) for s in (1, 2))
    found = neardup.near_duplicates(tables.docs(spark, [(5, a), (6, a), (6, b), (7, b)])).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == [(6, 5, 3), (7, 5, 3)]


def test_empty_table(spark):
    assert neardup.near_duplicates(tables.empty(spark)).count() == 0
    assert neardup.drop_near_duplicates(tables.empty(spark)).count() == 0


def test_parameters():
    p = MinHash()
    a, b = p.functions()
    assert len(a) == len(b) == p.size == 160 and (a % 2 == 1).all()


@pytest.mark.parametrize("size", [60, 400, 5000])
def test_sketches_estimate_the_similarity_of_sets_of_any_size(spark, size):
    """Two bytes agree by chance once in 256, however many shingles a document has."""
    from stratalith.llm.minhash import signatures

    base = tables.soup(3, size, 10**9)
    rows, true = [(0, " ".join(base))], {}
    for k, share in enumerate((0.0, 0.3, 0.6, 0.9), 1):
        other = base[: int(share * size)] + tables.soup(100 + k, size - int(share * size), 10**9)
        rows.append((k, " ".join(other)))
        true[k] = _jaccard(base, other)
    sketches = {r["doc_id"]: np.frombuffer(r["sketch"], dtype=np.uint8) for r in signatures(tables.docs(spark, rows), MinHash()).collect()}
    assert all(abs((sketches[0] == sketches[k]).mean() - j) < 0.16 for k, j in true.items())


def test_long_documents_that_share_a_third_are_left_alone(spark):
    """They share bands often, so verification has to tell them apart."""
    rows = []
    for g in range(40):
        base = tables.soup(g, 900, 10**9)
        rows += [(10 * g + k, " ".join(base[:450] + tables.soup(1000 + 10 * g + k, 550, 10**9))) for k in range(3)]
    assert neardup.near_duplicates(tables.docs(spark, rows)).count() <= 3
