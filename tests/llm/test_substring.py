import random

import numpy as np
import pyarrow as pa
import pytest

from stratalith.llm import substring
from tests.llm import tables


def _brute(rows, least):
    texts = {}
    for i, text in rows:
        if i is not None and text is not None:
            texts.setdefault(i, []).append(text.split())
    out = set()
    levels = {}
    size = least
    while True:
        where = {}
        for i, several in texts.items():
            for words in several:
                for k in range(len(words) - size + 1):
                    where.setdefault(tuple(words[k : k + size]), set()).add((i, k))
        hits = {}
        for spots in where.values():
            if len({i for i, _ in spots}) > 1:
                for i, k in spots:
                    hits.setdefault(i, set()).add(k)
        if not hits:
            break
        levels[size] = hits
        size *= 2
    for i, starts in levels.get(least, {}).items():
        spans = []
        for k in sorted(starts):
            if spans and k <= spans[-1][1]:
                spans[-1][1] = k + least
            else:
                spans.append([k, k + least])
        for a, b in spans:
            longest = max(n for n, hits in levels.items() if any(a <= k and k + n <= b for k in hits.get(i, ())))
            out.add((i, a, b, longest))
    return out


@pytest.mark.parametrize("least", [2, 5, 12])
def test_against_brute_force(spark, least):
    r = random.Random(least)
    passages = [tables.soup(900 + i, n, 3000) for i, n in enumerate((5, 12, 13, 40, 100, 11))]
    rows = []
    for i in range(60):
        words = tables.soup(i, r.randrange(0, 60), 3000)
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            at = r.randrange(len(words) + 1)
            words[at:at] = p[: r.randrange(1, len(p) + 1)]
        rows.append((i, " ".join(words)))
    found = {tuple(x) for x in substring.repeated_passages(tables.docs(spark, rows), least).select("doc_id", "start_word", "end_word", "longest").collect()}
    assert found == _brute(rows, least)


def test_default_length(spark):
    p = tables.soup(77, 55, 3000)
    a, b = tables.soup(1, 30, 3000) + p, p + tables.soup(2, 40, 3000)
    found = {tuple(r) for r in substring.repeated_passages(tables.docs(spark, [(1, " ".join(a)), (2, "\n".join(b)), (3, " ".join(p[:49]))])).collect()}
    assert found == {(1, 30, 85, 50), (2, 0, 55, 50)}


def test_repetition_inside_one_document_does_not_count(spark):
    p = " ".join(tables.soup(5, 60))
    assert substring.repeated_passages(tables.docs(spark, [(1, f"{p} x {p}"), (1, p)])).count() == 0


def test_irregular_rows(spark):
    d = tables.messy(spark)
    found = {tuple(r) for r in substring.repeated_passages(d).collect()}
    assert found == {(i, 0, 80, 50) for i in (1, 2, 3)}


def test_empty_table(spark):
    assert substring.repeated_passages(tables.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substring.repeated_passages(tables.empty(spark), 1)


@pytest.mark.parametrize("part", [1, 3, 20])
def test_frequent_passages_in_parts(spark, part):
    """The same stretches, however few runs a task holds at once."""
    r = random.Random(part)
    p = tables.soup(5, 30, 3000)
    rows = [(i, " ".join(tables.soup(i, 10, 3000) + p[r.randrange(4) : 30 - r.randrange(4)] + tables.soup(i + 500, 5, 3000))) for i in range(50)]
    found = {tuple(x) for x in substring.repeated_passages(tables.docs(spark, rows), 6, part).select("doc_id", "start_word", "end_word", "longest").collect()}
    assert found == _brute(rows, 6)


def test_windows_of_one_class_differ_by_their_whole_hash():
    """Windows around a frequent passage share their class, and hashes may agree in any 32 bits: only equal ones are repeated."""
    hashes = np.array([7 << 32, (7 << 32) + 1, (8 << 32) + 1, 7 << 32], dtype=np.uint64)
    runs = substring._runs(np.full(4, 5, dtype=np.uint64), np.arange(4), np.arange(4), np.zeros(4, dtype=np.int64), hashes)
    names, doc, at = substring._windows(pa.Table.from_batches([runs]))
    assert doc.tolist() == [0, 1, 2, 3] and at.tolist() == [0] * 4
    assert len(set(names.tolist())) == 3 and names[0] == names[3]
    found = list(substring._repeated(100)(iter([runs])))
    assert sorted(i for b in found for i in b.column("doc_id").to_pylist()) == [0, 3]


@pytest.mark.parametrize("part_rows", [3, 100_000])
def test_all_but_first_occurrences_are_cut(spark, part_rows):
    """Against brute force over windows: a word goes where a window that holds it occurs in a document with a lesser id."""
    r = random.Random(8)
    shared = [tables.soup(100 + k, 30, 10**6) for k in range(4)]
    rows = []
    for i in range(40):
        words = tables.soup(i, 25, 10**6)
        for k in r.sample(range(4), r.randrange(3)):
            cut = r.randrange(10)
            words += shared[k][cut:] + tables.soup(1000 + 10 * i + k, r.randrange(5), 10**6)
        rows.append((i * 7 % 41, r.choice([" ", "\n", "  "]).join(words)))
    n, seen, expected = 12, {}, {}
    for i, text in rows:
        words = text.split()
        for k in range(len(words) - n + 1):
            seen.setdefault(tuple(words[k : k + n]), set()).add(i)
    for i, text in rows:
        words = text.split()
        gone = {j for k in range(len(words) - n + 1) if min(seen[tuple(words[k : k + n])]) < i for j in range(k, k + n)}
        expected[i] = [w for j, w in enumerate(words) if j not in gone]
    found = {x["doc_id"]: x["text"].split() for x in substring.drop_repeated_passages(tables.docs(spark, rows), n, part_rows).collect()}
    assert found == expected and sum(map(len, expected.values())) < sum(len(t.split()) for _, t in rows)
    assert substring.later_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in expected.items()], "doc_id long, text string"), n).isEmpty()


def test_cutting_irregular_rows(spark):
    d = tables.messy(spark).withColumnRenamed("key", "__sl_doc")
    out = substring.drop_repeated_passages(d)
    assert out.schema == d.schema
    left = sorted((str(x["doc_id"]), len((x["text"] or "").split())) for x in out.collect())
    full = sorted((str(x["doc_id"]), 0 if x["doc_id"] in (2, 3) else len((x["text"] or "").split())) for x in d.collect())
    assert left == full
    two = spark.createDataFrame([(1, " ".join(tables.soup(1, 60))), (2, " ".join(tables.soup(1, 60))), (2, "other")], "doc_id long, text string")
    assert sorted(map(tuple, substring.drop_repeated_passages(two).collect())) == sorted(map(tuple, two.collect()))
    assert substring.drop_repeated_passages(tables.empty(spark)).count() == 0
    assert substring.cut_words(b" a  b\tc d ", [(1, 3)]) == b" a  d " and substring.cut_words(b"a b", [(0, 2)]) == b""
