import random

import pytest

from stratalith.llm import exact
from tests.llm import tables


def _brute(rows):
    groups = {}
    for doc_id, text in rows:
        if doc_id is not None and text is not None:
            groups.setdefault(text, []).append(doc_id)
    return sorted((i, min(ids)) for ids in groups.values() for i in sorted(ids)[1:])


@pytest.mark.parametrize("table_bytes", [1, 2000, 192 << 20])
@pytest.mark.parametrize("map_bytes", [1, 48 << 20])
def test_against_brute_force_with_spilling(spark, table_bytes, map_bytes):
    r = random.Random(3)
    rows = [(r.randrange(1000), " ".join(tables.soup(r.randrange(40), 30))) for _ in range(300)]
    found = exact.exact_duplicates(tables.docs(spark, rows), table_bytes, map_bytes).collect()
    assert sorted((x["doc_id"], x["keep_id"]) for x in found) == _brute(rows)


def test_equal_hashes_are_told_apart(tmp_path):
    from array import array

    records = [(7, b"a", [1]), (7, b"b", [2]), (7, b"a", [3]), (7, b"c", [4, 9, 8]), (7, b"b", [5]), (7, b"c", [6, 4])]
    for budget in (1, 300, 1 << 20):
        found = {c: sorted(ids) for _, _, c, ids in exact.grace(iter((h, 0, c, array("q", i)) for h, c, i in records), budget, f"file://{tmp_path}")}
        assert found == {b"a": [1, 3], b"b": [2, 5], b"c": [4, 4, 6, 8, 9]}
    assert not list(tmp_path.glob("*"))


@pytest.mark.parametrize("map_bytes", [1, 3000, 48 << 20])
def test_a_text_that_a_third_of_all_rows_hold(spark, map_bytes):
    """Ids travel singly: no record has more of them than there are map tasks' tables."""
    r = random.Random(5)
    rows = [(r.randrange(2000), "hot" if i % 3 == 0 else " ".join(tables.soup(i % 50, 20))) for i in range(900)]
    d = tables.docs(spark, rows).repartition(5)
    assert sorted((x["doc_id"], x["keep_id"]) for x in exact.exact_duplicates(d, 1 << 20, map_bytes).collect()) == _brute(rows)
    kept = [x["text"] for x in exact.drop_exact_duplicates(d, 1 << 20, map_bytes).collect()]
    assert sorted(kept) == sorted({t for _, t in rows})


def test_reserved_names_are_free(spark):
    d = tables.messy(spark).withColumnRenamed("key", "__sl_doc_id").withColumnRenamed("node", "__SL_HASH")
    kept = exact.drop_exact_duplicates(d)
    assert kept.schema == d.schema and kept.count() == 11


def test_irregular_rows(spark):
    d = tables.messy(spark)
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact.exact_duplicates(d).collect()) == [(2, 1), (3, 1), (3, 1), (6, 5)]
    kept = exact.drop_exact_duplicates(d)
    assert kept.schema == d.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "None", "1", "4", "5", "7", "8", "9", "10", "11", "12"])


def test_repeated_rows_keep_one(spark):
    d = tables.docs(spark, [(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "d")])
    assert [(r["doc_id"], r["keep_id"]) for r in exact.exact_duplicates(d).collect()] == [(1, 1), (1, 1)]
    assert sorted((r["doc_id"], r["text"]) for r in exact.drop_exact_duplicates(d).collect()) == [(1, "a"), (2, "b"), (3, "c"), (3, "d")]


def test_bytes_decide(spark):
    d = tables.docs(spark, [(1, "é"), (2, "é"), (3, "a "), (4, "a")])
    assert exact.exact_duplicates(d).count() == 0


def test_empty_table(spark):
    assert exact.exact_duplicates(tables.empty(spark)).count() == 0
    assert exact.drop_exact_duplicates(tables.empty(spark)).count() == 0
