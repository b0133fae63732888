import random

from stratalith.operators import dirsplit


def _trie_rule(names):
    out = []
    for n in names:
        most = 1
        for o in names:
            if o.startswith(n) or n.startswith(o):
                continue
            k = next(i for i, (x, y) in enumerate(zip(n, o)) if x != y)  # noqa: B905
            most = max(most, k + 1)
        least = 3 if n.startswith(b"..") else 2 if n.startswith(b".") else 1
        out.append(n[: max(most, least)])
    return out


def test_abbreviations_by_comparing_all_pairs():
    r = random.Random(2)
    for _ in range(400):
        names = list({bytes(r.choice(b"ab.") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 9))} - {b".", b".."})
        assert dirsplit.abbreviate(names) == _trie_rule(names)


def test_records_split_as_one_stream():
    """A window runs on across records: the groups do not depend on how the bytes before a cut fall into records."""
    r = random.Random(3)
    records = [r.randbytes(r.randrange(1, 90)) for _ in range(3000)]
    found = dirsplit.feed_all(iter(records))
    cuts = [i for i, (hit, bits) in enumerate(found) if hit]
    assert cuts
    again = dirsplit.feed_all(iter(records[cuts[0] + 1 :]))
    assert [hit for hit, _ in again] == [hit for hit, _ in found[cuts[0] + 1 :]] or sum(map(len, records)) > 32768
    assert all(bits is None or bits >= 13 for _, bits in found)


def test_forced_split():
    s = dirsplit.RecordSplitter()
    assert s.feed(bytes(32_768)) == (False, None)
    assert s.feed(b"\0") == (True, None)
    assert s.size == 0


def test_groups_have_several_names(spark):
    rows = [("d", f"{n:x}-{n * 7919}") for n in range(6000)] + [("e", "one"), ("f", None)]
    found = dirsplit.split_directories(spark.createDataFrame(rows, "d string, n string"), "d", "n").collect()
    leaf = [r for r in found if r["directory"] == "d" and r["level"] == 0]
    assert sum(r["members"] for r in leaf) == 6000
    assert all(r["members"] > 1 for r in leaf[:-1])
    tops = {r["directory"]: r for r in found if r["level"] == max(x["level"] for x in found if x["directory"] == r["directory"])}
    assert tops["d"]["first"] == min(n for d, n in rows if d == "d") and tops["d"]["last"] == max(n for d, n in rows if d == "d")
    assert tops["e"]["members"] == 1 and "f" not in tops


def test_flattening(spark):
    nodes = [("d", 1, "top", "x", "A", "a1"), ("d", 1, "top", "y", "B", "b1"), ("d", 0, "A", "n1", None, "o1"), ("d", 0, "A", "n2", None, "o2"), ("d", 0, "B", "n3", None, "o3"), ("e", 0, "E", "m", None, "o4")]
    df = spark.createDataFrame(nodes, "dir string, level int, node string, name string, child string, oid string")
    assert sorted(map(tuple, dirsplit.flatten_splits(df, 1).collect())) == [("d", "n1", "o1"), ("d", "n2", "o2"), ("d", "n3", "o3"), ("e", "m", "o4")]
