import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from stratalith import storage
from stratalith.operators import graph, history, membership, snapshot, vfs


def _classify(saves, now, keep):
    """(utc, id) newest first, by taking leading runs in turn."""
    import time

    rest, kept = list(saves), set()
    while rest and "all" in keep and rest[0][0] >= now - keep["all"]:
        kept.add(rest.pop(0)[1])
    for kind, part in (("dailies", "tm_yday"), ("monthlies", "tm_mon"), ("yearlies", "tm_year")):
        run = []
        while rest and kind in keep and rest[0][0] >= now - keep[kind]:
            run.append(rest.pop(0))
        for _, region in groupby(run, lambda s: getattr(time.gmtime(s[0]), part)):
            kept.add(next(region)[1])
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_saves_are_kept_as_by_leading_runs(spark, seed):
    r = random.Random(seed)
    now = 1_700_000_000
    saves = [(b, now - r.randrange(3 * 366 * 86400), f"{b}{i}") for b in "xy" for i in range(250)]
    saves += saves[:5]
    saves = [(b, u, f"{i:04}") for i, (b, u, _) in enumerate(saves)]
    day = 86400
    keep = {k: v for k, v in (("all", 30 * day), ("dailies", 200 * day), ("monthlies", 500 * day), ("yearlies", float("inf"))) if r.random() < 0.75} or {"all": day}
    df = spark.createDataFrame(saves, "branch string, utc long, id string")
    found = {x["id"] for x in history.classify_saves(df, now, keep).where("keep").collect()}
    expected = set()
    for b in "xy":
        expected |= _classify(sorted(((u, i) for c, u, i in saves if c == b), reverse=True), now, keep)
    assert found == expected
    with pytest.raises(ValueError):
        history.classify_saves(df, now, {})


def test_duplicate_names_count_down(spark):
    df = spark.createDataFrame([("b", 100_000, f"{i:02}") for i in range(11)] + [("b", 5, "zz")], "branch string, utc long, id string")
    found = {r["id"]: r["name"] for r in history.save_names(df).collect()}
    assert found["10"] == "1970-01-02-034640-10" and found["00"] == "1970-01-02-034640-00" and found["zz"] == "1970-01-01-000005"


def test_packs_roll_over(spark):
    df = spark.createDataFrame([("a", i, 40) for i in range(10)] + [("b", 0, 500), ("b", 1, 1)], "w string, n int, size long")
    found = {(r["w"], r["n"]): r["pack"] for r in history.pack_numbers(df, "n", "size", "w", 100, 4).collect()}
    assert [found["a", i] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3] and (found["b", 0], found["b", 1]) == (0, 1)


@pytest.mark.parametrize("seed", range(2))
def test_closure(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(20)]
    stop = {3, 7, 110}
    df = spark.createDataFrame(edges, "src long, dst long")
    start = spark.createDataFrame([(a, a) for a in (0, 5, 100)], "root long, node long")

    def walk(a, halt):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for u, v in edges:
                if u == x and x not in halt and v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    for halt in (set(), stop):
        table = spark.createDataFrame([(s,) for s in halt], "node long") if halt else None
        found = {tuple(x) for x in graph.closure(df, start, table).select("root", "node").collect()}
        assert found == {(a, n) for a in (0, 5, 100) for n in walk(a, halt)}


def test_chains_by_doubling_are_as_step_by_step(spark):
    r = random.Random(4)
    edges = [(i, i // 2 - r.randrange(3)) for i in range(1, 60)] + [(200 + i, 201 + i) for i in range(37)] + [(300, 301), (301, 302), (302, 300), (400, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    start = spark.createDataFrame([(a, a) for a in (59, 41, 200, 220, 300, 999)], "root long, node long")
    assert sorted(map(tuple, graph.chain_closure(df, start).collect())) == sorted(map(tuple, graph.closure(df, start).collect()))


def test_bloom_has_no_false_negative_and_few_false_positives(spark):
    import hashlib

    oid = lambda s: hashlib.sha1(s.encode()).hexdigest()
    members = spark.createDataFrame([(oid(f"m{i}"),) for i in range(200)], "oid string")
    probes = spark.createDataFrame([(oid(f"m{i}"),) for i in range(200)] + [(oid(f"p{i}"),) for i in range(2000)], "oid string")
    for k in (4, 5):
        bits, k = membership.bloom_shape(200, k)
        found = {r["oid"]: r["maybe"] for r in membership.bloom_probe(probes, membership.bloom_bits(members, bits, k), bits, k).collect()}
        assert all(found[oid(f"m{i}")] for i in range(200))
        assert sum(found[oid(f"p{i}")] for i in range(2000)) < 20
    assert membership.bloom_shape(10**6) == (21, 5) and membership.bloom_shape(1 << 28)[1] == 4 and membership.bloom_shape(0) == (0, 5)


def test_index_upkeep():
    assert membership.merge_plan([(f"i{n}", n) for n in range(4)]) == []
    assert membership.merge_plan([(f"i{n}", n) for n in range(7)]) == [["i0", "i1", "i2", "i3", "i4", "i5"]]
    assert membership.redundant([("big", 10, 1, ["a", "b"]), ("small", 3, 9, ["a"]), ("new", 4, 2, ["a", "c"])]) == ["small"]
    assert membership.prefix_bits(0) == 0 and membership.prefix_bits(205) == 0 and membership.prefix_bits(1000) == 2


def test_margin_of_few_ids(spark):
    ids = spark.createDataFrame([("f" * 40,), ("f" * 39 + "e",), ("8" + "0" * 39,), ("f" * 40,)], "oid string")
    assert membership.margin(ids).first()["bits"] == 159
    assert membership.margin(spark.createDataFrame([("00" + "f" * 38,)], "oid string")).first()["bits"] == 8
    assert membership.margin_predict(ids).first()["error"] == 1


def test_paths_are_reduced(spark):
    paths = ["/a/", "/a/b", "/a/b/", "/ab", "/c", "/c/d", "/e/f/", "/e/f/g/h", None, "/a/"]
    found = snapshot.reduce_paths(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted(r["path"] for r in found) == ["/a/", "/ab", "/c", "/c/d", "/e/f/"]


def test_resolution(spark):
    rows = [("/", "d", "/d", "dir", None), ("/d", "f", "/d/f", "file", None), ("/d", "up", "/d/up", "link", "../d/./f"), ("/", "abs", "/abs", "link", "/d"), ("/", "loop", "/loop", "link", "loop"), ("/", "dead", "/dead", "link", "nowhere")]
    entries = spark.createDataFrame(rows, "parent string, name string, node string, kind string, target string")
    wanted = {"/": ("/", None), "/d/f": ("/d/f", None), "//d/../d/./f": ("/d/f", None), "/d/up": ("/d/f", None), "/abs/up": ("/d/f", None), "/loop": (None, "ELOOP"), "/dead": (None, "ENOENT"), "/d/f/x": (None, "ENOTDIR"), "/../..": ("/", None), "/no": (None, "ENOENT")}
    found = {r["path"]: (r["node"], r["error"]) for r in vfs.resolve(entries, spark.createDataFrame([(p,) for p in wanted], "path string")).collect()}
    assert found == wanted


def test_empty_tables(spark):
    none = lambda ddl: spark.createDataFrame([], ddl)
    ids = none("oid string")
    assert membership.missing(ids, ids).count() == 0 and membership.fanout(ids).where("n <> 0").count() == 0
    assert membership.margin(ids).first()["bits"] is None
    assert graph.reachable(none("src long, dst long"), none("node long")).count() == 0
    assert vfs.directory_ids(none("path string, mode int, oid string")).count() == 0
    assert snapshot.reduce_paths(none("path string")).count() == 0
    assert history.save_names(none("branch string, utc long, id string")).count() == 0


def test_device_and_order_filters(spark):
    rows = spark.createDataFrame([(1, False, "c", "l", 1), (2, True, "b", "l", 2), (2, False, "b", "l", 3)], "dev int, is_mount boolean, name string, listing string, n int")
    assert snapshot.same_device(rows, F.lit(1)).count() == 2
    assert [r["n"] for r in snapshot.order_violations(rows, "n").collect()] == [3]


def test_links_are_of_one_owner(spark):
    rows = [("/a", 1, None, b"x"), ("/b", 1, None, b"x"), ("/c", 2, None, b"x"), ("/d", 1, "g", b"x"), ("/e", 1, None, None), ("/f", 1, None, None)]
    files = spark.createDataFrame([(p, "/t", "o", 1, 1, 33188, *r) for p, *r in rows], "path string, target string, oid string, mtime long, ctime long, mode int, uid int, group string, linux_xattr binary")
    assert {tuple(r) for r in snapshot.restore_links(files).collect()} == {("/b", "/a"), ("/f", "/e")}


def _fast_forwards(parents, requests):
    def ancestor(a, b):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for c, p in parents:
                if c == x and p is not None and p not in seen:
                    seen.add(p)
                    todo.append(p)
        return b in seen

    return sorted((s or "", d or "", d is None or (s is not None and ancestor(s, d))) for s, d in requests)


@pytest.mark.parametrize("kind", ["forks and cycles", "merges"])
def test_fast_forwards_of_any_history(spark, kind):
    parents = [(f"a{i}", f"a{i - 1}") for i in range(1, 6)] + [("b1", "b0"), ("c1", None), (None, "a3"), ("a4", "a3")]
    parents += [("b1", "a2"), ("d", "b1")] if kind == "merges" else [("f1", "f0"), ("f2", "f1"), ("f3", "f1"), ("f4", "f2"), ("x0", "x1"), ("x1", "x2"), ("x2", "x0"), ("y", "x1"), ("z", "z"), ("z2", "z")]
    nodes = sorted({x for e in parents for x in e if x}) + ["stray"]
    requests = [(s, d) for s in nodes for d in nodes] + [("a3", None), (None, "a3"), (None, None), ("a5", "a2"), ("a5", "a2")]
    links = spark.createDataFrame(parents, "child string, parent string")
    found = history.fast_forwards(links, spark.createDataFrame(requests, "src string, dest string")).collect()
    assert sorted((x["src"] or "", x["dest"] or "", x["allowed"]) for x in found) == _fast_forwards(parents, requests)
    commits = [(n, i % 2) for i, n in enumerate(nodes)]
    within = history.fast_forwards_within(links, spark.createDataFrame(commits, "oid string, half int"), "half").collect()
    assert sorted((x["src"], x["dest"], x["allowed"]) for x in within) == _fast_forwards(parents, [(a, b) for a, i in commits for b, j in commits if i == j])


def test_fast_forwards_write_in_proportion_to_the_commits(spark, monkeypatch):
    rows = []

    def counting(df, what):
        rows.append((what, df.count()))
        return storage.written(df, what)

    for module in (graph, history):
        monkeypatch.setattr(module, "written", counting)
    n = 120
    links = spark.createDataFrame([(i, i - 1) for i in range(1, n)], "child long, parent long")
    pairs = spark.createDataFrame([(a, b) for a in range(n) for b in range(n)], "src long, dest long")
    assert history.fast_forwards(links, pairs).where(F.col("allowed") == (F.col("dest") <= F.col("src"))).count() == n * n
    assert rows and all(k < n for _, k in rows), rows
