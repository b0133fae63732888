import os

import pytest
from pyspark.sql import functions as F

from stratalith.plans.repository import Repository
from stratalith.sources import files, packidx
from stratalith.streaming import ingest


def _files(spark, contents):
    return spark.createDataFrame([(p, 0o100644, 7, None if c is None else bytearray(c)) for p, c in contents.items()], "path string, mode int, mtime long, content binary")


def _restored(repo, oid):
    return {r["path"]: bytes(r["content"]) for r in repo.restore(oid).collect()}


def test_a_repository_from_save_to_collection(spark, tmp_path):
    repo = Repository(spark, f"{tmp_path}/r")
    big = os.urandom(100_000)
    one = {"/a/x": b"hello", "/a/big": big, "/b": b"", "/c/d/e": b"deep"}
    first = repo.save("main", _files(spark, one), 1000, "first")
    assert _restored(repo, first) == one
    objects = repo.table("objects").count()
    two = one | {"/a/x": b"changed"}
    second = repo.save("main", _files(spark, two), 2000)
    assert _restored(repo, second) == two and _restored(repo, first) == one
    # a blob, the trees of /a and of the root, and a commit
    assert repo.table("objects").count() == objects + 4
    assert [r["oid"] for r in repo.log("main").orderBy("place").collect()] == [second, first]
    assert repo.fsck().count() == 0
    with pytest.raises(ValueError):
        repo.update_ref("refs/heads/main", first, first)

    other = Repository(spark, f"{tmp_path}/o")
    assert other.get(repo, "ff", "refs/heads/main", "refs/heads/copy") == second
    assert _restored(other, second) == two and other.fsck().count() == 0
    picked = other.get(repo, "pick", "refs/heads/main", "refs/heads/picked")
    assert picked != second and _restored(other, picked) == two
    appended = other.get(repo, "append", "refs/heads/main", "refs/heads/picked")
    assert [r["oid"] for r in other.log("picked").orderBy("depth").collect()][0] == appended and other.log("picked").count() == 3
    with pytest.raises(ValueError):
        other.get(repo, "ff", "refs/heads/main", "refs/heads/picked")

    assert repo.prune("main", 2500, {"all": 1000}) == [first]
    tip = repo.ref("refs/heads/main")
    assert _restored(repo, tip) == two
    plan = {r["decision"] for r in repo.gc(0).collect()}
    assert plan <= {"keep", "rewrite", "delete"}
    assert _restored(repo, tip) == two and repo.fsck().count() == 0
    assert repo.table("saves").count() == 1
    repo.tag("t", tip)
    repo.remove_branch("main")
    assert repo.ref("refs/heads/main") is None and repo.ref("refs/tags/t") == tip


def test_scan(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/f").write_bytes(b"12345")
    (tmp_path / "g").write_bytes(b"")
    found = {r["path"].removeprefix(str(tmp_path)): r["size"] for r in files.scan_tree(spark, str(tmp_path)).collect()}
    assert found == {"/": 0, "/d/": 0, "/d/e/": 0, "/d/e/f": 5, "/g": 0}
    assert {r["path"].removeprefix(str(tmp_path)): bytes(r["content"]) for r in files.file_contents(spark, str(tmp_path)).collect()} == {"/d/e/f": b"12345", "/g": b""}


def test_random_bytes_depend_on_the_seed(spark):
    a, b, c = (b"".join(bytes(r["content"]) for r in files.random_bytes(spark, 2500, s, 1000).orderBy("block").collect()) for s in (1, 1, 2))
    assert len(a) == 2500 and a == b != c


def test_logs(spark):
    lines = spark.createDataFrame([(" full 19700101T000010Z 1",), ("inc 19700102T000000Z 3",), ("other 19700102T000000Z",)], "value string")
    assert [tuple(r) for r in files.backup_times(lines).collect()] == [("full", 10), ("inc", 86400)]
    folders = spark.createDataFrame([("/s1/b/", 5), ("/s1/", 9), ("/s2/b/", 7), ("/s1/b/f", 99)], "path string, ctime long")
    assert sorted(map(tuple, files.snapshot_times(folders).collect())) == [("s1", "b", 5), ("s2", "b", 7)]


def test_pack_indexes(spark, tmp_path):
    entries = [(bytes([i]) * 20, i * 3, i if i % 2 else (1 << 31) + i) for i in range(5)]
    (tmp_path / "p1.idx").write_bytes(packidx.encode_index(entries))
    (tmp_path / "p2.idx").write_bytes(packidx.encode_index([]))
    found = packidx.read_indexes(spark, str(tmp_path)).orderBy("oid").collect()
    assert [(bytes.fromhex(r["oid"]), r["crc"], r["ofs"]) for r in found] == entries and {r["pack"] for r in found} == {"p1"}
    with pytest.raises(ValueError):
        packidx.decode_index(b"nothing")


def test_ingest_twice_adds_nothing(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "oid string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    for k in range(2):
        stream = ingest.stream_table(spark, f"{tmp_path}/in/1")
        ingest.ingest_objects(stream, f"{tmp_path}/store", f"{tmp_path}/check{k}").awaitTermination()
    assert sorted(r["oid"] for r in spark.read.parquet(f"{tmp_path}/store").collect()) == ["a", "b"]


def test_frames(spark):
    rows = spark.createDataFrame([(1, "o", bytearray(b"abcdefg")), (2, "e", bytearray(b"")), (3, "o", None)], "n long, ch string, p binary")
    framed = ingest.frames(rows, F.col("ch"), "n", "p", 3)
    assert sorted((r["ord"], r["part"], bytes(r["payload"])) for r in framed.collect()) == [(1, 0, b"abc"), (1, 1, b"def"), (1, 2, b"g"), (2, 0, b"")]
    assert sorted((r["channel"], r["ord"], bytes(r["payload"])) for r in ingest.unframe(framed).collect()) == [("e", 2, b""), ("o", 1, b"abcdefg")]


def test_listing_updates(spark):
    old = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 3, True)], "name string, size int, valid boolean")
    new = spark.createDataFrame([("b", 5, 1, False), ("b", 6, 2, False), ("c", 3, 1, True), ("d", 9, 1, False)], "name string, size int, version long, deleted boolean")
    assert sorted(map(tuple, ingest.update_listing(old, new).collect())) == [("a", 1, True), ("b", 6, False), ("d", 9, False)]


def test_records_split_across_batches(spark, tmp_path):
    import random

    from stratalith.operators.dirsplit import feed_all

    r = random.Random(6)
    names = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 60))) for _ in range(900)]
    for k in range(3):
        part = [("k", i, n) for i, n in enumerate(names)][300 * k : 300 * k + 300]
        spark.createDataFrame(part, "key string, n long, rec string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.split_records(ingest.stream_table(spark, f"{tmp_path}/in"), "key", "n", "rec")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = [x["splits"] for x in spark.read.parquet(f"{tmp_path}/out").orderBy("ord").collect()]
    assert found == [hit for hit, _ in feed_all(n.encode() for n in names)]


def test_rewriting_and_damage(spark, tmp_path):
    repo, new = Repository(spark, f"{tmp_path}/r"), Repository(spark, f"{tmp_path}/n")
    contents = {"/a": os.urandom(90_000), "/b": b"small", "/e": b""}
    oid = repo.save("main", _files(spark, contents), 1000)
    tip = new.rewrite(repo, "refs/heads/main", "main", bits=14)
    assert _restored(new, tip) == contents and tip != oid
    lost = repo.table("chunks").where("len > 1000").select("oid").first()["oid"]
    repo._replace(objects=repo.table("objects").where(F.col("oid") != lost))
    assert [r["path"] for r in repo.damaged(oid).collect()] == ["/a"] and repo.fsck().count() == 1
    repaired = _restored(new, new.rewrite(repo, "refs/heads/main", "repaired"))
    assert repaired["/b"] == b"small" and repaired["/a"].startswith(b"A part of this file was missing")


def test_a_listing_follows_events(spark, tmp_path):
    spark.createDataFrame([("a", 1, True), ("b", 2, True)], "name string, size int, valid boolean").write.parquet(f"{tmp_path}/list/v-1")
    for k, row in enumerate([("b", 5, 1, False), ("a", 1, 2, True)]):
        spark.createDataFrame([row], "name string, size int, version long, deleted boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.follow_listing(ingest.stream_table(spark, f"{tmp_path}/in", 1), f"{tmp_path}/list", f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/list/v1").collect())) == [("b", 5, False)]


def test_packs_and_their_indexes(spark, tmp_path):
    import hashlib

    from stratalith.sources import packs

    contents = [("blob", b"hello\n"), ("tree", b""), ("commit", b"x" * 100_000), ("blob", os.urandom(5000)), ("tag", b"t")]
    (tmp_path / "a.pack").write_bytes(packs.encode_pack(contents))
    (tmp_path / "b.pack").write_bytes(packs.encode_pack([]))
    rows = packs.read_packs(spark, str(tmp_path)).orderBy("ofs").collect()
    assert [(r["kind"], bytes(r["content"])) for r in rows] == contents and {r["pack"] for r in rows} == {"a"}
    assert rows[0]["oid"] == "ce013625030ba8dba906f756967f9e9ca394464a" and rows[1]["oid"] == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    skipped = packs.read_packs(spark, str(tmp_path), skip_blobs=True).orderBy("ofs").collect()
    assert [r["oid"] for r in skipped] == [r["oid"] if r["kind"] != "blob" else None for r in rows]
    raw = bytearray((tmp_path / "a.pack").read_bytes())
    raw[40] ^= 1
    for broken in (bytes(raw), b"PACK", bytes(raw)[:-30]):
        with pytest.raises(ValueError):
            list(packs.decode_pack(broken))

    ids = sorted((hashlib.sha1(str(i).encode()).digest(), i * 7) for i in range(300))
    counts = [sum(x[0][0] <= b for x in ids) for b in range(256)]
    first = b"".join(c.to_bytes(4, "big") for c in counts) + b"".join(o.to_bytes(4, "big") + i for i, o in ids)
    (tmp_path / "v1.idx").write_bytes(first + bytes(40))
    found = packidx.read_indexes(spark, str(tmp_path)).orderBy("oid").collect()
    assert [(bytes.fromhex(r["oid"]), r["ofs"]) for r in found] == ids and {r["crc"] for r in found} == {-1}


def test_stored_indexes(spark, tmp_path):
    import hashlib

    from stratalith.sources import indexes

    oid = lambda n: hashlib.sha1(str(n).encode()).hexdigest()
    index = spark.createDataFrame([(oid(i), f"p{i % 3}") for i in range(300)], "oid string, pack string")
    indexes.write_merged(index, f"{tmp_path}/m")
    have = index.select("pack").distinct()
    assert sorted(map(tuple, indexes.read_merged(spark, f"{tmp_path}/m", have).collect())) == sorted((oid(i), f"p{i % 3}", i % 3) for i in range(300))
    assert indexes.read_merged(spark, f"{tmp_path}/m", have.where("pack <> 'p1'"), ignore_missing=True) is None
    with pytest.raises(ValueError, match="p1"):
        indexes.read_merged(spark, f"{tmp_path}/m", have.where("pack <> 'p1'"))

    at = f"{tmp_path}/f"
    first = index.where("pack <> 'p2'")
    assert indexes.filter_shape(spark, at) is None and indexes.keep_filter(first, at) == "regenerate"
    assert indexes.keep_filter(first, at) == "nothing" and not indexes.worth_asking(spark, at, 3)
    assert indexes.keep_filter(index, at) == "add" and indexes.worth_asking(spark, at, 3)
    assert indexes.filter_shape(spark, at)["entries"] == 300
    probes = spark.createDataFrame([(oid(i),) for i in range(1300)], "oid string")
    maybe = {r["oid"] for r in indexes.probe_filter(probes, at).where("maybe").collect()}
    assert {oid(i) for i in range(300)} <= maybe and len(maybe) < 330
    assert indexes.keep_filter(index.where("pack <> 'p0'"), at) == "regenerate" and indexes.filter_shape(spark, at)["entries"] == 200
    indexes.ruin_filter(spark, at)
    assert indexes.probe_filter(probes, at).where("maybe").count() == 0
    indexes.clear_filter(spark, at)
    assert indexes.filter_shape(spark, at) is None


def test_scan_with_exclusions_links_and_unreadable_folders(spark, tmp_path, monkeypatch):
    for name in ("keep/a", "drop/b", "deep/skip/c", "deep/d.tmp", "deep/e"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "link").symlink_to("keep/a")
    rows = files.scan_tree(spark, str(tmp_path), exclude=[f"{tmp_path}/drop/"], exclude_rx=["/skip/$", r"\.tmp$"]).collect()
    found = {r["path"].removeprefix(str(tmp_path)): r for r in rows}
    assert sorted(found) == ["/", "/deep/", "/deep/e", "/keep/", "/keep/a", "/link"]
    assert found["/link"]["target"] == "keep/a" and found["/keep/a"]["target"] is None
    assert found["/keep/a"]["user"] is not None and found["/keep/a"]["xattrs"] == {} and found["/"]["error"] is None

    reader = files._TreeReader({"path": str(tmp_path)})
    listed = os.listdir

    def refuse(path):
        if str(path).endswith("keep"):
            raise PermissionError("no")
        return listed(path)

    monkeypatch.setattr(os, "listdir", refuse)
    shown = {row[0].removeprefix(str(tmp_path)): row[-1] for part in reader.partitions() for row in reader.read(part)}
    assert shown["/keep/"] == "no" and "/keep/a" not in shown and "/deep/e" in shown


def test_restoring_to_files(spark, tmp_path):
    repo = Repository(spark, f"{tmp_path}/r")
    hole = b"begin" + bytes(100_000) + b"end" + bytes(3000)
    contents = {"/a/x": b"hello", "/a/y/hole": hole, "/empty": b"", "/zeros": bytes(4096), "/skip/z": b"no"}
    oid = repo.save("main", _files(spark, contents), 1000)
    for sparse in (False, True):
        target = tmp_path / f"t{sparse}"
        done = {r["path"]: r["bytes"] for r in repo.restore_to(oid, str(target), sparse=sparse, exclude=["^/skip/"]).collect()}
        wanted = {p: c for p, c in contents.items() if not p.startswith("/skip")}
        assert done == {p: len(c) for p, c in wanted.items()}
        assert {p: (target / p[1:]).read_bytes() for p in wanted} == wanted and not (target / "skip").exists()
        assert oct((target / "a/x").stat().st_mode & 0o777) == "0o644" and (target / "a/x").stat().st_mtime_ns == 7
    assert (tmp_path / "tTrue/a/y/hole").stat().st_blocks < (tmp_path / "tFalse/a/y/hole").stat().st_blocks
    assert not list(tmp_path.glob("t*/**/*.part"))


def test_methods_of_get_and_what_they_refuse(spark, tmp_path):
    repo, other = Repository(spark, f"{tmp_path}/r"), Repository(spark, f"{tmp_path}/o")
    assert repo.init() == repo.init() and repo.init(bits="13") == repo.init() and len(repo.init()) == 32
    assert other.init(bits="13") != repo.init() and repo.config("bits") == "13" and repo.config("none") is None
    first = repo.save("main", _files(spark, {"/a": b"one"}), 1000, "m1", "Ann <ann@x>")
    repo.save("main", _files(spark, {"/a": b"two"}), 2000, "m2", "Bob <bob@x>")
    with pytest.raises(ValueError, match="none of"):
        other.get(repo, "copy", "refs/heads/main", "refs/heads/x")
    with pytest.raises(ValueError, match="no destination"):
        other.get(repo, "unnamed", "refs/heads/main", "refs/heads/x")
    with pytest.raises(ValueError, match="does not exist"):
        other.get(repo, "ff", "refs/heads/none", "refs/heads/x")
    assert other.get(repo, "unnamed", first) == first and other.table("refs").isEmpty() and other.fsck().isEmpty()
    other.tag("t", first)
    with pytest.raises(ValueError, match="force-pick"):
        other.get(repo, "pick", "refs/heads/main", "refs/tags/t")
    forced = other.get(repo, "force-pick", "refs/heads/main", "refs/tags/t")
    assert other.ref("refs/tags/t") == forced != first
    saved = other.table("saves").where(F.col("oid") == forced).first()
    assert (saved["author"], saved["utc"], saved["message"], saved["parent"]) == ("Bob <bob@x>", 2000, "m2", first)
    with pytest.raises(ValueError, match="exists"):
        other.tag("t", first)
    other.tag("t", first, force=True)
    other.delete_tag("t")
    with pytest.raises(ValueError, match="does not exist"):
        other.delete_tag("t")
    other.delete_tag("t", force=True)
    tree = repo.table("saves").where(F.col("oid") == first).first()["tree"]
    appended = other.get(repo, "append", tree, "refs/heads/trees")
    assert other.table("saves").where(F.col("oid") == appended).first()["tree"] == tree
    with pytest.raises(ValueError, match="takes a commit"):
        other.get(repo, "pick", tree, "refs/heads/trees")
    other.init(bits="14")
    with pytest.raises(ValueError, match="differently"):
        other.get(repo, "ff", "refs/heads/main", "refs/heads/x")
    # Another writer's generation makes a stale one fail; a claim that nobody finished can be removed.
    number, versions = repo.generation()
    repo.tag("now", first)
    with pytest.raises(ValueError, match="another writer"):
        repo._publish(number + 1, versions)
    with pytest.raises(ValueError, match="replaced"):
        repo.update_ref("refs/heads/main", first, repo.ref("refs/heads/main"), {"objects": 99})
    fs, claim = repo._fs(f"{repo.folder}/generations/{repo.generation()[0] + 1:09d}.claim")
    fs.createNewFile(claim)
    with pytest.raises(ValueError, match="unlock"):
        repo.tag("later", first)
    repo.unlock()
    repo.tag("later", first)

    spoiled = repo.table("objects").withColumn("content", F.when(F.col("oid") == tree, F.lit(b"x")).otherwise(F.col("content")))
    repo._replace(objects=spoiled)
    assert [tuple(r) for r in repo.fsck().collect()] == [(tree, "content")]


def test_the_view_of_a_store(spark, tmp_path):
    repo = Repository(spark, f"{tmp_path}/r")
    first = repo.save("main", _files(spark, {"/d/a": b"one", "/b": b"12"}), 1000)
    second = repo.save("main", _files(spark, {"/b": b"1"}), 1000)
    repo.tag("t", first)
    rows = {(r["parent"], r["name"]): r for r in repo.view().collect()}
    assert {k: r["kind"] for k, r in rows.items()} == {
        ("/", ".tag"): "tags", ("/", "main"): "branch", ("/.tag", "t"): "tag", ("/main", "latest"): "latest",
        ("/main", "1970-01-01-001640-1"): "save", ("/main", "1970-01-01-001640-0"): "save",
        ("/main/1970-01-01-001640-0", "d"): "dir", ("/main/1970-01-01-001640-0/d", "a"): "file", ("/main/1970-01-01-001640-0", "b"): "file", ("/main/1970-01-01-001640-1", "b"): "file",
    }
    assert rows["/main", "latest"]["oid"] == second and rows["/main", "1970-01-01-001640-0"]["oid"] == first
    assert rows["/main/1970-01-01-001640-0/d", "a"]["size"] == 3


def test_rewriting_again_uses_the_memo(spark, tmp_path):
    repo, new = Repository(spark, f"{tmp_path}/r"), Repository(spark, f"{tmp_path}/n")
    repo.save("main", _files(spark, {"/a": b"one"}), 1000, author="Ann <ann@x>")
    tip = new.rewrite(repo, "refs/heads/main", "main", bits=14)
    new.remove_branch("main")
    saves = new.table("saves").count()
    assert new.rewrite(repo, "refs/heads/main", "main", bits=14) == tip and new.table("saves").count() == saves
    assert new.table("saves").first()["author"] == "Ann <ann@x>"


def test_bytes_split_across_batches(spark, tmp_path):
    import random

    from stratalith.operators import chunking

    r = random.Random(3)
    whole = {"a": r.randbytes(150_000), "b": bytes(90_000) + r.randbytes(40_000), "c": b"", "d": b"short"}
    pieces = []
    for key, content in whole.items():
        at = 0
        while at < len(content):
            n = r.choice([1, 63, 5000, 40_000])
            pieces.append((key, at, bytearray(content[at : at + n]), at + n >= len(content)))
            at += n
    pieces.sort(key=lambda p: p[1])
    for k in range(3):
        part = pieces[len(pieces) * k // 3 : len(pieces) * (k + 1) // 3]
        spark.createDataFrame(part, "key string, n long, content binary, last boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.split_bytes(ingest.stream_table(spark, f"{tmp_path}/in"), "key", "n", "content", "last")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("key", "seq", "ofs", "len", "level", "oid").collect()))
    keys = sorted(whole)
    rows = spark.createDataFrame([(i, bytearray(whole[k])) for i, k in enumerate(keys)], "i long, content binary")
    expected = sorted((keys[x["i"]], x["seq"], x["ofs"], x["len"], x["level"], x["oid"]) for x in chunking.chunks(rows, "i", F.col("content")).collect())
    assert found == expected


def test_fetching_many_at_once(spark, tmp_path):
    repo = Repository(spark, f"{tmp_path}/r")
    oid = repo.save("main", _files(spark, {"/a": b"one"}), 1000)
    repo.tag("t", oid)
    asked = spark.createDataFrame([(oid,), ("00" * 20,), (oid,)], "oid string")
    assert {r["oid"]: r["kind"] for r in repo.fetch(asked).collect()} == {oid: "commit", "00" * 20: None}
    assert repo.fetch_ref("refs/tags/t").first()["oid"] == oid and repo.refs("refs/tags/").count() == 1
    names = spark.createDataFrame([("main",), (oid,), ("none",)], "name string")
    assert {r["name"]: r["oid"] for r in repo.resolve(names).collect()} == {"main": oid, oid: oid, "none": None}


def test_paths_at_random_depend_on_the_seed(spark):
    from stratalith.sources import faults

    a, b, c = ([r["path"] for r in faults.random_paths(spark, 50, s).orderBy("id").collect()] for s in (1, 1, 2))
    assert a == b != c and all(1 <= p.count("/") <= 4 for p in a)


def test_archives_of_metadata(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/f").write_bytes(b"123")
    (tmp_path / "l").symlink_to("d/f")
    files.archive_metadata(files.scan_tree(spark, str(tmp_path))).write.parquet(f"{tmp_path}.archive")
    rows = {r["path"].removeprefix(str(tmp_path)[1:]): r for r in files.read_metadata(spark.read.parquet(f"{tmp_path}.archive")).collect()}
    assert sorted(rows) == ["/", "/d/", "/d/f", "/l"]
    assert rows["/d/f"]["size"] == 3 and rows["/d/f"]["mtime"] == (tmp_path / "d/f").stat().st_mtime_ns and rows["/l"]["symlink"] == "d/f"


def test_walking_a_save(spark, tmp_path):
    repo = Repository(spark, f"{tmp_path}/r")
    oid = repo.save("main", _files(spark, {"/a/x": b"1", "/a/y": b"2", "/b/z": b"3"}), 1000)
    known = repo.table("files").where("path = '/a/y'").select("oid")
    assert [r["path"] for r in repo.walk(oid, ["^/b/"], known).collect()] == ["/a/x"] and repo.walk(oid).count() == 3
