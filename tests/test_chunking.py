import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.operators import chunking as C


def naive(data, bits, fan_bits):
    """Byte at a time, from the definition of the checksum."""
    m1, m2 = C._masks(bits)
    out, start = [], 0
    while start < len(data):
        window, s1, s2, p, level = [0] * 64, 64 * 31, 64 * 63 * 31, start, None
        while p < len(data):
            gone = window.pop(0)
            window.append(data[p])
            s1 += data[p] - gone
            s2 += s1 - 64 * (gone + 31)
            p += 1
            if s2 & m2 == m2 and s1 & m1 == m1:
                rest, ones = (((s1 << 16) | (s2 & 0xFFFF)) & 0xFFFFFFFF) >> bits >> 1, 0
                while rest & 1:
                    rest, ones = rest >> 1, ones + 1
                level = ones // fan_bits
                break
            if p - start == 1 << (bits + 2):
                break
        out.append((p, level or 0))
        start = p
    return out


def _contents():
    r = random.Random(1)
    texts = ["".join(f"{i} " for i in range(30_000)).encode(), bytes(70_000), r.randbytes(150_000), b"", b"x", r.randbytes(63), r.randbytes(64), b"ab" * 40_000, r.randbytes(32_768), "é漢🙂".encode() * 9000]
    return texts


@pytest.mark.parametrize(("bits", "fan_bits"), [(13, 4), (13, 1), (14, 2), (17, 4)])
def test_against_byte_at_a_time(bits, fan_bits):
    contents = _contents()
    bounds = np.r_[0, np.cumsum([len(c) for c in contents])]
    owner, end, level = C.cut(np.frombuffer(b"".join(contents), dtype=np.uint8), bounds, bits, fan_bits)
    found = {}
    for o, e, x in zip(owner.tolist(), end.tolist(), level.tolist(), strict=True):
        found.setdefault(o, []).append((e - int(bounds[o]), x))
    for i, c in enumerate(contents):
        assert found.get(i, []) == naive(c, bits, fan_bits)


def test_parameters():
    with pytest.raises(ValueError):
        C.cut(np.zeros(1, dtype=np.uint8), np.array([0, 1]), 12)
    with pytest.raises(ValueError):
        C.cut(np.zeros(1, dtype=np.uint8), np.array([0, 1]), 13, 0)


def test_ids_are_those_of_the_public_object_format():
    assert C.blob_id(b"hello\n") == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert C.tree_id([]) == "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
    body = b"100644 a\0" + bytes(20) + b"40000 a.d\0" + bytes(20)
    assert C.tree_id([(0o040000, b"a.d", "00" * 20), (0o100644, b"a", "00" * 20)]) == hashlib.sha1(b"tree %d\0" % len(body) + body).hexdigest()


def test_fold():
    assert C.fold_chunks([])[:3] == (0o100644, C.blob_id(b""), 0)
    assert C.fold_chunks([("aa" * 20, 5, 0)])[:3] == (0o100644, "aa" * 20, 5)
    mode, oid, size, nodes = C.fold_chunks([("aa" * 20, 5, 0), ("bb" * 20, 20, 0)])
    assert (mode, size, len(nodes)) == (0o040000, 25, 1) and nodes[0] == (oid, [(0o100644, b"00", "aa" * 20), (0o100644, b"05", "bb" * 20)])
    many = [(f"{i:040x}", 10, 1 if i % 5 == 4 else 0) for i in range(25)]
    _, _, size, nodes = C.fold_chunks(many)
    assert size == 250 and [len(e) for _, e in nodes] == [5] * 5 + [5]
    _, _, size, nodes = C.fold_chunks([(f"{i:040x}", 1, 0) for i in range(600)], 256)
    assert size == 600 and [len(e) for _, e in nodes] == [256, 256, 88, 3]


def _frame(spark, contents):
    return spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "k long, content binary")


def test_chunks_put_together_are_the_content(spark):
    contents = [*_contents(), None]
    df = _frame(spark, contents)
    rows = C.chunks(df, "k", F.col("content"))
    for r in rows.collect():
        assert r["oid"] == C.blob_id(contents[r["k"]][r["ofs"] : r["ofs"] + r["len"]])
    parts = rows.join(df, "k").select("k", "seq", "ofs", "len", C.cut_out(F.col("content")).alias("part"))
    assert {r["k"]: bytes(r["content"]) for r in C.join_chunks(parts, "k").collect()} == {i: c for i, c in enumerate(contents) if c}
    for begin, size in ((0, 10), (32_760, 40), (69_990, 100)):
        found = {r["k"]: bytes(r["content"]) for r in C.read_range(parts, "k", F.lit(begin), F.lit(size)).collect()}
        assert found == {i: c[begin : begin + size] for i, c in enumerate(contents) if c and c[begin : begin + size]}
    names = {(r["k"], r["ofs"]): r["name"] for r in C.hex_offsets(rows, "k").collect()}
    assert all(int(n, 16) == ofs and len(n) == len(f"{len(contents[k]):x}") for (k, ofs), n in names.items())
    sizes = {r["k"]: r["size"] for r in C.sizes_from_chunks(rows, "k").collect()}
    assert sizes == {i: len(c) for i, c in enumerate(contents) if c}


def test_roots_and_nodes(spark):
    contents = _contents()
    df = _frame(spark, contents)
    nodes = {}
    for r in C.file_nodes(df, "k", F.col("content")).orderBy("pos").collect():
        nodes.setdefault(r["tree"], []).append((r["mode"], r["name"].encode(), r["oid"]))
    assert all(C.tree_id(e) == t for t, e in nodes.items())
    for r in C.file_roots(df, "k", F.col("content")).collect():
        assert r["size"] == len(contents[r["k"]])
        assert (r["oid"] in nodes) == (r["mode"] == 0o040000)
        if r["chunks"] == 1:
            assert r["oid"] == C.blob_id(contents[r["k"]])


def test_boundaries_between_contents(spark):
    r = random.Random(4)
    data = r.randbytes(90_000)
    rows = [("g", i, bytearray(data[a : a + 7000])) for i, a in enumerate(range(0, 90_000, 7000))] + [("h", 0, bytearray(b"q"))]
    df = spark.createDataFrame(rows, "g string, n int, content binary")
    found = C.chunks_across(df, "g", "n", F.col("content")).orderBy("seq").collect()
    assert [(x["ofs"] + x["len"], x["level"]) for x in found if x["g"] == "g"] == naive(data, 13, 4)


def test_digest_and_runs(spark):
    texts = ["", "a", "x" * 64, "y" * 65 + "é", "z" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    assert {r["k"]: r["digest"] for r in C.rolling_digests(df, "k", "text").collect()} == {i: C.rolling_digest(t.encode()) for i, t in enumerate(texts)}
    runs = C.zero_runs(_frame(spark, [b"\0" * 600, b"a" + b"\0" * 511 + b"b" + b"\0" * 512, b"", b"\0" * 512 + b"x", None]), "k", F.col("content")).collect()
    assert sorted((r["k"], r["ofs"], r["len"]) for r in runs) == [(0, 0, 600), (1, 513, 512), (3, 0, 512)]
