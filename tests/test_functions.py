import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalith.functions import codecs, scalars
from stratalith.functions.hashing import common_bits


def _one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v")).alias("x")).collect()]


def test_sizes_and_times(spark):
    assert _one(spark, scalars.parse_size, "1.5k", "2 gb", "1e+9 k", "-3e-3mb", "7", "9q", "x", None) == [1536, 2 << 30, 1024 * 10**9, -3145, 7, None, None, None]
    assert _one(spark, scalars.parse_timestamp_ns, "100ms", "s", "-2us", "+3ns", "5", "x") == [100_000_000, 10**9, -2000, 3, None, None]
    assert _one(spark, scalars.period_seconds, "3d", "2w", "1m", "1y", "5min", "forever", "x", "-1d") == [259200, 1209600, 31 * 86400, 366 * 86400, 300, math.inf, None, None]
    assert _one(spark, scalars.parse_config_int, "12", "-1k", "2M", "3g", "1t", "") == [12, -1024, 2 << 20, 3 << 30, None, None]
    assert _one(spark, scalars.parse_config_bool, "0", "1", "true", "false", "yes") == [False, True, True, False, None]


def test_numbers(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 10**9, 1 << 60)], "n long").select(scalars.human_size(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["0", "1023", "1.0K", "1.5K", "953.7M", "1.0E"]
    ns = spark.createDataFrame([(n,) for n in (0, 1_500_000_000, -1, -1_500_000_000, -2_000_000_000)], "n long")
    assert [tuple(r) for r in ns.select(scalars.floor_seconds(F.col("n")), scalars.seconds_text(F.col("n"))).collect()] == [(0, "0"), (1, "1.500000000"), (-1, "0.999999999"), (-2, "-1.500000000"), (-2, "-1")]
    modes = spark.createDataFrame([(m,) for m in (0o100644, 0o40755, 0o120777, 0o20600, 0o60600, 0o10644, 0o140755, 0o100755, 0)], "m int")
    assert [tuple(r) for r in modes.select(scalars.mode_string(F.col("m")), scalars.type_mark(F.col("m"))).collect()] == [
        ("-rw-r--r--", ""), ("drwxr-xr-x", "/"), ("lrwxrwxrwx", "@"), ("crw-------", ""), ("brw-------", ""), ("prw-r--r--", "|"), ("srwxr-xr-x", "="), ("-rwxr-xr-x", "*"), ("?---------", "")]


def test_paths(spark):
    assert _one(spark, lambda c: F.array_join(F.transform(scalars.path_prefixes(c), lambda x: x["full"]), " "), "/a//b/./c/", "/", "rel") == ["/ /a /a/b /a/b/c", "/", None]
    assert _one(spark, lambda c: scalars.strip_prefix(c, ["/a", "/a/b", "/"]), "/a/b/c", "/ab/c", "/x") == ["/c", "b/c", "/x"]
    assert _one(spark, lambda c: scalars.graft(c, [("/a", "/"), ("/b", "/n/m")]), "/a/x", "/b", "/b/y", "/c") == ["/x", "/n/m", "/n/m/y", "/c"]
    assert _one(spark, scalars.archive_path, "/a/../b", "../x", "a/./b//c", "./q", "a/.", "/", "a/..", "//a/././b") == ["b", "x", "a/b/c", "q", "a", ".", ".", "a/b"]
    assert _one(spark, scalars.risky_path, "/a", "a/../b", "../a", "a/..", "a/b", "a..b") == [True, True, True, True, False, False]
    assert _one(spark, scalars.valid_ref_name, "a/b", "@", "a..b", ".a", "a/.b", "x.lock", "x.lock/y", "a b", "a/", "a.", "a@{b", "tab\tx", "ok-1.2") == [True, False, False, False, False, False, False, False, False, False, False, False, True]
    assert _one(spark, scalars.split_depth, "x.3.sld", "x.sld", "a..12.sld") == [3, None, 12]


def test_marks(spark):
    rows = [("f", 0o100644, 0o40000), ("f.sl", 0o100644, 0o100644), ("f.slx", 0o100644, 0o100644), ("d.sl", 0o40755, 0o40000), ("g", 0o100644, 0o100644)]
    df = spark.createDataFrame(rows, "name string, mode int, stored int")
    marked = df.withColumn("m", scalars.mark_name(F.col("name"), F.col("mode"), F.col("stored")))
    found = marked.select("m", scalars.unmark_name(F.col("m"), F.col("stored")).alias("u")).select("m", "u.name", "u.chunked").collect()
    assert [tuple(r) for r in found] == [("f.sl", "f", True), ("f.sl.sll", "f.sl", False), ("f.slx.sll", "f.slx", False), ("d.sl.sll", "d.sl", False), ("g", "g", False)]


def test_quoting_and_urls(spark):
    assert _one(spark, scalars.shell_quote, "a/b.c", "a b", "it's", "") == ["a/b.c", "'a b'", "'it'\"'\"'s'", "''"]
    assert _one(spark, scalars.sql_literal, "a'b") == ["'a''b'"]
    assert _one(spark, scalars.terminal_text, "a/b", "a b", "a\nb", "it's", None) == ["a/b", "'a b'", "$'a\\nb'", "'it'\\''s'", None]
    urls = ["ssh://u:p@h:22/x/y", "file:/./a", "http://h/./rel", "x", "s://h"]
    found = _one(spark, lambda c: F.to_json(scalars.url_parts(c), {"ignoreNullFields": "false"}), *urls)
    assert found[0] == '{"scheme":"ssh","user":"u","host":"h","port":22,"path":"/x/y"}'
    assert '"path":"a"' in found[1] and '"path":"rel"' in found[2] and found[3] is None and '"path":""' in found[4]
    assert codecs.split_words("a 'b c' \"d\\\"e\" f\\ g") == [(0, "a"), (2, "b c"), (8, 'd"e'), (15, "f g")]


def test_commits(spark):
    df = spark.createDataFrame([("aa" * 20, "bb" * 20), ("cc" * 20, None)], "t string, p string")
    text = scalars.commit_text(F.col("t"), F.col("p"), F.lit("A B <a@b>"), F.lit(5), F.lit(-1800), F.lit("C <c>"), F.lit(6), F.lit(5400), F.lit("m\n\nmore"))
    rows = df.select(text.alias("x")).select("x", scalars.commit_fields(F.col("x")).alias("f")).select("x", "f.*").collect()
    assert rows[0]["x"].startswith(f"tree {'aa' * 20}\nparent {'bb' * 20}\nauthor A B <a@b> 5 -0030\ncommitter C <c> 6 +0130\n\nm")
    r = rows[0]
    assert (r["tree"], r["parents"], r["author_name"], r["author_mail"], r["author_sec"], r["author_offset"], r["committer_offset"], r["message"]) == ("aa" * 20, ["bb" * 20], "A B", "a@b", 5, -1800, 5400, "m\n\nmore")
    assert rows[1]["parents"] == [] and rows[1]["signature"] is None
    signed = rows[0]["x"].replace("\n\n", "\ngpgsig one\n two\n three\n\n", 1)
    assert _one(spark, lambda c: scalars.commit_fields(c)["signature"], signed) == ["one\ntwo\nthree"]
    assert _one(spark, scalars.has_trailers, "x\n\nKey: v", "x\nno trailer", "Key: v\n\n") == [True, False, True]


def test_common_bits(spark):
    a = "f" * 40
    rows = [(a, a, 160), (a, "7" + a[1:], 0), (a, a[:-1] + "e", 159), ("0" * 40, "0" * 9 + "1" + "0" * 30, 39)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    assert all(r["n"] == r["x"] for r in df.withColumn("x", common_bits(F.col("a"), F.col("b"))).collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**30), 10**30))
def test_integers_round_trip(x):
    assert codecs.decode_vint(codecs.encode_vint(x)) == (x, len(codecs.encode_vint(x)))
    if x >= 0:
        assert codecs.decode_vuint(codecs.encode_vuint(x)) == (x, len(codecs.encode_vuint(x)))


def test_integers_in_sql(spark):
    values = [0, 1, 63, 64, 127, 128, -1, -64, -8191, 16383, 16384, 2**40, 2**62, -(2**62), 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    found = df.select(codecs.vint_hex(F.col("v")), codecs.vuint_hex(F.col("v"))).collect()
    assert [r[0].lower() for r in found] == [codecs.encode_vint(v).hex() for v in values]
    assert [r[1] and r[1].lower() for r in found] == [codecs.encode_vuint(v).hex() if v >= 0 else None for v in values]
    with pytest.raises(ValueError):
        codecs.encode_vuint(-1)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["blob", "tree", "commit", "tag"]), st.binary(max_size=3000))
def test_object_records(kind, content):
    assert codecs.decode_object(codecs.encode_object(kind, content)) == (kind, content)


def test_object_records_are_made_in_slices():
    import pyarrow as pa

    contents = [random.Random(i).randbytes(200_000) for i in range(40)] + [None, b"", b"x"]
    kinds = ["blob"] * 41 + ["tree", None]
    records = list(codecs.object_record.func(iter([(pa.array(kinds), pa.array(contents, pa.binary()))])))
    objects = list(codecs.object_content.func(iter(records)))
    assert max(a.nbytes for a in records + objects) < 2 * codecs.SLICE_BYTES  # all at once would be 8 MB
    found = [(o["kind"], o["content"]) for a in objects for o in a.to_pylist()]
    assert found == [(k, c) if k is not None and c is not None else (None, None) for k, c in zip(kinds, contents, strict=True)]


def test_object_records_of_rows(spark):
    rows = [(i, None if i % 50 == 7 else "tree" if i % 3 else "blob", None if i % 40 == 9 else bytes([i % 256]) * (i % 11 * 30_000)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, kind string, content binary").repartition(3)
    back = df.select("i", codecs.object_content(codecs.object_record("kind", "content")).alias("o")).select("i", "o.kind", "o.content").collect()
    expected = [(i, k, c) if k is not None and c is not None else (i, None, None) for i, k, c in rows]
    assert sorted((r["i"], r["kind"], r["content"] if r["content"] is None else bytes(r["content"])) for r in back) == expected


def test_metadata_records_skip_what_they_do_not_know():
    fields = {"path": "a/b", "mode": 33188, "uid": 5, "user": "u", "gid": 6, "grp": "g", "rdev": 0, "atime": -1, "mtime": 2, "ctime": 3, "size": 4, "symlink": "t"}
    raw = codecs.encode_metadata(fields)
    assert codecs.decode_metadata(raw) == fields
    strange = codecs.encode_vuint(99) + codecs.encode_bytes(b"later")
    assert codecs.decode_metadata(strange + raw) == fields


def test_columns_and_trees():
    assert codecs.columnate(["a", "bb", "c"], 10, "> ") == "> a   c   \n> bb  \n" and codecs.columnate([]) == ""
    assert codecs.columnate(["long word", "b"], 5) == "long word\nb\n"
    raw = b"100644 a\0" + bytes(20) + b"40000 d\0" + b"\x01" * 20
    assert codecs.decode_tree(raw) == [(0o100644, "a", "00" * 20), (0o40000, "d", "01" * 20)]


@given(st.lists(st.one_of(st.tuples(st.just("V"), st.integers(0, 10**30)), st.tuples(st.just("v"), st.integers(-(10**30), 10**30)), st.tuples(st.just("s"), st.binary(max_size=300))), max_size=8))
def test_typed_values_come_back(items):
    kinds, values = "".join(k for k, _ in items), [v for _, v in items]
    data = codecs.pack(kinds, *values)
    assert codecs.unpack(kinds, data) == values
    with pytest.raises(ValueError):
        codecs.unpack(kinds, data + b"x")
    if data:
        with pytest.raises(ValueError):
            codecs.unpack(kinds, data[:-1])
    with pytest.raises(ValueError):
        codecs.pack(kinds + "V", *values)


def test_quoting_of_control_characters(spark):
    assert _one(spark, scalars.dollar_quote, "a\x01\x1b'\\\n\x7fé") == [r"$'a\x01\e\'\\\n\x7fé'"]


def test_remotes_and_urls(spark):
    found = _one(spark, scalars.remote_parts, "u@h:/p:q", "x@y@h:p", "h:", "-:p", ":p", "none", None)
    assert [tuple(x) if x else None for x in found] == [("u", "h", "/p:q"), ("x@y", "h", "p"), ("", "h", ""), ("", "", "p"), None, None, None]
    made = lambda *parts, dots=False: spark.range(1).select(scalars.render_url(*(F.lit(p) for p in parts), dots=dots)).first()[0]
    none = None
    assert made("ssh", "u", "h", 22, "/p") == "ssh://u@h:22/p"
    assert made("ssh", "", "h", none, "p", dots=True) == "ssh://h/./p" and made("ssh", "", "h", none, "p") is None
    assert made("file", "", "", none, "/p") == "file:/p" and made("file", "", "", none, "//p") == "file:////p"
    assert made("ssh", "a b:é", "h_@", none, "") == "ssh://a%20b:%c3%a9@h_%40"
