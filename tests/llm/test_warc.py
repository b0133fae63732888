import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stratalith.llm import warc
from stratalith.llm.common import filesystem

PAGES = "page_id long, url string, html string, key string, file string, offset long, first string"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", 1, "x") for r in rows], PAGES)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://www.Example.com", "com,example)/"),
        ("https://u:p@a.b.org:8080/x/Y?q=1#top", "org,b,a)/x/Y?q=1"),
        ("example.net?q", "net,example)/?q"),
        ("", ")/"),
        ("http://m.a.com/", "com,a,m)/"),
    ],
)
def test_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.url_key(F.col("u"))).first()[0] == key


def test_records():
    body = b"<p>\r\n\r\n\x00</p>"
    assert warc.body_of(warc.record(7, "http://a/", body)) == body


def test_urls_with_line_breaks(spark):
    """A URL cannot end its header line, nor give another length; its page is found again."""
    url = "http://a.b/x\r\nContent-Length: 2\r\n\r\nz"
    body = b"<p>seventeen</p>!"
    raw = warc.record(7, url, body)
    assert warc.body_of(raw) == body and zlib.decompress(raw, 31).count(b"\r\n\r\n") == 2
    found = warc.index_pages(_pages(spark, [(1, url, "first"), (2, "http://a.b/\x00\x7f\t", "second"), (3, "http://a.b/x", "third")])).collect()
    assert {r["page_id"]: (r["n_bytes"], r["digest"]) for r in found} == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in ((1, "first"), (2, "second"), (3, "third"))}


def test_lookups_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LOOKUP_LINES", 20)
    rows = [(i, f"http://h{i % 40}.x/{i}", f"page {i}") for i in range(200)]
    found = warc.index_pages(_pages(spark, rows), block_lines=7)
    assert found.rdd.getNumPartitions() > 4
    assert sorted((r["page_id"], r["n_bytes"]) for r in found.collect()) == [(i, len(t)) for i, _, t in rows]


def test_find_block():
    firsts = ["b", "d", "d", "f"]
    assert [warc.find_block(firsts, k) for k in ("a", "b", "c", "d", "e", "f", "z")] == [0, 0, 0, 0, 2, 2, 3]


@pytest.mark.parametrize("block_lines", [1, 3, 1000])
@pytest.mark.parametrize("few", [True, False])
def test_round_trip(spark, tmp_path, monkeypatch, block_lines, few):
    """Every page is found under its key, however small blocks, files and the directory that may be broadcast are."""
    r = random.Random(block_lines)
    rows = [(i, f"http://h{r.randrange(9)}.com/{r.randrange(12)}", f"<b>{i}</b>" * r.randrange(5)) for i in range(150)]
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_BLOCKS", 5)
    archive, index = f"file://{tmp_path}/a", f"file://{tmp_path}/i"
    captures = warc.write_archive(_pages(spark, rows), archive, file_bytes=2000)
    directory = warc.build_index(captures, index, block_lines)
    if block_lines == 1:
        assert directory.count() == 150
    keys = spark.createDataFrame([(f"com,h{h})/{p}",) for h in range(9) for p in range(14)] + [("",), ("zzz",), (None,)], "key string")
    found = warc.look_up(spark, keys, directory, index, archive).collect()
    assert sorted((x["page_id"], bytes(x["body"]).decode()) for x in found) == sorted((i, h) for i, _, h in rows)
    fs, path = filesystem(archive)
    one = found[0]
    with fs.open_input_file(f"{path}/{one['file']}") as f:  # a range read gives a whole gzip member
        f.seek(one["offset"])
        assert zlib.decompress(f.read(one["length"]), 31).startswith(b"WARC/1.0\r\n")


def test_irregular_rows(spark):
    long = "x" * 3_000_000
    rows = [(1, "http://a.com/", "x"), (1, "http://a.com/", "x"), (2, "http://A.com", "x"), (None, "http://a.com/", "y"), (3, None, "z"), (4, "", None), (5, "http://b.com", ""), (6, "http://c.com/é", long)]
    found = sorted((r["page_id"], r["url_key"], r["n_bytes"], r["digest"]) for r in warc.index_pages(_pages(spark, rows)).collect())
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert found == [(1, "com,a)/", 1, md5("x")), (1, "com,a)/", 1, md5("x")), (2, "com,a)/", 1, md5("x")), (4, ")/", 0, md5("")), (5, "com,b)/", 0, md5("")), (6, "com,c)/é", 3_000_000, md5(long))]


def test_empty_table(spark):
    assert warc.index_pages(_pages(spark, [])).count() == 0
