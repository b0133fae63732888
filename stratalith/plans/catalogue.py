"""One query for each operator over the test tables, and DuckDB SQL for what SQL can express.

The tables stand in for a store: documents, pages and conversations are contents; events are saves (user = branch);
region to lineitem is an object graph; customers and parts are directory entries; parts make two listings of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions import codecs, scalars
from stratalith.functions.hashing import entry_key, text_id, tree_ids
from stratalith.operators import chunking, dirsplit, graph, history, membership, snapshot, vfs
from stratalith.sources.files import backup_times
from stratalith.storage import fresh_folder
from stratalith.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "text", text_id(F.col("text")).alias("oid"))


_OID = "sha1('blob ' || octet_length(encode(text)) || chr(0) || text)"
_IDS = f"(SELECT DISTINCT {_OID} AS oid FROM documents WHERE text IS NOT NULL)"

# ---- identities and stored once


@_query(f"SELECT doc_id, {_OID} AS oid FROM documents")
def blob_oid(spark, d):
    return _documents(spark, d).select("doc_id", "oid")


@_query(f"SELECT oid, count(*) AS copies, min(doc_id) AS first_doc, max(n) AS size FROM (SELECT doc_id, {_OID} AS oid, octet_length(encode(text)) AS n FROM documents) GROUP BY oid")
def dedup_objects(spark, d):
    return _documents(spark, d).groupBy("oid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max(F.octet_length("text")).cast("long").alias("size"))


@_query(
    f"SELECT sum(c)::bigint AS objects, count(*) AS distinct_objects, sum(n * c)::bigint AS total_bytes, sum(n)::bigint AS unique_bytes FROM (SELECT {_OID} AS oid, max(octet_length(encode(text))) AS n, count(*) AS c FROM documents GROUP BY 1)"
)
def dedup_stats(spark, d):
    by = dedup_objects(spark, d)
    return by.agg(F.sum("copies").alias("objects"), F.count(F.lit(1)).alias("distinct_objects"), F.sum(F.col("size") * F.col("copies")).alias("total_bytes"), F.sum("size").alias("unique_bytes"))


@_query(f"SELECT min(doc_id) AS doc_id, {_OID} AS oid FROM documents WHERE text NOT IN (SELECT text FROM conversations WHERE text IS NOT NULL) GROUP BY 2")
def store_new(spark, d):
    stored = table(spark, d, "conversations").select(text_id(F.col("text")).alias("oid"))
    return membership.store_new(_documents(spark, d).select("doc_id", "oid"), stored, "doc_id")


# ---- chunks


@_query(
    """
    WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, substr(x, greatest(length(x) - 127, 1)) AS x FROM h),
    b AS (SELECT doc_id, length(x) // 2 AS n, [('0x' || substr(x, 2 * i + 1, 2))::bigint FOR i IN range(0, length(x) // 2)] AS v FROM t),
    s AS (SELECT doc_id, 1984 + coalesce(list_sum(v), 0) AS s1, 124992 + coalesce(list_sum([v[i + 1] * (n - i) FOR i IN range(0, n)]), 0) AS s2 FROM b)
    SELECT doc_id, (((s1::bigint << 16) | (s2::bigint & 65535)) & 4294967295)::bigint AS digest FROM s
    """
)
def rollsum_digest(spark, d):
    return chunking.rolling_digests(table(spark, d, "documents"), "doc_id", "text")


def _content(name: str = "text"):
    return F.encode(F.col(name), "UTF-8")


#: Chunks by the definition of the checksum: prefix sums of bytes, candidates of whole windows, then chunk after chunk.
_CHUNKS = """
    y AS (SELECT doc_id, n, i, ('0x' || h)::int AS v FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents WHERE text <> '')),
    s AS (SELECT doc_id, n, i, sum(v) OVER w AS p, sum(v * i) OVER w AS q FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    z AS (SELECT doc_id, n, i, p::bigint AS p, q::bigint AS q FROM s UNION ALL SELECT DISTINCT doc_id, n, -1, 0, 0 FROM s),
    -- digests of windows of 64 bytes; those that a chunk's begin cuts short are made from the sums at it
    f AS (SELECT b.doc_id, b.i, (124992 + (b.i + 1) * (b.p - a.p) - (b.q - a.q))::bigint AS s2, 1984 + b.p - a.p AS s1 FROM z b JOIN z a ON a.doc_id = b.doc_id AND a.i = b.i - 64),
    hits AS (SELECT doc_id, i, s1, s2 FROM f WHERE s2 & 8191 = 8191),
    c(doc_id, n, seq, ofs, stop, s1, s2) AS (
        SELECT doc_id, n, -1, 0::bigint, 0::bigint, 0::bigint, 0::bigint FROM z WHERE i = -1
        UNION ALL
        SELECT k.doc_id, k.n, k.seq + 1, k.stop, coalesce(e.i, h.i, least(k.n, k.stop + 32768) - 1) + 1, CASE WHEN e.i IS NOT NULL THEN e.s1 ELSE h.s1 END, CASE WHEN e.i IS NOT NULL THEN e.s2 ELSE h.s2 END
        FROM c k
        LEFT JOIN LATERAL (
            SELECT min(b.i) AS i, arg_min(1984 + b.p - a.p, b.i) AS s1, arg_min((124992 + (b.i + 1) * (b.p - a.p) - (b.q - a.q))::bigint, b.i) AS s2 FROM z b JOIN z a ON a.doc_id = b.doc_id AND a.i = k.stop - 1
            WHERE b.doc_id = k.doc_id AND b.i BETWEEN k.stop AND k.stop + 62 AND (124992 + (b.i + 1) * (b.p - a.p) - (b.q - a.q))::bigint & 8191 = 8191
        ) e ON true
        LEFT JOIN LATERAL (SELECT min(i) AS i, arg_min(s1, i) AS s1, arg_min(s2, i) AS s2 FROM hits WHERE hits.doc_id = k.doc_id AND i BETWEEN k.stop + 63 AND k.stop + 32767) h ON true
        WHERE k.stop < k.n
    ),
    d AS (SELECT doc_id, seq::int AS seq, ofs, (stop - ofs)::int AS len, ((s1 << 16) | (s2 & 65535)) & 4294967295 AS g FROM c WHERE seq >= 0),
    t AS (SELECT doc_id, hex(encode(text)) AS x FROM documents),
    chunk AS (SELECT doc_id, seq, ofs, len, coalesce(floor(log2(((g >> 14) + 1) & ~(g >> 14)))::int // 4, 0)::int AS level, sha1(encode('blob ' || len) || unhex('00') || unhex(substr(x, 2 * ofs + 1, 2 * len))) AS oid FROM d JOIN t USING (doc_id))
"""


@_query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, seq, ofs, len, level, oid FROM chunk")
def chunk_boundaries(spark, d):
    return chunking.chunks(table(spark, d, "documents"), "doc_id", _content())


@_query(f"WITH RECURSIVE {_CHUNKS}, w AS (SELECT doc_id, length(printf('%X', sum(len)::bigint)) AS w FROM chunk GROUP BY doc_id) SELECT doc_id, seq, lpad(printf('%x', ofs), w::int, '0') AS name, len, oid FROM chunk JOIN w USING (doc_id)")
def chunk_offsets(spark, d):
    return chunking.hex_offsets(chunking.chunks(table(spark, d, "documents"), "doc_id", _content()), "doc_id").select("doc_id", "seq", "name", "len", "oid")


@_query(f"WITH RECURSIVE {_CHUNKS}, b AS (SELECT oid, count(*) AS c, max(len) AS n FROM chunk GROUP BY oid) SELECT sum(c)::bigint AS chunks, count(*) AS distinct_chunks, sum(n * c)::bigint AS bytes, sum(n)::bigint AS unique_bytes FROM b")
def chunk_dedup_stats(spark, d):
    by = chunking.chunks(table(spark, d, "documents"), "doc_id", _content()).groupBy("oid").agg(F.count(F.lit(1)).alias("c"), F.max("len").alias("n"))
    return by.agg(F.sum("c").alias("chunks"), F.count(F.lit(1)).alias("distinct_chunks"), F.sum(F.col("n") * F.col("c")).alias("bytes"), F.sum(F.col("n").cast("long")).alias("unique_bytes"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", _content().alias("content"))
    return chunking.chunks(docs, "doc_id", F.col("content")).join(docs, "doc_id").select("doc_id", "seq", "ofs", "len", chunking.cut_out(F.col("content")).alias("part"))


@_query("SELECT doc_id, sha1(text) AS digest FROM documents WHERE text <> ''")
def chunk_roundtrip(spark, d):
    return chunking.join_chunks(_parts(spark, d), "doc_id").select("doc_id", F.sha1("content").alias("digest"))


@_query("SELECT doc_id, substr(hex(encode(text)), 2001, 12000) AS piece FROM documents WHERE octet_length(encode(text)) > 1000")
def seek_read(spark, d):
    return chunking.read_range(_parts(spark, d), "doc_id", F.lit(1000), F.lit(6000)).select("doc_id", F.hex("content").alias("piece"))


@_query("SELECT doc_id, octet_length(encode(text)) AS size FROM documents WHERE text <> ''")
def file_size_from_chunks(spark, d):
    return chunking.sizes_from_chunks(chunking.chunks(table(spark, d, "documents"), "doc_id", _content()), "doc_id")


def _folds(most: int = 4) -> str:
    """CTEs that fold chunks into trees, level by level, up to chunks of level `most`; items of the last one are whole contents."""
    text = "i0 AS (SELECT doc_id, seq::bigint AS idx, 33188 AS mode, oid, len::bigint AS size, level, max(level) OVER (PARTITION BY doc_id) AS top, 0::bigint AS trees FROM chunk)"
    for n in range(1, most + 2):
        closed = f"coalesce(sum((level >= {n})::int) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        group = "0" if n > most else f"CASE WHEN top >= {n} THEN {closed} ELSE idx END"
        text += f""",
    g{n} AS (SELECT *, ({group})::bigint AS k FROM i{n - 1}),
    o{n} AS (SELECT *, (sum(size) OVER (PARTITION BY doc_id, k ORDER BY idx) - size)::bigint AS begins, (sum(size) OVER (PARTITION BY doc_id, k))::bigint AS total, count(*) OVER (PARTITION BY doc_id, k) AS n, row_number() OVER (PARTITION BY doc_id, k ORDER BY idx) - 1 AS pos FROM g{n}),
    e{n} AS (SELECT *, lpad(printf('%x', begins), length(printf('%x', total))::int, '0') AS name FROM o{n}),
    t{n} AS (SELECT doc_id, k, any_value(n) AS n, any_value(total) AS total, any_value(top) AS top, arg_max(level, idx) AS level, sum(trees)::bigint AS trees, any_value(mode) AS mode, any_value(oid) AS oid,
        string_agg(hex(encode(CASE mode WHEN 16384 THEN '40000 ' ELSE '100644 ' END || name)) || '00' || upper(oid), '' ORDER BY idx) AS h FROM e{n} GROUP BY doc_id, k),
    i{n} AS (SELECT doc_id, k AS idx, CASE WHEN n > 1 THEN 16384 ELSE mode END AS mode, CASE WHEN n > 1 THEN sha1(encode('tree ' || (length(h) // 2)) || unhex('00') || unhex(h)) ELSE oid END AS oid, total AS size, level, top, trees + (n > 1)::int AS trees FROM t{n})"""
    return text


@_query(
    f"WITH RECURSIVE {_CHUNKS}, {_folds()}, numbers AS (SELECT doc_id, count(*) AS chunks FROM chunk GROUP BY doc_id) SELECT doc_id, mode::int AS mode, oid, size, chunks::int AS chunks, trees::int AS trees FROM i5 JOIN numbers USING (doc_id) "
    "UNION ALL SELECT doc_id, 33188, 'e69de29bb2d1d6434b8b29ae775ad8c2e48c5391', 0, 0, 0 FROM documents WHERE text = ''"
)
def file_roots(spark, d):
    return chunking.file_roots(table(spark, d, "documents"), "doc_id", _content())


@_query(f"WITH RECURSIVE {_CHUNKS}, {_folds()} " + " UNION ALL ".join(f"SELECT e{n}.doc_id, i{n}.oid AS tree, pos::int AS pos, e{n}.mode::int AS mode, name, e{n}.oid FROM e{n} JOIN i{n} ON e{n}.doc_id = i{n}.doc_id AND k = i{n}.idx WHERE n > 1" for n in range(1, 6)))
def file_nodes(spark, d):
    return chunking.file_nodes(table(spark, d, "documents"), "doc_id", _content())


@_query(
    "SELECT page_id, octet_length(encode(url)) AS ofs, page_id % 1000 + 300 AS len FROM pages WHERE page_id % 1000 + 300 >= 512 "
    "UNION ALL SELECT page_id, octet_length(encode(url)) + page_id % 1000 + 300 + octet_length(encode(html)), page_id * 7 % 900 FROM pages WHERE page_id * 7 % 900 >= 512"
)
def zero_runs(spark, d):
    """Pages with holes of zeros behind their URL and at their end."""
    hole = lambda n: F.encode(F.repeat(F.lit("\0"), n.cast("int")), "UTF-8")
    content = F.concat(_content("url"), hole(F.col("page_id") % 1000 + 300), _content("html"), hole(F.col("page_id") * 7 % 900))
    return chunking.zero_runs(table(spark, d, "pages"), "page_id", content)


# ---- membership


@_query(f"SELECT oid, arg_min(source, (source, doc_id)) AS pack, arg_min(doc_id, (source, doc_id)) AS ofs FROM (SELECT source, doc_id, {_OID} AS oid FROM documents) GROUP BY oid")
def locate_objects(spark, d):
    docs = _documents(spark, d)
    return membership.locate(docs.select("oid").distinct(), docs.select("oid", F.col("source").alias("pack"), F.col("doc_id").alias("ofs")))


_WORDS_SQL = "SELECT 'benchmark' AS kind, text FROM benchmark UNION ALL SELECT 'conversation', text FROM conversations UNION ALL SELECT 'document', text FROM documents"


def _probe(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, kind in (("benchmark", "benchmark"), ("conversations", "conversation"), ("documents", "document")):
        rows = table(spark, d, name).select(F.lit(kind).alias("kind"), text_id(F.col("text")).alias("oid"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query(f"SELECT kind, count(*) AS n FROM (SELECT kind, {_OID} AS oid FROM ({_WORDS_SQL})) WHERE oid IN (SELECT oid FROM {_IDS}) GROUP BY kind")
def exists_probe(spark, d):
    return membership.exists(_probe(spark, d), _documents(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT DISTINCT kind, {_OID} AS oid FROM ({_WORDS_SQL}) WHERE text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)")
def missing_objects(spark, d):
    return membership.missing(_probe(spark, d), _documents(spark, d)).select("kind", "oid")


@_query(
    "WITH l AS (SELECT DISTINCT c_mktsegment || '/' || c_nationkey AS name FROM customer WHERE c_acctbal > 0), r AS (SELECT DISTINCT c_mktsegment || '/' || c_nationkey AS name FROM customer WHERE c_acctbal > 9000) "
    "SELECT name, 'fetch' AS action FROM r WHERE name NOT IN (SELECT name FROM l) UNION ALL SELECT name, 'drop' FROM l WHERE name NOT IN (SELECT name FROM r)"
)
def sync_sets(spark, d):
    named = table(spark, d, "customer").select(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("name"), "c_acctbal")
    return membership.sync_sets(named.where("c_acctbal > 0"), named.where("c_acctbal > 9000"))


@_query(f"SELECT prefix, sum(coalesce(c, 0)) OVER (ORDER BY prefix)::bigint AS n FROM range(256) r(prefix) LEFT JOIN (SELECT ('0x' || substr(oid, 1, 2))::bigint AS prefix, count(*) AS c FROM {_IDS} GROUP BY 1) USING (prefix)")
def idx_fanout(spark, d):
    return membership.fanout(_documents(spark, d), 8, distinct=True)


@_query(
    f"""
    WITH o AS (SELECT {_OID} AS oid FROM documents), b AS (SELECT greatest(0, ceil(log2(greatest(1, floor(count(*) / 204.8)))))::int AS bits FROM o),
    c AS (SELECT (('0x' || substr(oid, 1, 8))::bigint >> (32 - bits)) AS prefix, count(*) AS c FROM o, b GROUP BY 1)
    SELECT prefix, sum(coalesce(c, 0)) OVER (ORDER BY prefix)::bigint AS n FROM (SELECT unnest(range(0, 1 << bits)) AS prefix FROM b) LEFT JOIN c USING (prefix)
    """
)
def midx_prefix_table(spark, d):
    return membership.prefix_table(_documents(spark, d))


@_query(f"SELECT DISTINCT {_OID} AS oid FROM ({_WORDS_SQL})")
def idx_merge_distinct(spark, d):
    probe = _probe(spark, d)
    return membership.merge_distinct(*(probe.where(F.col("kind") == k) for k in ("benchmark", "conversation", "document")))


@_query(f"SELECT oid, source AS pack, (dense_rank() OVER (ORDER BY source) - 1)::int AS which FROM (SELECT source, {_OID} AS oid FROM documents)")
def midx_merge_which(spark, d):
    return membership.merge_sources(_documents(spark, d).select("oid", F.col("source").alias("pack")))


@_query(f"SELECT 'lost' AS problem, oid FROM (SELECT DISTINCT {_OID} AS oid FROM ({_WORDS_SQL})) WHERE oid NOT IN (SELECT oid FROM {_IDS})")
def midx_check(spark, d):
    return membership.check_merged(_documents(spark, d), _probe(spark, d))


@_query(f"WITH p AS (SELECT DISTINCT substr({_OID}, 1, 2) AS prefix FROM benchmark) SELECT prefix, oid FROM {_IDS} JOIN p ON prefix = substr(oid, 1, 2)")
def prefix_find(spark, d):
    wanted = table(spark, d, "benchmark").select(F.substring(text_id(F.col("text")), 1, 2).alias("prefix"))
    return membership.find_prefix(_documents(spark, d), wanted, 2)


@_query(
    f"""
    WITH z AS (SELECT oid, lag(oid, 1, repeat('0', 40)) OVER (ORDER BY oid) AS pv FROM {_IDS}),
    n AS (SELECT oid, pv, list_position([substr(oid, i, 1) <> substr(pv, i, 1) FOR i IN range(1, 41)], true) - 1 AS k FROM z)
    SELECT max(4 * k + 3 - floor(log2(xor(('0x' || substr(oid, k + 1, 1))::int, ('0x' || substr(pv, k + 1, 1))::int)))::int)::int AS bits FROM n
    """
)
def margin_bits(spark, d):
    return membership.margin(_documents(spark, d))


@_query(
    f"WITH r AS (SELECT ('0x' || substr(oid, 1, 16))::hugeint AS p, row_number() OVER (ORDER BY oid) - 1 AS r, count(*) OVER ()::hugeint AS n FROM {_IDS}) SELECT max(abs(r - ((p * n) >> 64)))::bigint AS error FROM r"
)
def margin_predict(spark, d):
    return membership.margin_predict(_documents(spark, d))


_SHAPE = f"(SELECT floor(log2(greatest(1, count(*) * 4)))::int AS bits FROM {_IDS})"
_PLACES = "('0x' || substr(oid, 8 * j + 1, 8))::bigint"


def _shape(ids: DataFrame) -> tuple[int, int]:
    return membership.bloom_shape(ids.count())


@_query(f"SELECT DISTINCT ({_PLACES} >> (32 - bits))::bigint AS byte, (({_PLACES} >> (29 - bits)) & 7)::int AS bit FROM {_IDS}, {_SHAPE}, range(5) t(j)")
def bloom_bits(spark, d):
    ids = _documents(spark, d).select("oid").distinct()
    return membership.bloom_bits(ids, *_shape(ids))


@_query(
    f"""
    WITH s AS {_SHAPE}, on_ AS (SELECT DISTINCT ({_PLACES} >> (32 - bits)) AS byte, (({_PLACES} >> (29 - bits)) & 7) AS bit FROM {_IDS}, s, range(5) t(j)),
    q AS (SELECT DISTINCT {_OID} AS oid FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations UNION ALL SELECT text FROM documents) WHERE text IS NOT NULL),
    p AS (SELECT oid, ({_PLACES} >> (32 - bits)) AS byte, (({_PLACES} >> (29 - bits)) & 7) AS bit FROM q, s, range(5) t(j))
    SELECT oid, bool_and(on_.byte IS NOT NULL) AS maybe FROM p LEFT JOIN on_ ON p.byte = on_.byte AND p.bit = on_.bit GROUP BY oid
    """
)
def bloom_probe(spark, d):
    ids = _documents(spark, d).select("oid").distinct()
    bits, k = _shape(ids)
    return membership.bloom_probe(_probe(spark, d).where("oid IS NOT NULL"), membership.bloom_bits(ids, bits, k), bits, k)


@_query("SELECT source, count(*) AS entries, round(100 * pow(1 - exp(-5 * count(*)::double / (8 * pow(2.0, 12))), 5), 9) AS rate FROM documents GROUP BY source")
def bloom_pfalse(spark, d):
    by = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("entries"))
    return by.select("source", "entries", F.round(scalars.bloom_rate(F.col("entries"), 5, F.lit(12)), 9).alias("rate"))


@_query(
    """
    WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS added FROM documents GROUP BY source)
    SELECT source, CASE WHEN added = 0 THEN 'nothing' WHEN 100 * pow(1 - exp(-5 * n::double / (8 * pow(2.0, 6))), 5) > 1 THEN 'regenerate' ELSE 'add' END AS decision FROM c
    """
)
def bloom_upkeep(spark, d):
    by = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_chars") > 2000, 1)).alias("added"))
    old = F.col("n") - F.col("added")
    return by.select("source", membership.bloom_decision(old, old, F.col("added"), F.lit(6), 5).alias("decision"))


@_query(f"SELECT DISTINCT source AS pack FROM (SELECT source, {_OID} AS oid FROM documents) WHERE oid IN (SELECT {_OID} FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1))")
def suggest_packs(spark, d):
    good = table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id").select(F.lit("document").alias("kind"), text_id(F.col("text")).alias("oid"))
    sent = _probe(spark, d).where("kind <> 'document'").unionByName(good)
    return membership.suggest_packs(sent, _documents(spark, d).select("oid", F.col("source").alias("pack")))


@_query("SELECT p_partkey, 'pack-' || sha1(p_name || p_size) || '.' || lower(p_type) AS name FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_type = 'PROMO' AND sha1(q.p_name || q.p_size) = sha1(p.p_name || p.p_size))")
def stray_files(spark, d):
    """Parts of type PROMO stand for the packs themselves."""
    kind = F.when(F.col("p_type") == "PROMO", "pack").otherwise(F.lower("p_type"))
    return membership.stray_files(table(spark, d, "part").select("p_partkey", F.concat(F.lit("pack-"), F.sha1(F.concat("p_name", "p_size")), F.lit("."), kind).alias("name")))


# ---- histories

_NOW = 1706659200
_KEEP = {"all": 86400, "dailies": 10 * 86400, "monthlies": 20 * 86400, "yearlies": 25 * 86400}


def _saves(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("branch"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("utc"), "event_type", "value")


_SAVES = "(SELECT user_id AS branch, event_id AS id, floor(epoch(ts))::bigint AS utc, ts, event_type, value FROM events)"


@_query(
    f"""
    WITH p AS (SELECT branch, id, utc, ts, CASE WHEN utc >= {_NOW - 86400} THEN 0 WHEN utc >= {_NOW - 864000} THEN 1 WHEN utc >= {_NOW - 1728000} THEN 2 WHEN utc >= {_NOW - 2160000} THEN 3 ELSE 4 END AS ph FROM {_SAVES}),
    k AS (SELECT *, CASE ph WHEN 1 THEN dayofyear(ts) WHEN 2 THEN month(ts) WHEN 3 THEN year(ts) ELSE 0 END AS rk FROM p),
    l AS (SELECT *, lag(rk) OVER (PARTITION BY branch, ph ORDER BY utc DESC, id DESC) AS pk FROM k)
    SELECT branch, id, CASE WHEN ph = 0 THEN true WHEN ph = 4 THEN false ELSE rk IS DISTINCT FROM pk END AS keep FROM l
    """
)
def prune_classify(spark, d):
    return history.classify_saves(_saves(spark, d), _NOW, _KEEP).select("branch", "id", "keep")


@_query(
    f"""
    WITH n AS (SELECT event_type AS branch, id, utc, strftime(ts, '%Y-%m-%d') || '-' || strftime(ts, '%H') || '0000' AS name FROM {_SAVES}),
    k AS (SELECT *, count(*) OVER (PARTITION BY branch, name) AS n, row_number() OVER (PARTITION BY branch, name ORDER BY utc - utc % 3600 DESC, id DESC) AS k FROM n)
    SELECT branch, id, CASE WHEN n = 1 THEN name ELSE name || '-' || lpad((n - k)::varchar, length((n - 1)::varchar)::int, '0') END AS name FROM k
    """
)
def save_names(spark, d):
    hourly = _saves(spark, d).select(F.col("event_type").alias("branch"), "id", (F.col("utc") - F.col("utc") % 3600).alias("utc"))
    return history.save_names(hourly).select("branch", "id", "name")


@_query(f"SELECT branch, utc, id FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY utc DESC, id DESC) AS n FROM {_SAVES}) WHERE n = 1")
def latest_save(spark, d):
    return history.latest(_saves(spark, d))


@_query(
    f"""
    WITH m AS (SELECT branch, id, utc, event_type <> 'error' AS keep, max((event_type = 'error')::int) OVER (PARTITION BY branch ORDER BY utc, id ROWS UNBOUNDED PRECEDING) AS gone FROM {_SAVES})
    SELECT branch, id, lag(id) OVER (PARTITION BY branch ORDER BY utc, id) AS parent, gone = 1 AS rewritten FROM m WHERE keep
    """
)
def reparent_history(spark, d):
    return history.relink(_saves(spark, d), F.col("event_type") != "error")


@_query(f"SELECT branch, id, bool_and(value < 60) OVER (PARTITION BY branch ORDER BY utc DESC, id DESC ROWS UNBOUNDED PRECEDING) AS leading FROM {_SAVES}")
def leading_run(spark, d):
    return history.leading_run(_saves(spark, d), F.col("value") < 60, "branch", F.desc("utc"), F.desc("id")).select("branch", "id", "leading")


@_query(
    "WITH k AS (SELECT c_nationkey, c_mktsegment, c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer) "
    "SELECT c_custkey, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || '-' || lpad((n - k)::varchar, length((n - 1)::varchar)::int, '0') END AS unique_name FROM k"
)
def duplicate_suffix(spark, d):
    return history.suffix_duplicates(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("c_custkey", "unique_name")


_COMMITS = "(SELECT 'c' || o_orderkey AS oid, 'c' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent, o_custkey, floor(epoch(o_orderdate))::bigint AS utc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders)"


def _commits(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    back = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = table(spark, d, "orders")
    return rows.select(F.concat(F.lit("c"), "o_orderkey").alias("oid"), F.concat(F.lit("c"), F.lag("o_orderkey").over(w)).alias("parent"), "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("utc"), back.alias("back"))


@_query(f"WITH c AS {_COMMITS} SELECT t.oid AS tip, c.oid, c.utc, row_number() OVER (PARTITION BY t.oid ORDER BY c.utc DESC, c.back) AS place FROM c JOIN c t ON t.back = 1 AND t.o_custkey = c.o_custkey")
def rev_list(spark, d):
    commits = _commits(spark, d)
    return history.rev_list(commits, commits.where("back = 1").select("oid")).drop("depth")


@_query(f"WITH c AS {_COMMITS} SELECT a.oid AS src, b.oid AS dest, a.back <= b.back AS allowed FROM c a JOIN c b ON a.o_custkey = b.o_custkey")
def fast_forwards(spark, d):
    """All ordered pairs of a customer's commits."""
    commits = _commits(spark, d)
    return history.fast_forwards_within(commits.where("parent IS NOT NULL").select(F.col("oid").alias("child"), "parent"), commits, "o_custkey")


_REFS = f"(SELECT CASE WHEN n_chars > 500 THEN 'refs/tags/' ELSE 'refs/heads/' END || source || '-' || doc_id AS name, {_OID} AS oid FROM documents)"


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.when(F.col("n_chars") > 500, "refs/tags/").otherwise("refs/heads/"), "source", F.lit("-"), "doc_id").alias("name"), text_id(F.col("text")).alias("oid"))


@_query(f"SELECT oid, string_agg(substr(name, 11), ',' ORDER BY substr(name, 11)) AS names FROM {_REFS} WHERE starts_with(name, 'refs/tags/') GROUP BY oid")
def tags_by_object(spark, d):
    return history.names_by_object(_refs(spark, d))


@_query(
    f"""
    WITH n AS (SELECT DISTINCT source || '-' || doc_id AS name FROM documents UNION SELECT DISTINCT {_OID} FROM ({_WORDS_SQL})), r AS (SELECT replace(name, 'refs/heads/', '') AS name, oid FROM {_REFS} WHERE starts_with(name, 'refs/heads/'))
    SELECT n.name, coalesce(r.oid, o.oid) AS oid FROM n LEFT JOIN r USING (name) LEFT JOIN {_IDS} o ON n.name = o.oid
    """
)
def rev_parse(spark, d):
    docs = table(spark, d, "documents").select(F.concat_ws("-", "source", "doc_id").alias("name"))
    names = docs.union(_probe(spark, d).select("oid")).where("name IS NOT NULL").distinct()
    return history.resolve_names(names, _refs(spark, d).where("startswith(name, 'refs/heads/')"), _documents(spark, d))


@_query(
    """
    WITH RECURSIVE o AS (SELECT source, doc_id, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
    r(source, doc_id, n, k, pack, held, many) AS (
        SELECT source, doc_id, n, k, 0::bigint, n::bigint, 1 FROM o WHERE k = 1
        UNION ALL SELECT o.source, o.doc_id, o.n, o.k, CASE WHEN held >= 100000 OR many >= 100 THEN pack + 1 ELSE pack END, CASE WHEN held >= 100000 OR many >= 100 THEN o.n ELSE held + o.n END, CASE WHEN held >= 100000 OR many >= 100 THEN 1 ELSE many + 1 END
        FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1
    )
    SELECT source, doc_id, n, pack FROM r
    """
)
def pack_rollover(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("n"))
    return history.pack_numbers(rows, "doc_id", "n", "source", 100_000, 100)


# ---- listings of files

_OLD = "(SELECT '/' || p_brand || '/' || p_partkey AS name, p_size AS size, round(p_retailprice * 100)::bigint AS mtime, round(p_retailprice * 100)::bigint AS ctime, p_partkey AS ino, 1 AS nlink, 1 AS dev, CASE WHEN p_type = 'SMALL' THEN repeat('0', 40) ELSE sha1(p_name) END AS oid, 33188 AS gitmode, true AS present FROM part WHERE p_size <= 45)"
_NEW = "(SELECT '/' || p_brand || '/' || p_partkey AS name, p_size + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS size, round(p_retailprice * 100)::bigint AS mtime, round(p_retailprice * 100)::bigint + CASE WHEN p_type = 'LARGE' THEN 5 ELSE 0 END AS ctime, p_partkey AS ino, 1 AS nlink, 1 AS dev FROM part WHERE p_size >= 5)"


def _listings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, d, "part")
    name, cents = F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_partkey").alias("name"), F.round(F.col("p_retailprice") * 100).cast("long")
    fixed = [F.col("p_partkey").alias("ino"), F.lit(1).alias("nlink"), F.lit(1).alias("dev")]
    old = part.where("p_size <= 45").select(name, F.col("p_size").alias("size"), cents.alias("mtime"), cents.alias("ctime"), *fixed, F.when(F.col("p_type") == "SMALL", snapshot.EMPTY_ID).otherwise(F.sha1("p_name")).alias("oid"), F.lit(33188).alias("gitmode"), F.lit(True).alias("present"))
    new = part.where("p_size >= 5").select(name, (F.col("p_size") + F.when(F.col("p_type") == "PROMO", 1).otherwise(0)).alias("size"), cents.alias("mtime"), (cents + F.when(F.col("p_type") == "LARGE", 5).otherwise(0)).alias("ctime"), *fixed)
    return old, new


_DIFF = f"(SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'deleted' WHEN o.size <> n.size OR o.mtime <> n.mtime OR o.ctime <> n.ctime OR o.oid = repeat('0', 40) THEN 'stale' ELSE 'same' END AS status FROM {_OLD} o FULL JOIN {_NEW} n ON o.name = n.name)"


@_query(f"SELECT name, status FROM {_DIFF}")
def index_diff(spark, d):
    return snapshot.compare_snapshots(*_listings(spark, d))


@_query(f"SELECT name FROM {_DIFF} WHERE status = 'stale'")
def stale_entries(spark, d):
    return snapshot.compare_snapshots(*_listings(spark, d)).where("status = 'stale'").select("name")


@_query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'D' WHEN p_type = 'SMALL' AND p_retailprice < 1000 THEN 'A' WHEN p_retailprice < 1000 THEN 'M' ELSE ' ' END AS status FROM part")
def status_amd(spark, d):
    oid = F.when(F.col("p_type") == "SMALL", snapshot.EMPTY_ID).otherwise("x")
    return table(spark, d, "part").select("p_partkey", snapshot.status_letter(F.col("p_size") <= 45, F.col("p_retailprice") >= 1000, oid).alias("status"))


@_query(f"SELECT name, least(mtime, 95000) AS mtime, least(ctime, 95000) AS ctime FROM {_NEW}")
def clamp_times(spark, d):
    return snapshot.clamp_times(_listings(spark, d)[1], F.lit(95000)).select("name", F.col("mtime").cast("long").alias("mtime"), F.col("ctime").cast("long").alias("ctime"))


@_query(
    """
    WITH u AS (SELECT '/' || p_brand || '/' || p_partkey AS name, p_retailprice > 1000 AS valid, CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END AS ctime, 0 AS f FROM part WHERE p_size <= 45
    UNION ALL SELECT '/' || p_brand || '/' || p_partkey, p_size % 2 = 0, CASE WHEN p_type = 'LARGE' THEN 0 ELSE 1 END, 1 FROM part WHERE p_size >= 5)
    SELECT name, f AS listing FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY valid::int, (ctime = 0)::int, f) AS n FROM u) WHERE n = 1
    """
)
def index_merge_precedence(spark, d):
    """Two listings of the whole table that share most names."""
    part, name = table(spark, d, "part"), F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_partkey").alias("name")
    real = lambda kind: F.when(F.col("p_type") == kind, 0).otherwise(1).alias("ctime")
    first = part.where("p_size <= 45").select(name, (F.col("p_retailprice") > 1000).alias("valid"), real("SMALL"), F.lit(0).alias("listing"))
    second = part.where("p_size >= 5").select(name, (F.col("p_size") % 2 == 0).alias("valid"), real("LARGE"), F.lit(1).alias("listing"))
    return snapshot.merge_listings(first, second).select("name", "listing")


@_query(
    """
    WITH f AS (SELECT '/' || p_brand || '/' || p_name || '/' || p_partkey AS name, p_size < 50 AS valid FROM part), b AS (SELECT name FROM f WHERE NOT valid),
    r AS (SELECT name, valid FROM f UNION ALL SELECT DISTINCT '/' || p_brand || '/' || p_name || '/', true FROM part UNION ALL SELECT DISTINCT '/' || p_brand || '/', true FROM part)
    SELECT name, valid AND NOT (ends_with(name, '/') AND EXISTS (SELECT 1 FROM b WHERE starts_with(b.name, r.name))) AS valid FROM r
    """
)
def parent_invalidation(spark, d):
    part = table(spark, d, "part")
    files = part.select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit("/"), "p_partkey").alias("name"), (F.col("p_size") < 50).alias("valid"))
    inner = part.select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_name", F.lit("/")).alias("name")).distinct().withColumn("valid", F.lit(True))
    outer = part.select(F.concat(F.lit("/"), "p_brand", F.lit("/")).alias("name")).distinct().withColumn("valid", F.lit(True))
    return snapshot.invalidate_parents(files.unionByName(inner).unionByName(outer))


def _inodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.concat(F.lit("/"), "o_orderkey").alias("path"), F.col("o_orderstatus").alias("dev"), F.col("o_custkey").alias("ino"), F.lit(2).alias("nlink"), F.lit(33188).alias("mode"))


_INODES = "(SELECT '/' || o_orderkey AS path, o_orderstatus AS dev, o_custkey AS ino FROM orders)"


@_query(f"SELECT dev, ino, count(*) AS links, min(path) AS first FROM {_INODES} GROUP BY dev, ino HAVING count(*) > 1")
def hardlink_groups(spark, d):
    return snapshot.hardlink_groups(_inodes(spark, d))


@_query(f"SELECT path, target FROM (SELECT path, min(path) OVER (PARTITION BY dev, ino) AS target FROM {_INODES}) WHERE path <> target")
def hardlink_targets(spark, d):
    return snapshot.hardlink_targets(_inodes(spark, d))


@_query("SELECT path, link_to FROM (SELECT '/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS path, min('/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey) OVER (PARTITION BY l_suppkey, l_returnflag, l_quantity) AS link_to FROM lineitem) WHERE path <> link_to")
def restore_links(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws("/", F.lit(""), "l_orderkey", "l_linenumber", "l_partkey").alias("path"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("oid"), F.col("l_quantity").alias("mtime"), F.lit(0).alias("ctime"), F.lit(0).alias("mode"))
    return snapshot.restore_links(rows)


@_query("SELECT path, link_to FROM (SELECT '/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS path, min('/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey) OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus, CASE WHEN l_quantity > 10 THEN l_linenumber END) AS link_to FROM lineitem) WHERE path <> link_to")
def restore_links_of_owners(spark, d):
    user, uid = F.col("l_linestatus").alias("user"), F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).alias("uid")
    rows = table(spark, d, "lineitem").select(F.concat_ws("/", F.lit(""), "l_orderkey", "l_linenumber", "l_partkey").alias("path"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("oid"), F.lit(0).alias("mtime"), F.lit(0).alias("ctime"), F.lit(0).alias("mode"), user, uid)
    return snapshot.restore_links(rows)


@_query(
    "WITH r AS (SELECT DISTINCT p_brand || ' ' || p_type || ' ' || p_size AS rec FROM part) SELECT rec, (sum(octet_length(encode(rec))) OVER (ORDER BY substr(md5(rec), 1, 3), md5(rec), rec ROWS UNBOUNDED PRECEDING) - octet_length(encode(rec)))::bigint AS ofs FROM r"
)
def metastore_offsets(spark, d):
    return snapshot.metadata_offsets(table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type", "p_size").alias("rec")), "rec")


@_query("SELECT sum(p_size) FILTER (WHERE p_type <> 'SMALL')::bigint AS bytes, count(*) FILTER (WHERE p_type <> 'SMALL') AS files, sum(p_size) FILTER (WHERE p_type <> 'SMALL' AND p_retailprice < 1000)::bigint AS todo_bytes, count(*) FILTER (WHERE p_type <> 'SMALL' AND p_retailprice < 1000) AS todo_files FROM part")
def save_totals(spark, d):
    return snapshot.save_totals(table(spark, d, "part").select(F.col("p_size").alias("size"), (F.col("p_retailprice") >= 1000).alias("valid"), (F.col("p_type") == "SMALL").alias("is_dir")))


_PATH = r"regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]*([^?#]*)", 1).alias("path"), "url")


@_query(f"WITH p AS (SELECT DISTINCT {_PATH} AS path FROM pages UNION SELECT '/fr/' UNION SELECT '/en/853/') SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.path <> p.path AND ends_with(q.path, '/') AND starts_with(p.path, q.path))")
def reduce_paths(spark, d):
    more = spark.createDataFrame([("/fr/",), ("/en/853/",)], "path string")
    return snapshot.reduce_paths(_paths(spark, d).select("path").union(more))


@_query(f"SELECT page_id, {_PATH} AS path FROM pages WHERE NOT regexp_matches({_PATH}, '^/fr/') AND NOT regexp_matches({_PATH}, '[0-9]7[0-9]*')")
def exclude_rx(spark, d):
    return snapshot.exclude_patterns(_paths(spark, d), ["^/fr/", "[0-9]7[0-9]*"]).select("page_id", "path")


@_query(f"SELECT page_id FROM pages WHERE NOT (starts_with({_PATH}, '/fr/') OR rtrim({_PATH}, '/') IN ('/fr', '/en/853'))")
def exclude_exact(spark, d):
    gone = spark.createDataFrame([("/fr",), ("/en/853/",)], "path string")
    return snapshot.exclude_paths(_paths(spark, d), gone).select("page_id")


@_query(f"SELECT DISTINCT q.prefix, {_PATH} AS name FROM pages JOIN (SELECT unnest(['/fr/', '/es/', '/none/']) AS prefix) q ON starts_with({_PATH}, q.prefix) UNION SELECT unnest(['/fr/', '/es/', '/none/']), unnest(['/fr/', '/es/', '/none/'])")
def prefix_scan(spark, d):
    wanted = spark.createDataFrame([("/fr/",), ("/es/",), ("/none/",)], "prefix string")
    return snapshot.filter_prefixes(_paths(spark, d).select(F.col("path").alias("name")), wanted)


@_query(
    f"""
    WITH s AS (SELECT page_id, [x FOR x IN string_split({_PATH}, '/') IF x <> '' AND x <> '.'] AS s FROM pages WHERE starts_with({_PATH}, '/'))
    SELECT page_id, 0 AS pos, '' AS name, '/' AS full_path FROM s UNION ALL SELECT page_id, i::int AS pos, s[i] AS name, '/' || array_to_string(s[1:i], '/') FROM s, range(1, 20) t(i) WHERE i <= len(s)
    """
)
def path_components(spark, d):
    return _paths(spark, d).select("page_id", F.posexplode(scalars.path_prefixes(F.col("path"))).alias("pos", "c")).select("page_id", "pos", F.col("c.name").alias("name"), F.col("c.full").alias("full_path"))


_CLEAN = f"'/' || array_to_string([x FOR x IN string_split({_PATH}, '/') IF x <> '' AND x <> '.'], '/')"


@_query(f"SELECT page_id, CASE WHEN starts_with(c, '/en/7') THEN substr(c, 6) WHEN starts_with(c, '/en') THEN substr(c, 4) WHEN starts_with(c, '/fr') THEN substr(c, 4) ELSE c END AS path FROM (SELECT page_id, {_CLEAN} AS c FROM pages)")
def strip_paths(spark, d):
    return _paths(spark, d).select("page_id", scalars.strip_prefix(F.col("path"), ["/en", "/fr/", "/en/7", "/"]).alias("path"))


@_query(f"SELECT page_id, CASE WHEN starts_with(c, '/en') THEN '/a/b' || substr(c, 4) WHEN starts_with(c, '/fr') THEN regexp_replace('/' || substr(c, 4), '^/+', '/') ELSE c END AS path FROM (SELECT page_id, {_CLEAN} AS c FROM pages)")
def graft_paths(spark, d):
    return _paths(spark, d).select("page_id", scalars.graft(F.col("path"), [("/en", "/a/b"), ("/fr", "/")]).alias("path"))


@_query(f"SELECT page_id, array_to_string(regexp_extract_all({_PATH}, '([^/]*/|[^/]+$)', 1), '|') AS pieces FROM pages")
def path_pieces(spark, d):
    return _paths(spark, d).select("page_id", F.array_join(scalars.path_pieces(F.col("path")), "|").alias("pieces"))


@_query(
    r"""SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS path FROM pages"""
)
def url_parts(spark, d):
    return _paths(spark, d).select("page_id", scalars.url_parts(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", "u.path")


# ---- directories


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("dir"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), F.when(F.col("p_type") == "PROMO", 0o040000).otherwise(0o100644).alias("mode"), F.sha1("p_name").alias("oid"), "p_partkey")


_ENTRIES = "(SELECT p_brand AS dir, p_name || ' ' || p_partkey AS name, CASE WHEN p_type = 'PROMO' THEN 16384 ELSE 33188 END AS mode, sha1(p_name) AS oid, p_partkey FROM part)"
_KEY = "name || CASE WHEN mode = 16384 THEN '/' ELSE '' END"


@_query(
    f"""
    WITH t AS (SELECT dir, string_agg(hex(encode(CASE WHEN mode = 16384 THEN '40000 ' ELSE '100644 ' END || name)) || '00' || upper(oid), '' ORDER BY {_KEY}) AS h, count(*) AS entries FROM {_ENTRIES} GROUP BY dir)
    SELECT dir, sha1(encode('tree ' || (length(h) // 2)) || unhex('00') || unhex(h)) AS oid, entries FROM t
    """
)
def tree_oid(spark, d):
    return tree_ids(_entries(spark, d), ["dir"])


@_query(f"SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY {_KEY}) AS pos FROM {_ENTRIES}")
def tree_sorted_entries(spark, d):
    from pyspark.sql import Window

    return _entries(spark, d).select("dir", "name", F.row_number().over(Window.partitionBy("dir").orderBy(entry_key(F.col("name"), F.col("mode")))).alias("pos"))


@_query(f"SELECT dir, name, mode::bigint AS mode, oid FROM {_ENTRIES}")
def tree_decode(spark, d):
    """Encoded directories read back."""
    from stratalith.functions.hashing import entry_hex

    piece = F.struct(F.encode(entry_key(F.col("name"), F.col("mode")), "UTF-8").alias("k"), entry_hex(F.col("mode"), F.col("name"), F.col("oid")).alias("h"))
    encoded = _entries(spark, d).groupBy("dir").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda e: e["h"]), "")).alias("content"))
    return encoded.select("dir", F.explode(codecs.tree_entries("content")).alias("e")).select("dir", "e.name", "e.mode", "e.oid")


@_query(
    f"""
    WITH t AS (SELECT dir, string_agg(hex(encode('100644 ' || name)) || '00' || upper(oid), '' ORDER BY name) AS h, count(*) AS entries FROM {_ENTRIES} GROUP BY dir),
    i AS (SELECT dir, entries, sha1(encode('tree ' || (length(h) // 2)) || unhex('00') || unhex(h)) AS oid FROM t),
    r AS (SELECT string_agg(hex(encode('40000 ' || dir)) || '00' || upper(oid), '' ORDER BY dir || '/') AS h, count(*) AS entries FROM i)
    SELECT dir, oid, entries FROM i UNION ALL SELECT '', sha1(encode('tree ' || (length(h) // 2)) || unhex('00') || unhex(h)), entries FROM r
    """
)
def directory_trees(spark, d):
    files = _entries(spark, d).select(F.concat(F.lit("/"), "dir", F.lit("/"), "name").alias("path"), F.lit(0o100644).alias("mode"), "oid")
    return vfs.directory_ids(files)


@_query()
def dir_split_groups(spark, d):
    return dirsplit.split_directories(table(spark, d, "customer"), "c_mktsegment", "c_name")


@_query(
    f"""
    WITH e AS (SELECT DISTINCT dir, name FROM {_ENTRIES}), p AS (SELECT a.dir, a.name, 1 + list_max([k FOR k IN range(0, least(length(a.name), length(b.name))) IF substr(a.name, 1, k) = substr(b.name, 1, k)]) AS n
        FROM e a JOIN e b ON a.dir = b.dir AND NOT starts_with(a.name, b.name) AND NOT starts_with(b.name, a.name))
    SELECT e.dir AS directory, e.name, substr(e.name, 1, greatest(coalesce(max(n), 0), CASE WHEN starts_with(e.name, '..') THEN 3 WHEN starts_with(e.name, '.') THEN 2 ELSE 1 END)::int) AS short
    FROM e LEFT JOIN p ON e.dir = p.dir AND e.name = p.name GROUP BY e.dir, e.name
    """
)
def dir_abbrev(spark, d):
    return dirsplit.abbreviations(_entries(spark, d), "dir", "name")


@_query(f"SELECT dir, 1 + count(*) FILTER (WHERE mode <> 16384) AS expected FROM {_ENTRIES} GROUP BY dir")
def metadata_counts(spark, d):
    return vfs.metadata_counts(_entries(spark, d))


@_query("WITH c AS (SELECT c_nationkey AS dir, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), s AS (SELECT s_nationkey AS dir, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) "
        "SELECT c.dir, c.c_name AS name, CASE WHEN c.n = s.n THEN s.s_name END AS record, coalesce(c.n = s.n, false) AS aligned FROM c LEFT JOIN s ON c.dir = s.dir AND c.r = s.r")  # fmt: skip
def align_metadata(spark, d):
    entries = table(spark, d, "customer").select(F.col("c_nationkey").alias("dir"), F.col("c_name").alias("name"))
    records = table(spark, d, "supplier").select(F.col("s_nationkey").alias("dir"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("record"))
    return vfs.align_metadata(entries, records)


@_query("SELECT p_brand AS dir, p_partkey, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) > 1 AS duplicate FROM part")
def duplicate_names(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("dir"), F.col("p_name").alias("name"), "p_partkey")
    return vfs.first_by_name(rows, order="p_partkey").select("dir", "p_partkey", "duplicate")


@_query(f"SELECT regexp_extract(url, '^([a-z]+):', 1) AS save, count(DISTINCT string_split({_PATH}, '/')[2]) AS roots FROM pages WHERE {_PATH} <> '' GROUP BY 1 HAVING count(DISTINCT string_split({_PATH}, '/')[2]) > 1")
def root_collisions(spark, d):
    return vfs.root_collisions(_paths(spark, d).where("path <> ''").withColumn("save", F.regexp_extract("url", "^([a-z]+):", 1)), "save")


@_query("SELECT c_custkey, coalesce(n_name, c_nationkey::varchar) AS owner FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def owner_map(spark, d):
    mapping = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("old"), F.col("n_name").alias("new"))
    return vfs.map_owners(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("owner")), mapping, "owner")


@_query("SELECT s_suppkey, coalesce(n_name, '') AS owner FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 1")
def owner_names(spark, d):
    accounts = table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return vfs.owner_names(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), accounts, "s_nationkey", "owner").select("s_suppkey", "owner")


@_query(
    "WITH f AS (SELECT '/' || p_brand || '/' || p_type || '/' || p_partkey AS path, p_size AS size, p_brand, p_type FROM part), e AS (SELECT '/' AS dir, size FROM f UNION ALL SELECT '/' || p_brand, size FROM f UNION ALL SELECT '/' || p_brand || '/' || p_type, size FROM f) SELECT dir, sum(size)::bigint AS bytes, count(*) AS files FROM e GROUP BY dir"
)
def disk_usage(spark, d):
    return vfs.usage(table(spark, d, "part").select(F.concat_ws("/", F.lit(""), "p_brand", "p_type", "p_partkey").alias("path"), F.col("p_size").alias("size")))


@_query(f"SELECT coalesce(o.name, n.name) AS path, CASE WHEN n.name IS NULL THEN 'only_left' WHEN o.name IS NULL THEN 'only_right' WHEN o.size <> n.size THEN 'content' ELSE 'mode' END AS difference FROM {_OLD} o FULL JOIN {_NEW} n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.size <> n.size OR o.ctime <> n.ctime")
def compare_trees(spark, d):
    old, new = (x.select(F.col("name").alias("path"), F.col("size").alias("oid"), F.col("ctime").alias("mode")) for x in _listings(spark, d))
    return vfs.compare_trees(old, new)


@_query("SELECT page_id, url FROM pages WHERE NOT starts_with(regexp_extract(url, '^[a-z]+://([^/]*)', 1), 'm.')")
def hidden_filter(spark, d):
    """Hosts that begin with 'm.' stand for hidden names."""
    named = table(spark, d, "pages").select("page_id", "url", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), r"^m\.", ".").alias("name"))
    return vfs.list_directory(named).select("page_id", "url")


@_query(f"SELECT page_id, CASE WHEN n = 0 THEN 'root' WHEN n = 1 THEN 'branch' WHEN n = 2 THEN 'save' ELSE 'inside' END AS kind FROM (SELECT page_id, len([x FOR x IN string_split({_PATH}, '/') IF x <> '' AND x <> '.']) AS n FROM pages)")
def path_kinds(spark, d):
    return _paths(spark, d).select("page_id", vfs.path_kind(F.col("path")).alias("kind"))


@_query("SELECT doc_id FROM documents WHERE octet_length(encode(text)) < 1000")
def size_filter(spark, d):
    return table(spark, d, "documents").where(F.octet_length("text") < 1000).select("doc_id")


@_query("SELECT page_id FROM pages WHERE url LIKE 'http://%/en/%'")
def glob_filter(spark, d):
    return table(spark, d, "pages").where(vfs.glob_match(F.col("url"), "http://*/en/*")).select("page_id")


@_query("SELECT lower(c_mktsegment) AS root, '/' || n_name || '/' || c_custkey AS path, CASE WHEN n_regionkey < 4 THEN 'c' || c_custkey END AS oid FROM customer JOIN nation ON c_nationkey = n_nationkey")
def subtree_ids(spark, d):
    cust, nation = table(spark, d, "customer"), table(spark, d, "nation")
    tops = cust.select(F.lower("c_mktsegment").alias("s"), "c_nationkey").distinct().join(nation.where("n_regionkey < 4"), F.col("c_nationkey") == F.col("n_nationkey"))
    upper = tops.select(F.col("s").alias("tree"), F.col("n_name").alias("name"), F.concat("s", F.lit(":"), "n_name").alias("oid"))
    lower = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lower("c_mktsegment"), F.lit(":"), "n_name").alias("tree"), F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("c"), "c_custkey").alias("oid"))
    paths = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("c_mktsegment").alias("root"), F.concat_ws("/", F.lit(""), "n_name", "c_custkey").alias("path"))
    return graph.subtree_ids(upper.unionByName(lower), paths)


@_query(
    "SELECT '/' || n_name || '/' || c_name AS path, CASE WHEN n_regionkey < 4 THEN '/' || n_name || '/' || c_name END AS node, CASE WHEN n_regionkey < 4 THEN NULL ELSE 'ENOENT' END AS error FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "UNION ALL SELECT '/links/' || c_custkey || '/..', CASE WHEN n_regionkey < 4 THEN '/' END, CASE WHEN n_regionkey < 4 THEN NULL ELSE 'ENOENT' END FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
def resolve_paths(spark, d):
    cust, nation = table(spark, d, "customer"), table(spark, d, "nation")
    j = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string").alias("target")
    dirs = nation.where("n_regionkey < 4").select(F.lit("/").alias("parent"), F.col("n_name").alias("name"), F.concat(F.lit("/"), "n_name").alias("node"), F.lit("dir").alias("kind"), none)
    files = j.select(F.concat(F.lit("/"), "n_name").alias("parent"), F.col("c_name").alias("name"), F.concat_ws("/", F.lit(""), "n_name", "c_name").alias("node"), F.lit("file").alias("kind"), none)
    box = spark.createDataFrame([("/", "links", "/links", "dir", None)], "parent string, name string, node string, kind string, target string")
    links = j.select(F.lit("/links").alias("parent"), F.col("c_custkey").cast("string").alias("name"), F.concat(F.lit("/links/"), "c_custkey").alias("node"), F.lit("link").alias("kind"), F.concat(F.lit("../"), "n_name", F.lit("/.")).alias("target"))
    wanted = j.select(F.concat_ws("/", F.lit(""), "n_name", "c_name").alias("path")).union(j.select(F.concat(F.lit("/links/"), "c_custkey", F.lit("/.."))))
    return vfs.resolve(dirs.unionByName(files).unionByName(box).unionByName(links), wanted)


# ---- object graphs

_NODES = "(SELECT 'r' || r_regionkey AS node, 'commit' AS kind, 'base' AS pack FROM region UNION ALL SELECT 'n' || n_nationkey, 'tree', 'base' FROM nation UNION ALL SELECT 'c' || c_custkey, 'tree', c_mktsegment FROM customer UNION ALL SELECT 'o' || o_orderkey, 'blob', strftime(o_orderdate, '%Y-%m') FROM orders)"
_EDGES = "(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"
_ROOTS = "(SELECT 'r' || r_regionkey AS node FROM region WHERE r_name <> 'AFRICA')"
_REACH = f"reach(node) AS (SELECT node FROM {_ROOTS} UNION SELECT dst FROM reach JOIN {_EDGES} ON node = src)"


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), column)


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, objects, roots)."""
    region, nation, cust, orders = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    edges = nation.select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst")).unionByName(cust.select(_id("n", "c_nationkey").alias("src"), _id("c", "c_custkey").alias("dst"))).unionByName(orders.select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst")))
    row = lambda df, p, k, kind, pack: df.select(_id(p, k).alias("node"), F.lit(kind).alias("kind"), pack.alias("pack"))
    objects = row(region, "r", "r_regionkey", "commit", F.lit("base")).unionByName(row(nation, "n", "n_nationkey", "tree", F.lit("base"))).unionByName(row(cust, "c", "c_custkey", "tree", F.col("c_mktsegment"))).unionByName(row(orders, "o", "o_orderkey", "blob", F.date_format("o_orderdate", "yyyy-MM")))
    return edges, objects, region.where("r_name <> 'AFRICA'").select(_id("r", "r_regionkey").alias("node"))


@_query(f"WITH RECURSIVE {_REACH} SELECT node FROM reach")
def reachable_objects(spark, d):
    edges, _, roots = _graph(spark, d)
    return graph.reachable(edges, roots)


@_query(f"WITH s AS (SELECT node FROM {_NODES} WHERE pack <> 'BUILDING') SELECT DISTINCT src, dst FROM {_EDGES} WHERE src IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM s)")
def dangling_links(spark, d):
    edges, objects, _ = _graph(spark, d)
    return graph.dangling(edges, objects.where("pack <> 'BUILDING'"))


@_query(f"WITH RECURSIVE {_REACH} SELECT node FROM reach WHERE node NOT IN (SELECT node FROM {_NODES} WHERE pack <> 'BUILDING')")
def missing_reachable(spark, d):
    edges, objects, roots = _graph(spark, d)
    return graph.missing_reachable(edges, roots, objects.where("pack <> 'BUILDING'"))


@_query(
    f"WITH RECURSIVE p AS (SELECT node FROM {_NODES} WHERE pack IN ('BUILDING', 'MACHINERY')), reach(node) AS (SELECT node FROM {_ROOTS} UNION SELECT dst FROM reach JOIN {_EDGES} ON node = src WHERE node NOT IN (SELECT node FROM p)) SELECT node FROM reach WHERE node NOT IN (SELECT node FROM p)"
)
def transfer_set(spark, d):
    edges, objects, roots = _graph(spark, d)
    return graph.transfer_set(edges, roots, objects.where("pack IN ('BUILDING', 'MACHINERY')").select("node"))


@_query(f"WITH RECURSIVE {_REACH} SELECT node FROM {_NODES} WHERE node NOT IN (SELECT node FROM reach)")
def unreachable_objects(spark, d):
    edges, objects, roots = _graph(spark, d)
    return graph.unreachable(edges, roots, objects)


_SWEEP = f"""c AS (SELECT pack, count(*) AS total, count(r.node) AS live, count(*) FILTER (WHERE r.node IS NULL AND kind <> 'blob') AS dead FROM {_NODES} n LEFT JOIN reach r ON n.node = r.node GROUP BY pack),
    plan AS (SELECT pack, total, live, CASE WHEN live = 0 THEN 'delete' WHEN dead = 0 AND live / total > 0.9 THEN 'keep' ELSE 'rewrite' END AS decision FROM c)"""


@_query(f"WITH RECURSIVE {_REACH}, {_SWEEP} SELECT pack, total, live, decision FROM plan")
def gc_decisions(spark, d):
    edges, objects, roots = _graph(spark, d)
    return graph.sweep_plan(objects, graph.reachable(edges, roots))


@_query(f"WITH RECURSIVE {_REACH}, {_SWEEP} SELECT round(100.0 * sum(CASE WHEN decision = 'keep' THEN 0 ELSE total - live END)::double / sum(total)::double, 6) AS percent FROM plan")
def gc_discard_pct(spark, d):
    return graph.discarded_percent(gc_decisions(spark, d))


# ---- scalars

_MODES = "CASE l_returnflag WHEN 'A' THEN 32768 WHEN 'N' THEN 16384 ELSE 40960 END + (l_partkey % 512)"


@_query(
    f"""
    WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({_MODES})::int AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE m & 61440 WHEN 32768 THEN '-' WHEN 16384 THEN 'd' ELSE 'l' END || array_to_string([CASE WHEN m & (256 >> i) <> 0 THEN substr('rwxrwxrwx', i + 1, 1) ELSE '-' END FOR i IN range(0, 9)], '') AS mode,
        CASE WHEN m & 61440 = 16384 THEN '/' WHEN m & 61440 = 40960 THEN '@' WHEN m & 73 <> 0 THEN '*' ELSE '' END AS mark FROM m
    """
)
def mode_string(spark, d):
    m = F.when(F.col("l_returnflag") == "A", 0o100000).when(F.col("l_returnflag") == "N", 0o040000).otherwise(0o120000) + (F.col("l_partkey") % 512).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalars.mode_string(m).alias("mode"), scalars.type_mark(m).alias("mark"))


@_query(
    "SELECT doc_id, CASE WHEN s < 1024 THEN s::bigint::varchar WHEN s < 1048576 THEN printf('%.1fK', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1fM', s / 1048576.0) ELSE printf('%.1fG', s / 1073741824.0) END AS size FROM (SELECT doc_id, n_chars * n_chars * 16 AS s FROM documents)"
)
def human_size(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.human_size(F.col("n_chars") * F.col("n_chars") * 16).alias("size"))


@_query(
    "SELECT p_partkey, rpad('-rw-r--r--', 10, ' ') || ' ' || rpad(o, greatest(length(o), 11)::int, ' ') || ' ' || lpad(p_size::varchar, 11, ' ') || ' ' || strftime(make_timestamp(p_size::bigint * 86400000000), '%Y-%m-%d %H:%M') || ' ' || p_name AS line FROM (SELECT *, p_brand || '/' || p_type AS o FROM part)"
)
def ls_long(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lit(0o100644).alias("mode"), F.col("p_brand").alias("user"), F.col("p_type").alias("grp"), F.col("p_size").alias("size"), (F.col("p_size").cast("long") * 86400).alias("mtime"), F.col("p_name").alias("name"))
    return rows.select("p_partkey", vfs.long_line().alias("line"))


@_query(
    """
    WITH n AS (SELECT p_partkey, p_name || CASE p_type WHEN 'SMALL' THEN '.sl' WHEN 'LARGE' THEN '.slx' ELSE '' END AS name, CASE p_type WHEN 'PROMO' THEN 16384 ELSE 33188 END AS stored FROM part)
    SELECT p_partkey, CASE WHEN stored = 16384 THEN name || '.sl' WHEN ends_with(name, '.sl') OR ends_with(substr(name, 1, length(name) - 1), '.sl') THEN name || '.sll' ELSE name END AS marked, name AS plain FROM n
    """
)
def mangle_names(spark, d):
    name = F.concat("p_name", F.when(F.col("p_type") == "SMALL", ".sl").when(F.col("p_type") == "LARGE", ".slx").otherwise(""))
    stored = F.when(F.col("p_type") == "PROMO", 0o040000).otherwise(0o100644)
    marked = scalars.mark_name(name, F.lit(0o100644), stored)
    return table(spark, d, "part").select("p_partkey", marked.alias("marked"), scalars.unmark_name(marked, stored)["name"].alias("plain"))


@_query(
    "SELECT p_partkey, (p_retailprice * pow(1024.0, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END))::decimal(38, 9)::double AS raw, trunc(p_retailprice * pow(1024.0, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END))::bigint AS bytes FROM part"
)
def parse_sizes(spark, d):
    unit = F.when(F.col("p_type") == "SMALL", "").when(F.col("p_type") == "MEDIUM", "k").when(F.col("p_type") == "LARGE", " MB").otherwise(" gb")
    power = F.when(F.col("p_type") == "SMALL", 0).when(F.col("p_type") == "MEDIUM", 1).when(F.col("p_type") == "LARGE", 2).otherwise(3)
    part = table(spark, d, "part")
    return part.select("p_partkey", (F.col("p_retailprice") * F.pow(F.lit(1024.0), power)).cast("decimal(38,9)").cast("double").alias("raw"), scalars.parse_size(F.concat(F.col("p_retailprice").cast("string"), unit)).alias("bytes"))


@_query(
    "SELECT p_partkey, (p_size * CASE p_type WHEN 'SMALL' THEN 1 WHEN 'MEDIUM' THEN 3600 WHEN 'LARGE' THEN 604800 WHEN 'PROMO' THEN 2678400 WHEN 'ECONOMY' THEN 31622400 END)::double AS seconds, p_size::bigint * CASE p_type WHEN 'SMALL' THEN 1000000000 WHEN 'MEDIUM' THEN 1000000 WHEN 'LARGE' THEN 1000 WHEN 'PROMO' THEN 1 END AS ns FROM part"
)
def parse_periods(spark, d):
    kind = lambda *u: F.element_at(F.create_map(*(F.lit(x) for pair in zip(("SMALL", "MEDIUM", "LARGE", "PROMO", "ECONOMY", "STANDARD"), u, strict=True) for x in pair)), F.col("p_type"))
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", scalars.period_seconds(F.concat(size, kind("s", "h", "w", "m", "y", "?"))).alias("seconds"), scalars.parse_timestamp_ns(F.concat(size, kind("s", "ms", "us", "ns", "", "x"))).alias("ns"))


@_query("SELECT p_partkey, CASE WHEN p_type <> 'SMALL' THEN p_size END AS depth FROM part")
def tree_depth(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.split_depth(F.concat("p_name", F.when(F.col("p_type") == "SMALL", "-").otherwise("."), "p_size", F.lit(".sld"))).alias("depth"))


@_query(
    "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_size::bigint * CASE p_type WHEN 'MEDIUM' THEN 1024 WHEN 'LARGE' THEN 1048576 WHEN 'PROMO' THEN 1073741824 ELSE 1 END END AS number, CASE WHEN p_size = 1 THEN true WHEN p_size = 0 THEN false END AS flag FROM part"
)
def config_values(spark, d):
    unit = F.when(F.col("p_type") == "SMALL", "q").when(F.col("p_type") == "MEDIUM", "k").when(F.col("p_type") == "LARGE", "M").when(F.col("p_type") == "PROMO", "g").otherwise("")
    return table(spark, d, "part").select("p_partkey", scalars.parse_config_int(F.concat(F.col("p_size").cast("string"), unit)).alias("number"), scalars.parse_config_bool(F.col("p_size").cast("string")).alias("flag"))


@_query('''SELECT page_id, '"' || replace(url, '"', '""') || '"' AS quoted FROM pages''')
def sql_quoting(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.sql_identifier(F.col("url")).alias("quoted"))


@_query("SELECT page_id, CASE WHEN regexp_full_match(url, '[a-zA-Z0-9_./-]+') THEN url ELSE '''' || url || '''' END AS word FROM pages")
def shell_quoting(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.shell_quote(F.col("url")).alias("word"))


@_query("SELECT page_id, NOT (regexp_matches(url, '[?*:^~ \\[\\\\]|@\\{|/{2}|\\.{2}') OR ends_with(url, '/') OR ends_with(url, '.')) AS valid FROM pages")
def valid_names(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.valid_ref_name(F.col("url")).alias("valid"))


@_query(
    """
    WITH c AS (SELECT o_orderkey, sha1(o_orderkey::varchar) AS tree, CASE WHEN o_orderstatus <> 'P' THEN sha1(o_custkey::varchar) END AS parent, floor(epoch(o_orderdate))::bigint AS sec FROM orders)
    SELECT o_orderkey, sha1('tree ' || tree || chr(10) || coalesce('parent ' || parent || chr(10), '') || 'author A <a@x> ' || sec || ' +0100' || chr(10) || 'committer C <c@x> ' || sec || ' -0330' || chr(10) || chr(10) || 'saved') AS digest, parent IS NOT NULL AS has_parent, sec AS author_sec, -12600 AS committer_offset FROM c
    """
)
def commit_blob(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.sha1(F.col("o_orderkey").cast("string")).alias("tree"), F.when(F.col("o_orderstatus") != "P", F.sha1(F.col("o_custkey").cast("string"))).alias("parent"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("sec"))
    text = scalars.commit_text(F.col("tree"), F.col("parent"), F.lit("A <a@x>"), F.col("sec"), F.lit(3600), F.lit("C <c@x>"), F.col("sec"), F.lit(-12600), F.lit("saved"))
    read = rows.select("o_orderkey", text.alias("t")).withColumn("f", scalars.commit_fields(F.col("t")))
    return read.select("o_orderkey", F.sha1("t").alias("digest"), (F.size("f.parents") > 0).alias("has_parent"), F.col("f.author_sec").alias("author_sec"), F.col("f.committer_offset").alias("committer_offset"))


_VUINT = "array_to_string([printf('%02X', ((x >> (7 * i)) & 127) | CASE WHEN (x >> (7 * i + 7)) > 0 THEN 128 ELSE 0 END) FOR i IN range(0, 9) IF i = 0 OR (x >> (7 * i)) > 0], '')"


@_query(f"SELECT doc_id, {_VUINT} AS encoded, n_chars * 3 AS decoded FROM (SELECT doc_id, n_chars, n_chars * n_chars AS x FROM documents)")
def vint_hex(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", codecs.vuint_hex(F.col("n_chars") * F.col("n_chars")).alias("encoded"), codecs.vint_value(F.unhex(codecs.vint_hex(F.col("n_chars") * 3))).alias("decoded"))


@_query("SELECT doc_id, 'blob' AS kind, sha1(text) AS digest FROM documents")
def pack_records(spark, d):
    back = codecs.object_content(codecs.object_record(F.lit("blob"), _content()))
    return table(spark, d, "documents").select("doc_id", back.alias("o")).select("doc_id", "o.kind", F.sha1("o.content").alias("digest"))


@_query("SELECT p_partkey, p_name AS path, 33188 AS mode, p_size::bigint AS size, -p_size::bigint AS mtime, p_brand AS user FROM part")
def metadata_records(spark, d):
    fields = F.struct(F.col("p_name").alias("path"), F.lit(0o100644).cast("long").alias("mode"), F.col("p_size").cast("long").alias("size"), (-F.col("p_size")).cast("long").alias("mtime"), F.col("p_brand").alias("user"))
    read = table(spark, d, "part").select("p_partkey", codecs.metadata_fields(codecs.metadata_record(fields)).alias("m"))
    return read.select("p_partkey", "m.path", F.col("m.mode").cast("int").alias("mode"), "m.size", "m.mtime", "m.user")


@_query("SELECT doc_id, doc_id % 7 <> 0 AS intact FROM documents WHERE text IS NOT NULL")
def verify_objects(spark, d):
    """Recomputed ids of what was read back from records against the ids that were stored; every seventh content was damaged."""
    from stratalith.functions.hashing import object_id

    damaged = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    docs = _documents(spark, d).where("text IS NOT NULL").withColumn("text", damaged)
    stored = docs.select("doc_id", "oid", codecs.object_content(codecs.object_record(F.lit("blob"), _content())).alias("o"))
    return stored.select("doc_id", (object_id(F.col("o.content")) == F.col("oid")).alias("intact"))


@_query("SELECT CASE WHEN event_type = 'error' THEN 'inc' ELSE 'full' END AS kind, floor(epoch(ts))::bigint AS utc FROM events WHERE event_type <> 'view'")
def import_times(spark, d):
    lines = table(spark, d, "events").select("event_id", F.concat(F.when(F.col("event_type") == "error", " inc ").when(F.col("event_type") == "view", "skip ").otherwise("full "), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit(" 1")).alias("value"))
    return backup_times(lines.select("value"))


# ---- streams


@_query("SELECT event_type AS channel, event_id AS ord, p::int AS part, (least(4, octet_length(encode(props)) - 4 * p))::int AS len, substr(props, 4 * p + 1, 4) AS payload FROM events, range(0, 10) t(p) WHERE 4 * p < octet_length(encode(props))")
def mux_frames(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", F.encode("props", "UTF-8").alias("props"))
    return ingest.frames(rows, F.col("event_type"), "event_id", "props", 4).withColumn("payload", F.decode("payload", "UTF-8"))


@_query("SELECT event_type AS channel, event_id AS ord, props AS payload FROM events")
def demux_frames(spark, d):
    return ingest.unframe(ingest.frames(table(spark, d, "events").select("event_id", "event_type", F.encode("props", "UTF-8").alias("props")), F.col("event_type"), "event_id", "props", 4)).withColumn("payload", F.decode("payload", "UTF-8"))


@_query(f"SELECT oid FROM {_IDS}")
def stream_dedup(spark, d):
    stream = ingest.stream_table(spark, f"{d}/documents.parquet").select(text_id(F.col("text")).alias("oid")).where("oid IS NOT NULL")
    store = fresh_folder(spark, "stream-store")
    ingest.ingest_objects(stream, store, fresh_folder(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.schema("oid string").parquet(store)


@_query(
    f"SELECT name, size FROM (SELECT coalesce(n.name, o.name) AS name, coalesce(n.size, o.size) AS size FROM {_OLD} o FULL JOIN {_NEW} n ON o.name = n.name) WHERE size IS NOT NULL"
)
def listing_update(spark, d):
    old, new = _listings(spark, d)
    listing = old.select("name", F.col("size").cast("int").alias("size"), F.lit(True).alias("valid"))
    return ingest.update_listing(listing, new.select("name", F.col("size").cast("int").alias("size"), F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))).select("name", "size")


from stratalith.plans import further  # noqa: E402, F401  registers its queries
