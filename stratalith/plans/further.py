"""Queries of the catalogue for single predicates, functions and upkeep, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalith.functions import scalars
from stratalith.operators import dirsplit, history, membership, snapshot, vfs
from stratalith.plans.catalogue import _ENTRIES, _IDS, _OID, _PATH, _documents, _entries, _paths, _query, table
from stratalith.sources import faults, files
from stratalith.streaming import ingest

# ---- scans and name sets


@_query("SELECT p_partkey, '/' || p_brand || '/' || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY '/' || p_brand || '/' || p_partkey DESC) AS pos FROM part")
def index_scan(spark, d):
    """A listing in the order that it is stored in: descending names."""
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_partkey").alias("name"))
    return rows.select("p_partkey", "name", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("name"))).alias("pos"))


@_query(f"SELECT d.doc_id, d.source FROM documents d JOIN (SELECT DISTINCT lower(p_type) AS kind FROM part) k ON true WHERE d.source = k.kind OR d.doc_id IN (SELECT doc_id FROM labels) AND k.kind = (SELECT min(lower(p_type)) FROM part)")
def named_rows(spark, d):
    """Rows whose names are in a set of names: the labelled documents, and those of sources named as a type."""
    docs, kinds = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "part").select(F.lower("p_type").alias("source")).distinct()
    labelled = docs.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return labelled.select("doc_id", "source").unionByName(docs.join(kinds, "source", "left_semi").select("doc_id", "source")).distinct()


@_query(f"SELECT DISTINCT rtrim({_PATH}, '/') AS path FROM pages")
def unique_paths(spark, d):
    return _paths(spark, d).select(F.rtrim("path", F.lit("/")).alias("path")).distinct()


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' OR l_linenumber = 1")
def same_device(spark, d):
    """Return flags stand for devices, first lines for mount points."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("dev"), (F.col("l_linenumber") == 1).alias("is_mount"))
    return snapshot.same_device(rows, F.lit("A")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_query("SELECT c_custkey, c_name FROM (SELECT *, lag(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS prev FROM customer) WHERE c_acctbal >= prev")
def order_violations(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("listing"), "c_acctbal")
    return snapshot.order_violations(rows, "c_custkey", "c_acctbal").select("c_custkey", "c_name")


@_query(f"SELECT doc_id, n_chars % 2 = 0 AND text IN (SELECT text FROM benchmark UNION SELECT text FROM documents WHERE lang = 'en') AS saved FROM documents")
def already_saved(spark, d):
    docs = table(spark, d, "documents")
    stored = _ids(docs.where("lang = 'en'")).unionByName(_ids(table(spark, d, "benchmark")))
    rows = _documents(spark, d).select("doc_id", "oid").join(docs.select("doc_id", (F.col("n_chars") % 2 == 0).alias("valid")), "doc_id")
    return snapshot.already_saved(rows, stored).select("doc_id", "saved")


def _ids(df: DataFrame) -> DataFrame:
    from stratalith.functions.hashing import text_id

    return df.select(text_id(F.col("text")).alias("oid"))


# ---- metadata


@_query("SELECT c_custkey, 7::bigint AS uid, NULL::varchar AS user, c_mktsegment AS grp FROM customer")
def edit_metadata(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("uid"), F.col("c_name").alias("user"), F.col("c_mktsegment").alias("grp"))
    return vfs.edit_metadata(rows, {"uid": 7}, ("user",))


@_query(
    "WITH m AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 33188 WHEN 'LARGE' THEN 33261 WHEN 'PROMO' THEN 16384 WHEN 'ECONOMY' THEN 40960 ELSE 57344 END AS m, p_size % 2 = 0 AS c FROM part) "
    "SELECT p_partkey, CASE m WHEN 33188 THEN 33188 WHEN 33261 THEN 33261 WHEN 16384 THEN CASE WHEN c THEN 33188 ELSE 16877 END WHEN 40960 THEN 41453 END AS mode FROM m"
)
def default_modes(spark, d):
    kind = F.col("p_type")
    stored = F.when(kind == "SMALL", 0o100644).when(kind == "LARGE", 0o100755).when(kind == "PROMO", 0o040000).when(kind == "ECONOMY", 0o120000).otherwise(0o160000)
    return table(spark, d, "part").select("p_partkey", vfs.default_mode(stored, F.col("p_size") % 2 == 0).alias("mode"))


@_query(f"SELECT dir, count(*) FILTER (WHERE mode <> 16384) + 1 AS records FROM {_ENTRIES} GROUP BY dir HAVING count(*) FILTER (WHERE p_partkey % 40 = 0) > 0")
def directory_metadata(spark, d):
    """The list of a directory's records, left out where no entry has a real one (here: every fortieth part)."""
    rows = _entries(spark, d).withColumn("record", F.when(F.col("p_partkey") % 40 == 0, F.col("oid")))
    return vfs.directory_metadata(rows).select("dir", F.size("records").cast("long").alias("records"))


@_query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_type IS NOT DISTINCT FROM b.p_type AND nullif(a.p_size, 1) IS NOT DISTINCT FROM nullif(b.p_size, 1)")
def same_files(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.col("p_type").alias("user"), F.expr("nullif(p_size, 1)").alias("size"))
    a, b = part.alias("a"), part.alias("b")
    alike = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_partkey") < F.col("b.p_partkey"))
    return a.join(b, alike & scalars.same_file("a", "b", ["user", "size"])).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"))


# ---- text functions

_HARD = "CASE event_id % 6 WHEN 0 THEN '/' || event_type || '/../x//y/./' || event_id WHEN 1 THEN '../' || event_type || '/.' WHEN 2 THEN './/a/' || event_id || '/..' WHEN 3 THEN '/' WHEN 4 THEN event_type ELSE '//b/../../' || event_type END"


def _hard(spark: SparkSession, d: str) -> DataFrame:
    """Paths that need cleaning."""
    return table(spark, d, "events").select("event_id", F.expr(_HARD).alias("path"))


@_query(
    f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'x/y/' || event_id WHEN 1 THEN event_type WHEN 2 THEN '.' WHEN 3 THEN '.' WHEN 4 THEN event_type ELSE CASE WHEN true THEN event_type END END AS archived, "
    "CASE event_id % 6 WHEN 3 THEN '.' WHEN 4 THEN event_type END AS extracted, event_id % 6 NOT IN (4) AS risky FROM events"
)
def archive_paths(spark, d):
    path = F.col("path")
    return _hard(spark, d).select("event_id", scalars.archive_path(path).alias("archived"), scalars.extract_path(path).alias("extracted"), scalars.risky_path(path).alias("risky"))


@_query(f"SELECT event_id, CASE WHEN path = '' OR ends_with(path, '/') THEN path ELSE path || '/' END AS path FROM (SELECT event_id, {_HARD} AS path FROM events)")
def slashed_paths(spark, d):
    return _hard(spark, d).select("event_id", scalars.slash_append(F.col("path")).alias("path"))


@_query("SELECT event_id, event_id % 6 IN (0, 1) AS restorable FROM events")
def restorable_paths(spark, d):
    return _hard(spark, d).select("event_id", scalars.restorable(F.col("path")).alias("restorable"))


@_query("SELECT doc_id, regexp_full_match(text, '[ -~]*') AS valid FROM documents")
def repair_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.valid_repair_id(F.col("text")).alias("valid"))


@_query(f"SELECT doc_id, 'blob ' || substr({_OID}, 1, 7) || '* of ' || source AS line FROM documents")
def short_ids(spark, d):
    return _documents(spark, d).select("doc_id", scalars.short_ids(F.concat(F.lit("blob "), "oid", F.lit(" of "), "source")).alias("line"))


@_query("SELECT p_partkey, CASE WHEN p_type <> 'SMALL' THEN p_retailprice END AS seconds FROM part")
def date_arguments(spark, d):
    text = F.concat(F.col("p_retailprice").cast("string"), F.when(F.col("p_type") == "SMALL", "?").otherwise(""))
    return table(spark, d, "part").select("p_partkey", scalars.parse_date(text).alias("seconds"))


@_query(
    "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S') AS http, CASE WHEN event_id % 27 - 12 < 0 THEN '-' ELSE '+' END || lpad((abs(event_id % 27 - 12))::varchar, 2, '0') || CASE WHEN event_id % 2 = 0 THEN '00' ELSE '30' END AS zone FROM events"
)
def date_texts(spark, d):
    hours = F.col("event_id") % 27 - 12
    seconds = F.when(hours < 0, -1).otherwise(1) * (F.abs(hours) * 3600 + (F.col("event_id") % 2) * 1800)
    ns = F.unix_seconds(F.col("ts").cast("timestamp")) * 1_000_000_000 + F.col("event_id")
    return table(spark, d, "events").select("event_id", scalars.http_date(ns).alias("http"), scalars.zone_text(seconds).alias("zone"))


@_query(
    "WITH t AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN -event_id ELSE event_id END * 400000007 AS ns FROM events), s AS (SELECT event_id, ns, floor(ns / 1e9)::bigint AS s FROM t), r AS (SELECT event_id, ns, s, ns - s * 1000000000 AS r FROM s) "
    "SELECT event_id, s AS seconds, (CASE WHEN s < 0 THEN s + 1 ELSE s END)::varchar || CASE WHEN r = 0 THEN '' ELSE '.' || lpad(r::varchar, 9, '0') END AS text FROM r"
)
def file_times(spark, d):
    ns = F.when(F.col("event_id") % 2 == 0, -F.col("event_id")).otherwise(F.col("event_id")) * 400_000_007
    return table(spark, d, "events").select("event_id", scalars.floor_seconds(ns).alias("seconds"), scalars.seconds_text(ns).alias("text"))


@_query("SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) || '://u' || page_id || '%20x@' || regexp_extract(url, '^[a-z]+://([^/:]*)', 1) || ':' || (page_id + 1) || '/./p' AS url FROM pages")
def rendered_urls(spark, d):
    pages = table(spark, d, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/:]*)", 1)
    made = scalars.render_url(F.regexp_extract("url", "^([a-z]+):", 1), F.concat(F.lit("u"), "page_id", F.lit(" x")), host, F.col("page_id") + 1, F.lit("p"), dots=True)
    return pages.select("page_id", made.alias("url"))


@_query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS user, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'h' || c_nationkey END AS host, '/r:' || c_custkey AS path FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer WHERE c_mktsegment = 'MACHINERY'")
def remote_names(spark, d):
    name = F.concat("c_name", F.lit("@"), F.when(F.col("c_mktsegment") == "BUILDING", "-").otherwise(F.concat(F.lit("h"), "c_nationkey")), F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.concat(F.lit(":/r:"), "c_custkey")))
    return table(spark, d, "customer").select("c_custkey", scalars.remote_parts(name).alias("p")).select("c_custkey", "p.user", "p.host", "p.path")


@_query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x00-\x1f\x7f]') THEN '$''' || replace(replace(replace(replace(replace(text, '\', '\\'), '''', '\'''), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') || ''''
        WHEN regexp_full_match(text, '[\p{L}\p{N}_./+:@%,=-]+') THEN text ELSE '''' || replace(text, '''', '''\''''') || '''' END AS word FROM documents"""
)
def terminal_words(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.terminal_text(F.col("text")).alias("word"))


@_query("SELECT doc_id, 'heads/' || source || ' ' || doc_id || ':' || lang || '/x' || CASE WHEN n_chars % 2 = 0 THEN '/' ELSE '' END AS line FROM documents")
def walk_paths(spark, d):
    names = F.array(F.concat("doc_id", F.lit(":")), F.concat("lang", F.lit("/")), F.when(F.col("n_chars") % 2 == 0, "x/").otherwise("x"))
    return table(spark, d, "documents").select("doc_id", vfs.graph_path(F.concat(F.lit("heads/"), "source"), names).alias("line"))


# ---- upkeep of indexes and stores


@_query(f"SELECT prefix, count(*) AS ids, min(oid) AS first, max(oid) AS last FROM (SELECT oid, substr(oid, 1, 2) AS prefix FROM {_IDS}) GROUP BY prefix")
def sorted_buckets(spark, d):
    """Ids sorted within 256 ranges by their first byte: each range's ends, read off its sorted rows."""
    ids = _documents(spark, d).select("oid").distinct()
    return membership.sorted_buckets(ids).groupBy(F.substring("oid", 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("ids"), F.min("oid").alias("first"), F.max("oid").alias("last"))


@_query(f"SELECT count(*) AS members, 0::bigint AS denied FROM {_IDS}")
def bloom_check(spark, d):
    """How many members a filter made of them denies: none."""
    ids = _documents(spark, d).select("oid").distinct()
    shape = membership.bloom_shape(ids.count())
    absent = membership.bloom_absent(ids, membership.bloom_bits(ids, *shape), *shape).withColumn("absent", F.lit(True))
    return ids.join(absent, "oid", "left").agg(F.count(F.lit(1)).alias("members"), F.count("absent").alias("denied"))


@_query(f"SELECT oid, (('0x' || substr(oid, 1, 8))::bigint >> (32 - bits)) AS batch FROM {_IDS}, (SELECT greatest(0, ceil(log2(greatest(1, count(*) / 100.0))))::int AS bits FROM {_IDS})")
def id_batches(spark, d):
    return membership.find_in_batches(_documents(spark, d).select("oid").distinct(), 100)


@_query("SELECT event_type AS kind, count(*) AS n, string_agg(event_id::varchar, ',' ORDER BY event_id) FILTER (WHERE value > 95) AS named FROM events GROUP BY event_type")
def repair_counts(spark, d):
    """Repairs by kind, with the items of the gravest."""
    events = table(spark, d, "events").select(F.col("event_type").alias("kind"), "event_id", "value")
    return history.repair_counts(events, F.col("value") > 95, "event_id")


@_query(f"SELECT d.doc_id, CASE WHEN b.text IS NOT NULL THEN 'n' || d.doc_id END AS converted FROM documents d LEFT JOIN (SELECT DISTINCT text FROM documents WHERE lang = 'en') b ON d.text = b.text")
def rewrite_memo(spark, d):
    """Earlier conversions of ids, where what they were made into is stored."""
    docs = _documents(spark, d).select("doc_id", "oid")
    memo = docs.select(F.concat("oid", F.lit(":"), "doc_id").alias("src"), F.concat(F.lit("n"), "doc_id").alias("dst"))
    stored = docs.join(_ids(table(spark, d, "documents").where("lang = 'en'")).distinct(), "oid", "left_semi").select(F.concat(F.lit("n"), "doc_id").alias("oid"))
    return history.converted(docs.select("doc_id", F.concat("oid", F.lit(":"), "doc_id").alias("src")), memo, stored).select("doc_id", F.col("dst").alias("converted"))


@_query(
    "WITH s AS (SELECT user_id AS branch, event_id AS id, floor(epoch(ts))::bigint AS utc, strftime(ts, '%Y-%m-%d-%H%M%S') AS name FROM events), k AS (SELECT *, count(*) OVER (PARTITION BY branch, name) AS n, row_number() OVER (PARTITION BY branch, name ORDER BY utc DESC, id DESC) AS k FROM s) "
    "SELECT branch, id, CASE WHEN n = 1 THEN name ELSE name || '-' || lpad((n - k)::varchar, length((n - 1)::varchar)::int, '0') END AS name, row_number() OVER (PARTITION BY branch ORDER BY utc, id) AS pos FROM k"
)
def named_history(spark, d):
    """Saves oldest first with the names that they are listed under."""
    saves = table(spark, d, "events").select(F.col("user_id").alias("branch"), F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("utc"))
    named = history.save_names(saves)
    return named.select("branch", "id", "name", F.row_number().over(Window.partitionBy("branch").orderBy("utc", "id")).alias("pos"))


@_query("SELECT c_mktsegment AS dir, c_name AS name, c_custkey AS oid FROM customer")
def flatten_splits(spark, d):
    """Customers as leaves of three levels of nodes, by nation and region."""
    cust, nation = table(spark, d, "customer"), table(spark, d, "nation")
    j = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("dir"), "c_name", "c_custkey", "c_nationkey", "n_regionkey")
    none = F.lit(None).cast("string").alias("name")
    leaf = j.select("dir", F.lit(0).alias("level"), F.col("c_nationkey").alias("node"), F.col("c_name").alias("name"), F.lit(None).cast("int").alias("child"), F.col("c_custkey").alias("oid"))
    middle = j.select("dir", F.lit(1).alias("level"), F.col("n_regionkey").alias("node"), none, F.col("c_nationkey").alias("child"), F.lit(None).cast("long").alias("oid")).distinct()
    top = j.select("dir", F.lit(2).alias("level"), F.lit(0).alias("node"), none, F.col("n_regionkey").alias("child"), F.lit(None).cast("long").alias("oid")).distinct()
    return dirsplit.flatten_splits(leaf.unionByName(middle).unionByName(top), 2)


@_query("SELECT event_type AS channel, count(*) AS events, sum(octet_length(encode(props)))::bigint AS bytes FROM events GROUP BY event_type")
def channel_totals(spark, d):
    framed = ingest.frames(table(spark, d, "events").select("event_id", "event_type", F.encode("props", "UTF-8").alias("props")), F.col("event_type"), "event_id", "props", 16)
    return framed.groupBy("channel").agg(F.count_if(F.col("part") == 0).alias("events"), F.sum("len").cast("long").alias("bytes"))


# ---- faults and examples


@_query(
    "WITH d AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text <> '') "
    "SELECT doc_id, sha1(unhex(substr(h, 1, 2 * (doc_id * 31 % n)) || printf('%02X', doc_id % 256) || substr(h, 2 * (doc_id * 31 % n) + 3))) AS digest FROM d"
)
def damaged_contents(spark, d):
    docs = table(spark, d, "documents").where("text <> ''")
    return docs.select("doc_id", F.sha1(faults.damage(F.encode("text", "UTF-8"), F.col("doc_id") * 31, F.col("doc_id") % 256)).alias("digest"))


@_query(f"SELECT doc_id, {_OID} AS oid FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'de' AND text IS NOT NULL)")
def perforated(spark, d):
    return faults.perforate(_documents(spark, d).where("text IS NOT NULL").select("doc_id", "oid"), _ids(table(spark, d, "documents").where("lang = 'de'"))).select("doc_id", "oid")


@_query("SELECT printf('%04X', i) AS name FROM range(10000) t(i)")
def splittable_names(spark, d):
    return faults.splittable_names(spark)


@_query(f"SELECT n.name, coalesce(min(d.kind), 'none') AS kind FROM (SELECT DISTINCT {_OID} AS name FROM (SELECT text FROM conversations UNION ALL SELECT text FROM documents)) n LEFT JOIN (SELECT {_OID} AS name, 'blob' AS kind FROM documents) d USING (name) WHERE n.name IS NOT NULL GROUP BY n.name")
def batch_fetch(spark, d):
    """Many ids asked for at once; those that are not stored are answered with a null."""
    asked = _ids(table(spark, d, "conversations")).unionByName(_ids(table(spark, d, "documents"))).where("oid IS NOT NULL").distinct()
    stored = _documents(spark, d).select("oid", F.lit("blob").alias("kind")).distinct()
    return asked.join(stored, "oid", "left").select(F.col("oid").alias("name"), F.coalesce("kind", F.lit("none")).alias("kind"))


@_query(f"SELECT doc_id, sha1(text) AS digest FROM documents WHERE {_OID} IN (SELECT {_OID} FROM documents JOIN labels USING (doc_id))")
def contents_of_ids(spark, d):
    """Contents found again by a list of ids: those of the labelled documents, with all their copies."""
    ids = _ids(table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id"))
    docs = table(spark, d, "documents").join(_documents(spark, d).select("doc_id", "oid"), "doc_id")
    return membership.exists(docs, ids).select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("digest"))


# ---- imports and archives


@_query("SELECT floor(epoch(ts))::bigint AS utc, event_type AS kind FROM events WHERE event_type <> 'view'")
def increment_times(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")
    lines = table(spark, d, "events").select(F.concat_ws(" ", F.when(F.col("event_type") == "view", F.lit("at")), at, "event_type").alias("value"))
    return files.increment_times(lines)


@_query(
    "SELECT p_brand || '/' || p_partkey || CASE WHEN p_type = 'SMALL' THEN '/' ELSE '' END AS path, CASE WHEN p_type = 'SMALL' THEN 16877 ELSE 33188 END::bigint AS mode, p_partkey AS uid, p_name AS user, p_size::bigint AS size, -p_partkey AS mtime, CASE WHEN p_size < 9 THEN '../' || p_name END AS symlink FROM part"
)
def metadata_archive(spark, d):
    """Scanned rows written to an archive and read back."""
    small = F.col("p_type") == "SMALL"
    rows = table(spark, d, "part").select(
        F.concat(F.lit("/./"), "p_brand", F.lit("//"), "p_partkey", F.when(small, "/").otherwise("")).alias("path"),
        F.when(small, 0o040755).otherwise(0o100644).alias("mode"),
        F.col("p_partkey").alias("uid"),
        F.col("p_name").alias("user"),
        F.col("p_size").alias("size"),
        (-F.col("p_partkey")).alias("mtime"),
        F.when(F.col("p_size") < 9, F.concat(F.lit("../"), "p_name")).alias("target"),
    )
    return files.read_metadata(files.archive_metadata(rows)).select("path", "mode", "uid", "user", "size", "mtime", "symlink")


@_query("SELECT a.p_partkey, CASE WHEN encode(a.p_name) < encode(b.p_name) THEN -1 WHEN a.p_name = b.p_name THEN 0 ELSE 1 END AS compared FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def byte_order(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("x"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))
    return part.join(after, "p_partkey").select("p_partkey", F.when(F.col("x") < F.col("y"), -1).when(F.col("x") == F.col("y"), 0).otherwise(1).alias("compared"))
