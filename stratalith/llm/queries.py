"""The subpackage's registered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalith.llm import chat, exact, fingerprint, mixing, neardup, packing, quality, substring, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.index_pages(_table(spark, sf_dir, "pages"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality, op2_token_counts, op3_exact_dedup, op4_mixing, op5_chat_format, op6_packing, op7_near_dedup, op8_warc_index, op9_fingerprints, op10_substring_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, keep_id FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
        ) WHERE place > 1
    """,
    "op8_warc_index": r"""
        WITH cut AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages),
        parts AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '^www\.', '') AS host,
                         regexp_extract(rest, '^[^/?]*(.*)$', 1) AS path FROM cut)
        SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS url_key,
               octet_length(encode(html)) AS n_bytes, md5(html) AS digest
        FROM parts
    """,
}
