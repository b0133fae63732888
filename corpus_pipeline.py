"""A corpus from raw documents to packed windows: quality, exact copies, near copies, mixture, packing.

Every stage takes the columns of documents as they are, whatever their order, and further ones; all but the last return them.
Nulls in any column, empty and very long texts, ties, repeated rows and empty tables have a defined result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalith.llm.common import drop_settled, settle, settle_last
from stratalith.llm.exact import drop_exact_duplicates
from stratalith.llm.mixing import mix_documents
from stratalith.llm.neardup import drop_near_duplicates
from stratalith.llm.packing import pack_lengths
from stratalith.llm.quality import drop_low_quality
from stratalith.llm.tokens import token_totals


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels table, does not reject.

    The text alone decides: a null one as the empty text, repeated rows alike, long ones whole; a null doc_id changes nothing.
    Without labels of both classes nothing is rejected, unless all labels are bad. An empty table stays empty."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, the one with the least doc_id.

    The empty text is a text like any other; rows with a null doc_id or text all stay; of rows repeated with doc_id and text one
    stays. Long texts are compared whole. An empty table stays empty."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Rows with a null doc_id, and null, empty or wordless texts, all stay; repeated rows of one doc_id are one document, and stay
    or go together. Long texts count whole. An empty table stays empty."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its sources' quotas ask for.

    Rows with a null doc_id, and with null, empty or wordless texts, stay once. A null source or language is no source; words
    of documents without any source are used 0 times. Repeated rows are drawn together; equal places in the seeded order fall
    to the lesser doc_id. An empty table stays empty."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of 4096 tokens of the byte-pair vocabulary.

    Rows with a null doc_id, and null or empty texts, have no piece; longer texts are cut at window lengths; repeated
    rows are packed as often as they occur; of equally full windows the older is taken. An empty table gives no windows."""
    return pack_lengths(settle(token_totals(docs), "totals"))  # settled: two Python functions in one task take twice the workers


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Classification, MinHash, min-cost flow and bounded-space packing are beyond SQL; tests/llm compares every stage with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and reread. What a stage wrote besides, and the table
    before it, are deleted when its own is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        now = settle_last(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, f"pipeline-{name}")
        if before is not None:
            drop_settled(spark, before)
        docs = before = now
    return docs
