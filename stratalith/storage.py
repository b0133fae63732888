"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a narrow table that may be broadcast after they have been counted.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where the session names none and runs on one machine (tests). Executors of
    other machines would each write to a folder of their own, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = getattr(spark, "_stratalith_scratch", None)
    if made is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; {master} is not one machine")
        folder = tempfile.mkdtemp(prefix="stratalith-scratch-")
        atexit.register(shutil.rmtree, folder, True)
        made = spark._stratalith_scratch = f"file://{folder}"
    return made


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later rounds read it, so neither lineage nor a lost executor matters."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
