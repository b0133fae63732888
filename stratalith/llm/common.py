"""Helpers the operators share: the shared folder, cutting lineage, size-checked joins, sorted groups in Arrow streams."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one 8-byte key that a broadcast may hold (about 16 MB); beyond it the same join shuffles.
BROADCAST_KEYS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master (tests,
    one machine); on any other master a folder of this machine would not be shared, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = getattr(spark, "_stratalith_dir", None)
        if where is None:
            master = spark.sparkContext.master
            if not re.fullmatch(r"local(\[.*\])?", master):
                raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it has to name a folder that all executors share")
            local = tempfile.mkdtemp(prefix="stratalith-")
            atexit.register(shutil.rmtree, local, True)
            where = spark._stratalith_dir = f"file://{local}"
    return where.rstrip("/")


def written_paths(spark: SparkSession) -> list[str]:
    """Folders under shared_dir() that this session has written and not deleted, the oldest first."""
    if not hasattr(spark, "_stratalith_written"):
        spark._stratalith_written = []
    return spark._stratalith_written


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    written_paths(spark).append(path)
    return path


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage is cut, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders of written_paths() that nothing reads any more."""
    known = written_paths(spark)
    for name in [p for p in paths if p in known]:
        known.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    folders = {file.rsplit("/", 2)[-2] for table in tables for file in table.inputFiles()[:1]}
    release(spark, [p for p in written_paths(spark) if p.rsplit("/", 1)[-1] in folders])


def settle_last(make: Callable[[], DataFrame], spark: SparkSession, what: str) -> DataFrame:
    """Settles what make() returns, and deletes whatever else was written for it meanwhile."""
    before = set(written_paths(spark))
    out = settle(make(), what)
    own = written_paths(spark)[-1]
    release(spark, [p for p in written_paths(spark) if p not in before and p != own])
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and path for a URI or plain path; the same code serves local disks, HDFS and object stores."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def few(side: DataFrame) -> DataFrame:
    """side, marked for broadcast if it is counted to have BROADCAST_KEYS rows at most. It should be a written table."""
    return F.broadcast(side) if side.count() <= BROADCAST_KEYS else side


def matching(docs: DataFrame, keys: DataFrame, on: Mapping[str, Column], how: str) -> DataFrame:
    """Rows of docs with (how = left_semi) or without (left_anti) a row of keys whose columns equal the expressions of `on`.

    keys are broadcast if counted to be few; else the join shuffles, and splits hot keys at run time."""
    names = {column: free_name(docs, f"__sl_{column}") for column in on}
    side = few(keys.select(*(F.col(column).alias(name) for column, name in names.items())))
    return docs.join(side, reduce(and_, (value == F.col(names[column]) for column, value in on.items())), how)


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 1 << 62) -> Iterator[pa.Table]:
    """Cuts a stream sorted by a 64-bit key into tables that hold whole groups, a batch's worth at a time. A group of more
    than `most` rows comes in tables of its own, each but the last with `most` rows at least."""
    held: list[pa.RecordBatch] = []  # rows of one key, the last seen

    def out() -> pa.Table:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return table

    parted = None  # the key whose rows have been handed out in part
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if parted is not None:
            own = int(np.searchsorted(keys, parted, side="right"))
            if own < len(keys):
                held.append(batch.slice(0, own))
                if sum(b.num_rows for b in held):
                    yield out()
                held.clear()
                parted, batch, keys = None, batch.slice(own), keys[own:]
        cut = int(np.searchsorted(keys, keys[-1]))
        if parted is None and (cut or (held and held[-1].column(key)[-1].as_py() != int(keys[0]))):
            held.append(batch.slice(0, cut))
            yield out()
        held.append(batch.slice(cut))
        if sum(b.num_rows for b in held) >= most:
            parted = int(keys[-1])
            yield out()
    if held:
        yield out()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving the memory that it freed back to the system at its end: Spark keeps its Python workers for tasks of any kind."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library's
                trim(0)

    return tidied


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, with the length at the end."""
    if not len(keys):
        return np.zeros(1, dtype=np.int64)
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def has_text(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that have both; null ids cannot be named in a result and null texts hold nothing."""
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
