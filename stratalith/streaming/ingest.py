"""Incremental forms: ingest that stores unseen objects, listings kept up to date, framed channels, splitting of records and of
bytes with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalith.operators import chunking
from stratalith.operators.dirsplit import RecordSplitter

PACKET = 128 * 1024


def ingest_objects(stream: DataFrame, store: str, checkpoint: str, oid: str = "oid"):
    """Starts a query that appends to the Parquet table `store` those rows of each batch whose oid is new, once each. A batch
    that is run again finds its rows stored and adds nothing, so the sink is idempotent."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates([oid])
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.schema(rows.schema).parquet(store).select(oid), oid, "left_anti")
        fresh.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_table(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet table (file or folder) as a stream of its files, at most so many of them a batch."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        source = source.option("maxFilesPerTrigger", files_a_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return source.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    return source.parquet(path)


def update_listing(listing: DataFrame, events: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """listing after events (name, version, deleted, ...): each name's newest row, if that is no deletion; what changed is not valid."""
    columns = listing.columns
    old = listing.withColumn(version, F.lit(-1).cast("long")).withColumn("deleted", F.lit(False))
    new = events.withColumn("valid", F.lit(False)).select(*columns, version, "deleted")
    w = Window.partitionBy(name).orderBy(F.desc(version))
    return old.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1 AND NOT deleted").select(*columns)


def follow_listing(stream: DataFrame, folder: str, checkpoint: str, name: str = "name", version: str = "version"):
    """Starts a query that keeps a listing up to date with a stream of events; each batch writes generation v<batch> of it,
    from the one before, so a batch that runs again gives the same."""

    def batch(rows: DataFrame, number: int) -> None:
        listing = rows.sparkSession.read.parquet(f"{folder}/v{number - 1}")
        update_listing(listing, rows, name, version).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frames(rows: DataFrame, channel: Column, order: str, payload: str, most: int = PACKET) -> DataFrame:
    """(channel, order, part, len, payload): payloads cut into frames of at most `most` bytes; order and part restore the sequence."""
    n = F.octet_length(payload)
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(n / most).cast("int") - 1, F.lit(0)))
    cut = rows.where(F.col(payload).isNotNull()).select(channel.alias("channel"), F.col(order).alias("ord"), F.explode(parts).alias("part"), F.col(payload).alias("__p"))
    piece = F.substr("__p", F.col("part") * most + 1, F.lit(most))
    return cut.select("channel", "ord", "part", F.octet_length(piece).alias("len"), piece.alias("payload"))


def unframe(framed: DataFrame) -> DataFrame:
    """(channel, ord, payload) put together from frames."""
    return framed.groupBy("channel", "ord").agg(F.expr("listagg(payload) WITHIN GROUP (ORDER BY part)").alias("payload"))


def split_records(stream: DataFrame, key: str, order: str, record: str, bits: int = 13) -> DataFrame:
    """(key, ord, splits) for a stream of records: whether a group ends after each. The state of a key is its 64-byte window,
    two sums and a size; records of a batch are taken in `order`."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = RecordSplitter(bits)
        if state.exists:
            window, s.place, s.s1, s.s2, s.size = state.get
            s.window = bytearray(window)
        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        splits = [s.feed((r or "").encode())[0] for r in rows["record"]]
        state.update((bytes(s.window), s.place, s.s1, s.s2, s.size))
        yield pd.DataFrame({"key": group[0], "ord": rows["ord"].to_numpy(), "splits": splits})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), F.col(record).alias("record"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ord long, splits boolean", "window binary, place int, s1 long, s2 long, size long", "append", GroupStateTimeout.NoTimeout)


def split_bytes(stream: DataFrame, key: str, order: str, content: str, last: str, bits: int = chunking.BITS, fan_bits: int = chunking.FAN_BITS) -> DataFrame:
    """(key, seq, ofs, len, level, oid) for a stream of pieces of contents: the chunks of each key's pieces laid end to end, as
    chunking.chunks gives for the whole, of any size. A row with `last` true ends its content, and what is open is then a chunk.

    The state of a key is what follows its last cut (less than 2**(bits + 2) bytes), its offset and number; pieces of a batch
    are taken in `order`, and later batches hold later pieces."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, ofs, seq = state.get if state.exists else (b"", 0, 0)
        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        ended = bool(rows["last"].any())
        data = bytes(tail) + b"".join(bytes(c) for c in rows["content"] if c is not None)
        flat = np.frombuffer(data, dtype=np.uint8)
        _, end, level = chunking.cut(flat, np.array([0, len(data)]), bits, fan_bits)
        start = np.r_[0, end[:-1]] if len(end) else end
        if len(end) and not ended and not chunking.is_cut(flat, int(start[-1]), int(end[-1]), bits):
            start, end, level = start[:-1], end[:-1], level[:-1]
        done = int(end[-1]) if len(end) else 0
        view = memoryview(data)
        oids = [chunking.blob_id(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if ended:
            state.remove()
        else:
            state.update((data[done:], ofs + done, seq + len(end)))
        yield pd.DataFrame({"key": group[0], "seq": np.arange(seq, seq + len(end)), "ofs": start + ofs, "len": end - start, "level": level, "oid": oids})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("ord"), F.col(content).alias("content"), F.coalesce(F.col(last), F.lit(False)).alias("last"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, seq int, ofs long, len int, level int, oid string", "tail binary, ofs long, seq int", "append", GroupStateTimeout.NoTimeout)
