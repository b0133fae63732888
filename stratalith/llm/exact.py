"""Exact duplicates by Grace hashing: records are partitioned, recursively where needed, until the distinct contents of a
bucket fit an open-addressing table that compares them whole.

Contents travel once a map task, with the least id that the task saw; what a bucket decides about a content goes back to the
other rows by a join on (two hashes, that least id). So no list of ids grows with the number of copies."""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import few, filesystem, fresh_path, matching, settle, tidy

#: Bytes of distinct content that one table may hold; beyond it records go to spill files.
TABLE_BYTES = 192 << 20
#: The same for the table on the map side, which is emptied instead when it is full.
MAP_TABLE_BYTES = 48 << 20
FANOUT_BITS = 4
_SCHEMA = pa.schema([("hash", pa.int64()), ("other", pa.int64()), ("content", pa.binary()), ("least", pa.int64())])
_MAPPED = pa.schema([*_SCHEMA, ("doc_id", pa.int64())])
_DDL = "hash long, other long, content binary, least long, doc_id long"
_MASK = (1 << 64) - 1

#: hash, another hash, content, and the least ids of the map tasks that sent it.
Record = tuple[int, int, bytes, array]


class ContentTable:
    """Open addressing with linear probing over entry numbers; equal hashes are told apart by the complete content."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.others: list[int] = []
        self.contents: list[bytes] = []
        self.ids: list[array] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry, slot); entry is -1 where the content is not there, and slot is then where it goes."""
        mask = len(self.slots) - 1
        slot = (h * 0x9E3779B97F4A7C15 & _MASK) >> 20 & mask
        while (entry := self.slots[slot]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, slot
            slot = (slot + 1) & mask
        return -1, slot

    def insert(self, slot: int, h: int, other: int, content: bytes, ids: array) -> None:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(h)
        self.others.append(other)
        self.contents.append(content)
        self.ids.append(ids)
        self.bytes += len(content) + 8 * len(ids) + 200
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for entry, (x, c) in enumerate(zip(self.hashes, self.contents, strict=True)):
                self.slots[self.find(x, c)[1]] = entry

    def extend(self, entry: int, ids: array) -> None:
        self.ids[entry].extend(ids)
        self.bytes += 8 * len(ids)

    def __iter__(self) -> Iterator[Record]:
        return zip(self.hashes, self.others, self.contents, self.ids, strict=True)


class Spill:
    """Files of one level of one task, in the folder that all executors share; gone when they have been read."""

    def __init__(self, folder: str) -> None:
        self.folder = f"{folder}/{uuid.uuid4().hex}"
        self.writers: dict[int, tuple[pa.NativeFile, pa.RecordBatchStreamWriter]] = {}
        self.held: dict[int, list[Record]] = {}
        self.held_bytes: dict[int, int] = {}
        self.fs, self.path = filesystem(self.folder)

    def add(self, bucket: int, record: Record) -> None:
        self.held.setdefault(bucket, []).append(record)
        self.held_bytes[bucket] = self.held_bytes.get(bucket, 0) + len(record[2]) + 8 * len(record[3])
        if self.held_bytes[bucket] > 1 << 20:
            self.flush(bucket)

    def flush(self, bucket: int) -> None:
        if bucket not in self.writers:
            self.fs.create_dir(self.path, recursive=True)
            file = self.fs.open_output_stream(f"{self.path}/{bucket}")
            self.writers[bucket] = file, pa.ipc.new_stream(file, _SCHEMA)
        self.writers[bucket][1].write_batch(_batch(self.held.pop(bucket)))
        self.held_bytes[bucket] = 0

    def buckets(self) -> Iterator[Iterator[Record]]:
        for bucket in list(self.held):
            self.flush(bucket)
        for file, writer in self.writers.values():
            writer.close()
            file.close()
        for bucket in self.writers:
            yield self.read(f"{self.path}/{bucket}")
        if self.writers:
            self.fs.delete_dir(self.path)

    def read(self, path: str) -> Iterator[Record]:
        with self.fs.open_input_stream(path) as file:
            for batch in pa.ipc.open_stream(file):
                yield from _records(batch)


def _batch(records: list[Record]) -> pa.RecordBatch:
    """A row for each id of each record; the content stands in the first of them only."""
    rows = [(h, o, c if not k else None, i) for h, o, c, ids in records for k, i in enumerate(ids)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _records(batch: pa.RecordBatch) -> Iterator[Record]:
    """What _batch made rows of."""
    held: Record | None = None
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        for h, other, content, least in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            if content is None:
                held[3].append(least)
                continue
            if held:
                yield held
            held = h, other, content, array("q", [least])
    if held:
        yield held


def grace(records: Iterator[Record], budget: int, folder: str, depth: int = 0) -> Iterator[Record]:
    """One record for each distinct content, with the ids of all that hold it.

    The table takes contents until it is full; what it has then absorbs its copies still to come, and the other records
    go to 2**FANOUT_BITS spill files by the next bits of their hash, each of which is treated likewise. Where no bits
    are left, every level still settles at least a table's worth."""
    table, spill = ContentTable(), None
    for h, other, content, ids in records:
        entry, slot = table.find(h, content)
        if entry >= 0:
            table.extend(entry, ids)
        elif not table.hashes or table.bytes + len(content) <= budget:
            table.insert(slot, h, other, content, ids)
        else:
            spill = spill or Spill(folder)
            spill.add((h & _MASK) >> (64 - FANOUT_BITS * (depth % 15 + 1)) & ((1 << FANOUT_BITS) - 1), (h, other, content, ids))
    yield from table
    del table
    if spill:
        for bucket in spill.buckets():
            yield from grace(bucket, budget, folder, depth + 1)


def _mapped(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _MAPPED.types, strict=True)], schema=_MAPPED)


def _outgoing(table: ContentTable) -> Iterator[pa.RecordBatch]:
    """A row with the content for each record, doc_id null, and one without it for every further row that the task saw."""
    columns: list[list] = [[] for _ in _MAPPED]
    size = 0
    for h, other, content, ids in table:
        least = min(ids)
        rows = [(h, other, content, least, None)]
        if len(ids) > 1:
            rest = sorted(ids)[1:]
            rows += [(h, other, None, least, i) for i in rest]
        for row in rows:
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        size += len(content) + 32 * len(rows)
        if size > 4 << 20:
            yield _mapped(columns)
            columns, size = [[] for _ in _MAPPED], 0
    yield _mapped(columns)


def _collapse(budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side: copies within a task travel as one record, so a text repeated everywhere reaches its bucket once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for h, other, content, doc_id in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    entry, slot = table.find(h, content)
                    if entry >= 0:
                        table.extend(entry, array("q", [doc_id]))
                    else:
                        table.insert(slot, h, other, content, array("q", [doc_id]))
                if table.bytes > budget:
                    yield from _outgoing(table)
                    table = ContentTable()
        yield from _outgoing(table)

    return run


def _resolve(budget: int, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each content, the least id of all, and for each of its records but the one kept a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(5)]

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["hash", "other", "least", "keep_id", "first"])

        for h, other, _, ids in grace((r for b in batches for r in _records(b)), budget, folder):
            keep = min(ids)
            for k, least in enumerate(sorted(ids)):
                for column, value in zip(columns, (h, other, least, keep, not k), strict=True):
                    column.append(value)
            if len(columns[0]) > 100_000:
                yield out()
                columns = [[] for _ in range(5)]
        yield out()

    return run


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("other"), text)


def _removed(docs: DataFrame, table_bytes: int, map_table_bytes: int) -> DataFrame:
    """(doc_id, keep_id, hash, other) of every row that goes."""
    spark = docs.sparkSession
    h, other = _hashes(F.col("text"))
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(h.alias("hash"), other.alias("other"), F.col("text").cast("binary").alias("content"), F.col("doc_id").cast("long").alias("doc_id"))
    mapped = settle(rows.mapInArrow(tidy(_collapse(map_table_bytes)), _DDL), "contents")
    # Only contents whose hashes came from two tasks, or twice from one, can have copies elsewhere: the others stay where they are.
    contents = mapped.where("doc_id IS NULL")
    met = settle(contents.groupBy("hash", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "other"), "met")
    records = contents.select("hash", "other", "content", "least").join(few(met), ["hash", "other"], "left_semi").repartition("hash")
    resolved = settle(records.mapInArrow(tidy(_resolve(table_bytes, fresh_path(spark, "grace"))), "hash long, other long, least long, keep_id long, first boolean"), "resolved")
    elsewhere = resolved.where("NOT first").select(F.col("least").alias("doc_id"), "keep_id", "hash", "other")
    kept = few(settle(resolved.where("least <> keep_id").select("hash", "other", "least", "keep_id").distinct(), "kept"))
    local = mapped.where("doc_id IS NOT NULL").select("hash", "other", "least", "doc_id").join(kept, ["hash", "other", "least"], "left")
    return elsewhere.unionByName(local.select("doc_id", F.coalesce("keep_id", "least").alias("keep_id"), "hash", "other"))


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, map_table_bytes: int = MAP_TABLE_BYTES) -> DataFrame:
    """(doc_id, keep_id): every row whose text another row has too, but for the one that stays; that has the least doc_id.

    Texts are equal when all their bytes are; the empty text is a text. Null ids and null texts are never duplicates.
    A row repeated as a whole is a duplicate of itself, named with keep_id = doc_id. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    return _removed(docs, table_bytes, map_table_bytes).select("doc_id", "keep_id")


def drop_exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, map_table_bytes: int = MAP_TABLE_BYTES) -> DataFrame:
    """docs with one row for each distinct text; rows with a null id or text stay. All columns stay, whatever their names; of
    rows that share doc_id and text but not other columns, any one stays.

    Which rows go is decided by whole contents; a row is then found again by its doc_id and two 64-bit hashes of its text."""
    gone = settle(_removed(docs, table_bytes, map_table_bytes), "duplicates")
    h, other = _hashes(docs["text"])
    on = {"doc_id": docs["doc_id"], "hash": h, "other": other}
    again = gone.where("doc_id = keep_id").select("doc_id", "hash", "other").distinct()
    rest = matching(docs, settle(gone.select("doc_id", "hash", "other").distinct(), "gone"), on, "left_anti")
    if again.isEmpty():
        return rest
    once = matching(docs, settle(again, "again"), on, "left_semi").dropDuplicates(["doc_id", "text"])
    others = settle(gone.where("doc_id <> keep_id").select("doc_id", "hash", "other").distinct(), "others")
    h, other = _hashes(once["text"])
    return rest.unionByName(matching(once, others, {"doc_id": once["doc_id"], "hash": h, "other": other}, "left_anti"))
