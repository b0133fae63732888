"""Web archives: capture records in compressed files, and a two-level index over them.

First level: lines (key, page, file, offset, length), sorted by reversed-host URL key, in compressed blocks. Second level: a
sparse directory with the first key and the place of each block. A lookup searches the directory by bisection, reads one
block by its byte range, bisects in it, and reads the record by its byte range.
"""

from __future__ import annotations

import bisect
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.llm.common import filesystem, fresh_path, settle

BLOCK_LINES = 1000
#: Directory entries that a broadcast may hold (about 100 bytes each); beyond it lookups join the directory by key range.
BROADCAST_BLOCKS = 200_000
FILE_BYTES = 256 << 20
#: Captures that a lookup task reads, about; keys alone are so small that Spark would put them all into one task.
LOOKUP_LINES = 4_000
LOOKUP_TASKS = 20_000
_LINE = "key string, page_id long, file string, offset long, length long"
_BLOCK = "first string, shard string, offset long, length long, lines long"


def url_key(url: Column) -> Column:
    """Sort key of a URL: the host's labels in reverse order, then ')' and the path and query. Scheme, user, port, fragment, a
    leading 'www.' and the case of the host are dropped; an empty path is '/'. Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^.*@|:[0-9]*$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    return F.when(url.isNotNull(), F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))))


def record(page_id: int, url: str, body: bytes) -> bytes:
    """A capture as a gzip member. Control characters of the URL are percent-encoded, so that none ends its header line."""
    url = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + body + b"\r\n\r\n") + deflate.flush()


def body_of(raw: bytes) -> bytes:
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    size = int([line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")][-1].split(b":")[1])  # record() writes it last
    return rest[:size]


def _archiver(folder: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        # Every attempt of a task writes files of its own, so a repeated attempt disturbs none.
        stem, number, out, name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, None, "", 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                for key, page_id, url, html in zip(*(batch.slice(begin, 500).column(i).to_pylist() for i in range(4)), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at, number = f"{stem}-{number}.warc.gz", 0, number + 1
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    raw = record(page_id, url, html or b"")
                    out.write(raw)
                    rows.append((key, page_id, name, at, len(raw)))
                    at += len(raw)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def write_archive(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) as records of gzip members into folder; returns (key, page_id, file, offset, length).

    Rows with a null page_id or url are not captured; a null html is an empty body."""
    rows = pages.where("page_id IS NOT NULL AND url IS NOT NULL").select(url_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    return settle(rows.mapInArrow(_archiver(folder, file_bytes), _LINE), "captures")


def _indexer(folder: str, block_lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        shard, out, at, held, entries = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.cdx.z", None, 0, [], []

        def flush() -> None:
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps(x, separators=(",", ":")) for x in held).encode(), 6)
            out.write(raw)
            entries.append((held[0][0], shard, at, len(raw), len(held)))
            at += len(raw)
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out = out or fs.open_output_stream(f"{path}/{shard}", compression=None)
                held.append(row)
                if len(held) == block_lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
        if entries:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*entries, strict=True)], names=["first", "shard", "offset", "length", "lines"])

    return run


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted, compressed blocks and returns the directory (first, shard, offset, length, lines), a row a block.

    Keys are split into ranges, one sorted shard a task. Equal keys sort by page_id."""
    ranged = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return settle(ranged.mapInArrow(_indexer(folder, block_lines), _BLOCK), "directory")


def find_block(firsts: list[str], key: str) -> int:
    """The first block that may hold the key: the one before the first whose first key is not less (0 if that is the first)."""
    return max(0, bisect.bisect_left(firsts, key) - 1)


def _lookup(directory: list[tuple[str, str, int, int]], index: str, archive: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    firsts = [d[0] for d in directory]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, index_path = filesystem(index)
        _, archive_path = filesystem(archive)
        number, block, keys = -1, [], []  # the block read last; sorted queries read each once
        name, file = None, None
        for batch in batches:
            rows: list[tuple] = []
            for key in batch.column(0).to_pylist():
                at = find_block(firsts, key) if firsts else 0
                while at < len(firsts) and firsts[at] <= key:
                    if at != number:
                        _, shard, offset, length = directory[at]
                        with fs.open_input_file(f"{index_path}/{shard}") as f:
                            f.seek(offset)
                            block = [json.loads(x) for x in zlib.decompress(f.read(length)).decode().split("\n")]
                        number, keys = at, [x[0] for x in block]
                    for k in range(bisect.bisect_left(keys, key), len(keys)):
                        if keys[k] != key:
                            break
                        _, page_id, captured, offset, length = block[k]
                        if captured != name:
                            if file is not None:
                                file.close()
                            name, file = captured, fs.open_input_file(f"{archive_path}/{captured}")
                        file.seek(offset)
                        rows.append((key, page_id, captured, offset, length, body_of(file.read(length))))
                    at += 1
                if len(rows) >= 500:
                    yield _found(rows)
                    rows = []
            yield _found(rows)
        if file is not None:
            file.close()

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length", "body"])


def look_up(spark: SparkSession, queries: DataFrame, directory: DataFrame, index: str, archive: str) -> DataFrame:
    """(key, page_id, file, offset, length, body) of every capture of every distinct key of queries (key).

    The directory is collected and sent to the tasks if it is counted to have BROADCAST_BLOCKS entries at most. A larger one
    is cut into ranges of so many blocks, and each range serves the queries between its first key and the next range's."""
    wanted = queries.where("key IS NOT NULL").select("key").distinct()
    schema = _LINE + ", body binary"
    totals = directory.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines")).first()
    entries, tasks = totals["blocks"], max(1, min(LOOKUP_TASKS, totals["lines"] // LOOKUP_LINES))
    if entries <= BROADCAST_BLOCKS:
        blocks = [tuple(r) for r in directory.orderBy("first", "shard", "offset").select("first", "shard", "offset", "length").collect()]
        return wanted.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(_lookup(blocks, index, archive), schema)
    # Written in ranges of keys: each part below reads the row groups of its own keys only.
    wanted = settle(wanted.repartitionByRange("key").sortWithinPartitions("key"), "wanted")
    found, tasks = None, max(1, tasks * BROADCAST_BLOCKS // (4 * entries))
    edges = [r["first"] for r in directory.select("first").sample(min(1.0, 4 / BROADCAST_BLOCKS), seed=1).orderBy("first").collect()]
    for lo, hi in zip([None, *edges], [*edges, None], strict=True):
        mine, part = wanted, directory
        if lo is not None:
            mine = mine.where(F.col("key") >= lo)
            before = directory.where(F.col("first") < lo).orderBy(F.desc("first"), F.desc("shard"), F.desc("offset")).limit(1)
            part = part.where(F.col("first") >= lo).unionByName(before)
        if hi is not None:
            mine, part = mine.where(F.col("key") < hi), part.where(F.col("first") < hi)
        blocks = [tuple(r) for r in part.orderBy("first", "shard", "offset").select("first", "shard", "offset", "length").collect()]
        answer = mine.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(_lookup(blocks, index, archive), schema)
        found = answer if found is None else found.unionByName(answer)
    return found


def index_pages(pages: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(page_id, url_key, n_bytes, digest) of every page, read back through the index: pages are archived, indexed, and the
    URL of each is looked up; n_bytes and digest (MD5) are of the body found.

    Pages that share a key are all found, each once. Rows with a null page_id or url are not captured; a null html is an
    empty body; repeated rows are captures of their own. An empty table gives no rows. Other columns are ignored."""
    spark = pages.sparkSession
    archive, index = fresh_path(spark, "archive"), fresh_path(spark, "index")
    captures = write_archive(pages, archive)
    directory = build_index(captures, index, block_lines)
    queries = pages.select(url_key(F.col("url")).alias("key"))
    found = look_up(spark, queries, directory, index, archive)
    return found.select("page_id", F.col("key").alias("url_key"), F.octet_length("body").cast("long").alias("n_bytes"), F.md5("body").alias("digest"))
