"""The public pack format, version 2, without deltas: a head, records of deflated objects, and a SHA-1 of what comes before it."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stratalith.functions.codecs import encode_object

HEAD = b"PACK\x00\x00\x00\x02"
_KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
_SCHEMA = pa.schema([("pack", pa.string()), ("ofs", pa.int64()), ("kind", pa.string()), ("size", pa.int64()), ("oid", pa.string()), ("crc", pa.int64()), ("content", pa.binary())])
_DDL = "pack string, ofs long, kind string, size long, oid string, crc long, content binary"


def encode_pack(objects: list[tuple[str, bytes]]) -> bytes:
    """File of (kind, content)."""
    body = HEAD + len(objects).to_bytes(4, "big") + b"".join(encode_object(kind, content) for kind, content in objects)
    return body + hashlib.sha1(body).digest()


def decode_pack(data: bytes, skip_blobs: bool = False) -> Iterator[tuple[int, str, int, str | None, int, bytes | None]]:
    """(ofs, kind, size, id, checksum of the record, content) of every object in turn; blobs that are skipped have neither id nor
    content. A file that is cut short, or damaged, is an error."""
    if data[:8] != HEAD:
        raise ValueError("not a pack of version 2")
    if hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("the pack's checksum is wrong")
    at = 12
    for _ in range(int.from_bytes(data[8:12], "big")):
        begin, byte = at, data[at]
        kind, size, shift, at = byte >> 4 & 7, byte & 15, 4, at + 1
        while byte & 128:
            byte, at = data[at], at + 1
            size |= (byte & 127) << shift
            shift += 7
        if kind not in _KINDS:
            raise ValueError(f"record of kind {kind} at {begin}")
        inflate = zlib.decompressobj()
        content = inflate.decompress(data[at:-20])
        if not inflate.eof or len(content) != size:
            raise ValueError(f"the record at {begin} does not hold {size} bytes")
        at = len(data) - 20 - len(inflate.unused_data)
        crc, name = zlib.crc32(data[begin:at]), _KINDS[kind]
        if skip_blobs and name == "blob":
            yield begin, name, size, None, crc, None
        else:
            yield begin, name, size, hashlib.sha1(f"{name} {size}\0".encode() + content).hexdigest(), crc, content


def _scan(skip_blobs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, held, size = path.rsplit("/", 1)[-1].removesuffix(".pack"), [], 0
                for row in decode_pack(data, skip_blobs):
                    held.append((name, *row))
                    size += len(row[5] or b"") + 100
                    if size > 4 << 20:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def read_packs(spark: SparkSession, folder: str, skip_blobs: bool = False) -> DataFrame:
    """(pack, ofs, kind, size, oid, crc, content) of every object of a folder's packs, a task a pack or several."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").load(folder).select("path", "content")
    return files.mapInArrow(_scan(skip_blobs), _DDL)
