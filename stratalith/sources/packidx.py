"""The public pack index format. Version 2: fan-out, sorted ids, checksums, offsets (long ones apart), two SHA-1 trailers.
Version 1: fan-out, then offset and id of each object."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\xfftOc\x00\x00\x00\x02"
_FIELDS = "pack string, oid string, crc long, ofs long"


def encode_index(entries: list[tuple[bytes, int, int]], pack_sha: bytes = bytes(20)) -> bytes:
    """File of (id, crc, offset)."""
    entries = sorted(entries)
    firsts = np.bincount(np.frombuffer(bytes(e[0][0] for e in entries), dtype=np.uint8), minlength=256).cumsum()
    long = [o for _, _, o in entries if o >= 1 << 31]
    number = iter(range(len(long)))
    short = [o if o < 1 << 31 else 1 << 31 | next(number) for _, _, o in entries]
    body = MAGIC + firsts.astype(">u4").tobytes() + b"".join(e[0] for e in entries) + np.array([e[1] for e in entries], dtype=">u4").tobytes() + np.array(short, dtype=">u4").tobytes() + np.array(long, dtype=">u8").tobytes() + pack_sha
    return body + hashlib.sha1(body).digest()


def decode_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids as rows of 20 bytes, crc, ofs); version 1 has no checksums, which are -1 then."""
    if data[:8] != MAGIC:
        return _decode_first(data)
    n = int.from_bytes(data[8 + 255 * 4 : 8 + 256 * 4], "big")
    at = 8 + 1024
    ids = np.frombuffer(data, dtype=np.uint8, count=20 * n, offset=at).reshape(n, 20)
    crc = np.frombuffer(data, dtype=">u4", count=n, offset=at + 20 * n).astype(np.int64)
    ofs = np.frombuffer(data, dtype=">u4", count=n, offset=at + 24 * n).astype(np.int64)
    far = np.flatnonzero(ofs & 1 << 31)
    if len(far):
        table = np.frombuffer(data, dtype=">u8", offset=at + 28 * n, count=(len(data) - at - 28 * n - 40) // 8)
        ofs[far] = table[ofs[far] & (1 << 31) - 1].astype(np.int64)
    return ids, crc, ofs


def _decode_first(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fan = np.frombuffer(data[:1024], dtype=">u4")
    if len(data) < 1024 + 40 or (np.diff(fan.astype(np.int64)) < 0).any() or len(data) != 1024 + 24 * int(fan[-1]) + 40:
        raise ValueError("not a pack index of version 1 or 2")
    rows = np.frombuffer(data, dtype=np.dtype([("ofs", ">u4"), ("id", "u1", 20)]), count=int(fan[-1]), offset=1024)
    return rows["id"], np.full(len(rows), -1, dtype=np.int64), rows["ofs"].astype(np.int64)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, crc, ofs = decode_index(content)
            name = path.rsplit("/", 1)[-1].removesuffix(".idx")
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array([x.tobytes().hex() for x in ids], pa.string()), pa.array(crc), pa.array(ofs)], names=["pack", "oid", "crc", "ofs"])


def read_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """(pack, oid, crc, ofs) of all index files of a folder, a task a file or several."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder).select("path", "content")
    return files.mapInArrow(_decode, _FIELDS)
