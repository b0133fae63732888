"""Encodings of single values: variable-length integers in SQL, and Arrow functions for compressed and tagged records."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

_KINDS = {"commit": 1, "tree": 2, "blob": 3, "tag": 4}
_NAMES = {v: k for k, v in _KINDS.items()}


def _septets(x: Column, wanted: Column) -> Column:
    parts = []
    for i in range(9):
        rest = F.shiftrightunsigned(x, 7 * i)
        more = F.shiftrightunsigned(x, 7 * (i + 1)) if i < 8 else F.lit(0).cast("long")
        byte = rest.bitwiseAND(F.lit(127)).bitwiseOR(F.when(more != 0, 128).otherwise(0))
        here = wanted if i == 0 else wanted & (rest != 0)
        parts.append(F.when(here, F.lpad(F.hex(byte), 2, F.lit("0"))).otherwise(""))
    return F.concat(*parts)


def vuint_hex(x: Column) -> Column:
    """Hex of a non-negative BIGINT in groups of seven bits, the least first; negative ones are null."""
    return F.when(x >= 0, _septets(x.cast("long"), F.lit(True)))


def vint_hex(x: Column) -> Column:
    """Hex of a BIGINT: the first byte has the sign in its second bit and six bits of the size."""
    size = F.abs(x.cast("long"))
    rest = F.shiftrightunsigned(size, 6)
    first = size.bitwiseAND(F.lit(63)).bitwiseOR(F.when(x < 0, 64).otherwise(0)).bitwiseOR(F.when(rest != 0, 128).otherwise(0))
    return F.concat(F.lpad(F.hex(first), 2, F.lit("0")), _septets(rest, rest != 0))


def encode_vuint(x: int) -> bytes:
    if x < 0:
        raise ValueError("cannot encode a negative value")
    out = bytearray()
    while x > 127:
        out.append(128 | x & 127)
        x >>= 7
    out.append(x)
    return bytes(out)


def encode_vint(x: int) -> bytes:
    size = abs(x)
    first = (size & 63) | (64 if x < 0 else 0)
    return bytes([first]) if size < 64 else bytes([first | 128]) + encode_vuint(size >> 6)


def decode_vuint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, where it ends)."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if not b & 128:
            return value, at


def decode_vint(data: bytes, at: int = 0) -> tuple[int, int]:
    first = data[at]
    value, at = first & 63, at + 1
    if first & 128:
        rest, at = decode_vuint(data, at)
        value |= rest << 6
    return (-value if first & 64 else value), at


def encode_bytes(data: bytes) -> bytes:
    return encode_vuint(len(data)) + data


def pack(kinds: str, *values: int | bytes) -> bytes:
    """Values one after another, by a letter each: V unsigned, v signed, s bytes with their length."""
    if len(kinds) != len(values):
        raise ValueError(f"{len(values)} values for {len(kinds)} kinds")
    encode = {"V": encode_vuint, "v": encode_vint, "s": encode_bytes}
    return b"".join(encode[k](v) for k, v in zip(kinds, values, strict=True))


def unpack(kinds: str, data: bytes) -> list[int | bytes]:
    """What pack() put together; data that ends early or goes on is an error."""
    out: list[int | bytes] = []
    at = 0
    try:
        for k in kinds:
            value, at = decode_vint(data, at) if k == "v" else decode_vuint(data, at)
            if k == "s":
                if at + value > len(data):
                    raise IndexError
                value, at = data[at : at + value], at + value
            out.append(value)
    except IndexError:
        raise ValueError("the data ends early") from None
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes are left")
    return out


@F.pandas_udf(LongType())
def vint_value(encoded: pd.Series) -> pd.Series:
    """BIGINT of an encoded integer, null for null."""
    return pd.Series([None if x is None else decode_vint(bytes(x))[0] for x in encoded], dtype="Int64")


def encode_object(kind: str, content: bytes, level: int = 1) -> bytes:
    """Kind and size in groups of seven bits (four in the first byte, beside the kind), then deflated content."""
    size = len(content)
    out = bytearray([_KINDS[kind] << 4 | size & 15])
    size >>= 4
    while size:
        out[-1] |= 128
        out.append(size & 127)
        size >>= 7
    return bytes(out) + zlib.compress(content, level)


def decode_object(data: bytes) -> tuple[str, bytes]:
    at, kind = 0, data[0] >> 4 & 7
    while data[at] & 128:
        at += 1
    return _NAMES[kind], zlib.decompress(data[at + 1 :])


#: Bytes of contents that are made before they are handed on: Spark's batches have a number of rows, whatever their size.
SLICE_BYTES = 1 << 20


def _slices(values: Iterable, size: Callable[..., int], make: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """Arrays of neighbouring values, of about SLICE_BYTES each."""
    held, n = [], 0
    for value in values:
        held.append(value)
        n += 64 + size(value)
        if n >= SLICE_BYTES:
            yield make(held)
            held, n = [], 0
    if held:
        yield make(held)


def _records(kinds: pa.Array, contents: pa.Array) -> Iterator[bytes | None]:
    for k, c in zip(kinds, contents, strict=True):
        yield encode_object(k.as_py(), memoryview(c.as_buffer())) if k.is_valid and c.is_valid else None


def _objects(records: pa.Array) -> Iterator[tuple[str | None, bytes | None]]:
    for r in records:
        yield decode_object(memoryview(r.as_buffer())) if r.is_valid else (None, None)


def _struct(pairs: list) -> pa.Array:
    kinds, contents = zip(*pairs, strict=True)
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(contents, pa.binary())], ["kind", "content"])


@F.arrow_udf(BinaryType())
def object_record(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Record of (kind, content)."""
    for kinds, contents in batches:
        yield from _slices(_records(kinds, contents), lambda r: len(r or b""), lambda held: pa.array(held, pa.binary()))
        del kinds, contents  # before the next batch is read


@F.arrow_udf(StructType().add("kind", StringType()).add("content", BinaryType()))
def object_content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for records in batches:
        yield from _slices(_objects(records), lambda o: len(o[1] or b""), _struct)
        del records


#: Tags of a metadata record and the fields each holds (V unsigned, v signed, s bytes).
FIELDS = {1: (("path", "s"),), 2: (("mode", "V"), ("uid", "V"), ("user", "s"), ("gid", "V"), ("grp", "s"), ("rdev", "V"), ("atime", "v"), ("mtime", "v"), ("ctime", "v"), ("size", "v")), 3: (("symlink", "s"),), 4: (("hardlink", "s"),)}
METADATA = StructType()
for _name, _kind in (f for group in FIELDS.values() for f in group):
    METADATA.add(_name, StringType() if _kind == "s" else LongType())


def encode_metadata(fields: dict) -> bytes:
    """Tagged records, each with its length, ended by tag 0; a group whose fields are all missing is left out."""
    out = b""
    for tag, group in FIELDS.items():
        if all(fields.get(n) is None for n, _ in group):
            continue
        body = b""
        for name, kind in group:
            value = fields.get(name)
            body += encode_bytes((value or "").encode()) if kind == "s" else encode_vuint(int(value or 0)) if kind == "V" else encode_vint(int(value or 0))
        out += encode_vuint(tag) + encode_bytes(body)
    return out + encode_vuint(0)


def decode_metadata(data: bytes) -> dict:
    """Fields by name; tags that are not known are skipped."""
    out: dict = {}
    at = 0
    while True:
        tag, at = decode_vuint(data, at)
        if tag == 0:
            return out
        size, at = decode_vuint(data, at)
        body, at = data[at : at + size], at + size
        place = 0
        for name, kind in FIELDS.get(tag, ()):
            if kind == "s":
                n, place = decode_vuint(body, place)
                out[name], place = body[place : place + n].decode(), place + n
            else:
                out[name], place = decode_vuint(body, place) if kind == "V" else decode_vint(body, place)


@F.pandas_udf(BinaryType())
def metadata_record(fields: pd.DataFrame) -> pd.Series:
    """Record of a struct of METADATA's fields (any of them)."""
    clean = fields.astype(object).where(fields.notna(), None)
    return pd.Series([encode_metadata(r) for r in clean.to_dict("records")], dtype=object)


@F.pandas_udf(METADATA)
def metadata_fields(records: pd.Series) -> pd.DataFrame:
    names = [n for group in FIELDS.values() for n, _ in group]
    rows = [decode_metadata(bytes(r)) if r is not None else {} for r in records]
    return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)


def split_words(line: str) -> Sequence[tuple[int, str]]:
    """(offset, word) of a command line with quotes and backslashes."""
    words, word, start, quote, escaped = [], "", None, "", False
    for i, c in enumerate(line):
        if escaped:
            word += c if quote != '"' or c in '"\\' else "\\" + c
            escaped = False
        elif c == "\\" and quote != "'":
            start, escaped = (i if start is None else start), True
        elif quote:
            quote, word = ("", word) if c == quote else (quote, word + c)
        elif c in "'\"":
            start, quote = (i if start is None else start), c
        elif c.isspace():
            if start is not None:
                words.append((start, word))
            word, start = "", None
        else:
            start, word = (i if start is None else start), word + c
    if start is not None:
        words.append((start, word))
    return words


def decode_tree(data: bytes) -> list[tuple[int, str, str]]:
    """(mode, name, hex id) of each entry of an encoded directory."""
    out, at = [], 0
    while at < len(data):
        blank, nul = data.index(b" ", at), data.index(b"\0", at)
        out.append((int(data[at:blank], 8), data[blank + 1 : nul].decode("utf-8", "surrogateescape"), data[nul + 1 : nul + 21].hex()))
        at = nul + 21
    return out


_ENTRY = StructType().add("mode", LongType()).add("name", StringType()).add("oid", StringType())


@F.pandas_udf(ArrayType(_ENTRY))
def tree_entries(contents: pd.Series) -> pd.Series:
    """Array of (mode, name, oid) of an encoded directory; null for null."""
    return pd.Series([None if c is None else [{"mode": m, "name": n, "oid": o} for m, n, o in decode_tree(bytes(c))] for c in contents], dtype=object)


def columnate(words: Sequence[str], width: int = 80, prefix: str = "") -> str:
    """Words in columns, top down, as many columns as fit the width."""
    if not words:
        return ""
    longest = max(map(len, words))
    columns = max(1, (width - len(prefix)) // (longest + 2))
    rows = -(-len(words) // columns)
    pad = longest + 2 if columns > 1 else 0
    return "".join(prefix + "".join(w.ljust(pad) for w in words[r::rows]) + "\n" for r in range(rows))
