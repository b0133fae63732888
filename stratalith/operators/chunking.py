"""Content-defined chunks: a rolling checksum over 64 bytes cuts contents where its low bits are all ones.

The checksum is a pair of sums over its window, and its low bits need them modulo 2**16 only. Both sums of 64 bytes come from
those of 32, and so on, so all cut candidates of a block of contents are found in some passes of additions over 16-bit
integers. Only the restart of the window at each chunk is sequential, and it concerns no more than 63 positions a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
BITS, FAN_BITS, TREE_MOST = 13, 4, 256
_S1, _S2 = 64 * 31, 64 * 63 * 31
_BLOCK = 4 << 20
#: Bytes a core below which an input counts as small.
_SMALL = 16 << 20
_CHUNKS = pa.schema([("key", pa.int64()), ("seq", pa.int32()), ("ofs", pa.int64()), ("len", pa.int32()), ("level", pa.int32()), ("oid", pa.string())])


def _masks(bits: int) -> tuple[int, int]:
    if not 13 <= bits <= 21:
        raise ValueError("bits must be from 13 to 21")
    return (1 << max(0, bits - 16)) - 1, ((1 << bits) - 1) & 0xFFFF


U16 = np.uint16
_PASS = 1 << 15


def digests(data: np.ndarray, at: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The checksum at each position of `at`, of the window that begins at lo or 63 bytes before the position."""
    back = at[:, None] - np.arange(WINDOW)
    bytes_ = np.where(back >= lo[:, None], data[np.maximum(back, 0)], 0).astype(np.int64)
    s1, s2 = _S1 + bytes_.sum(axis=1), _S2 + (bytes_ * np.arange(1, WINDOW + 1)).sum(axis=1)
    return ((s1 << 16) | (s2 & 0xFFFF)) & 0xFFFFFFFF


def _candidates(s1: np.ndarray, s2: np.ndarray, m1: int, m2: int) -> np.ndarray:
    """Where both sums, without what the window begins with, have all bits of the masks."""
    hit = ((s2 + U16(_S2 & 0xFFFF)) & U16(m2)) == U16(m2)
    return hit & (((s1 + U16(_S1)) & U16(m1)) == U16(m1)) if m1 else hit


def full_windows(data: np.ndarray, m1: int, m2: int) -> np.ndarray:
    """Candidates among the positions that end a window of 64 bytes, wherever contents begin; in passes that fit a cache.

    Of windows of n bytes, s1 is the sum and s2 the sum of bytes times n, n - 1, ..., 1; two neighbours make one of 2n."""
    found = [np.zeros(0, dtype=np.int64)]
    for a in range(0, len(data) - WINDOW + 1, _PASS):
        s1 = data[a : a + _PASS + WINDOW - 1].astype(U16)
        s2, n = s1, 1
        while n < WINDOW:
            wide = s1[:-n] * U16(n)
            wide += s2[:-n]
            wide += s2[n:]
            s1, s2, n = s1[:-n] + s1[n:], wide, 2 * n
        found.append(np.flatnonzero(_candidates(s1, s2, m1, m2)) + (a + WINDOW - 1))
    return np.concatenate(found)


def early_windows(data: np.ndarray, m1: int, m2: int) -> np.ndarray:
    """Whether positions are candidates whose windows begin with the row of data that they are in (at most 63 bytes each)."""
    s1 = np.cumsum(data, axis=-1, dtype=U16)
    return _candidates(s1, np.cumsum(s1, axis=-1, dtype=U16), m1, m2)


def rolling_digest(data: bytes) -> int:
    """The checksum after all of data, from a window of zeros."""
    if not data:
        return ((_S1 << 16) | (_S2 & 0xFFFF)) & 0xFFFFFFFF
    tail = np.frombuffer(data[-WINDOW:], dtype=np.uint8)
    return int(digests(tail, np.array([len(tail) - 1]), np.array([0]))[0])


def levels(checksums: np.ndarray, bits: int, fan_bits: int) -> np.ndarray:
    """Ones above the cut bits, one bit being skipped, in units of fan_bits."""
    rest = checksums >> (bits + 1)
    ones = np.zeros(len(checksums), dtype=np.int64)
    live = (rest & 1) == 1
    while live.any():
        ones[live] += 1
        rest = rest >> 1
        live = live & ((rest & 1) == 1)
    return ones // fan_bits


def cut(data: np.ndarray, bounds: np.ndarray, bits: int = BITS, fan_bits: int = FAN_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, end, level) of every chunk of contents laid end to end; content i is data[bounds[i]:bounds[i + 1]].

    A content ends with the chunk that its end cuts off, of level 0; without a candidate a chunk ends at 2**(bits + 2)."""
    if fan_bits < 1:
        raise ValueError("fan_bits must be at least 1")
    m1, m2 = _masks(bits)
    sizes = np.diff(bounds)
    # The first 63 bytes of each content have shorter windows; behind them, positions whose window lies inside the content.
    near, full = np.arange(WINDOW - 1), np.flatnonzero(sizes)
    spots = bounds[:-1][full][:, None] + near
    first = spots[early_windows(data[np.minimum(spots, len(data) - 1)], m1, m2) & (near < sizes[full][:, None])] if len(full) else full
    hits = full_windows(data, m1, m2)
    hits = hits[hits >= bounds[np.searchsorted(bounds, hits, side="right") - 1] + WINDOW - 1]
    hits = np.sort(np.r_[first, hits])
    most = 1 << (bits + 2)
    a, b = np.searchsorted(hits, bounds[:-1]), np.searchsorted(hits, bounds[1:])
    simple = np.flatnonzero((a == b) & (sizes <= most) & (sizes > 0))
    owners, ends, starts, real = [simple], [bounds[1:][simple]], [bounds[:-1][simple]], [np.zeros(len(simple), dtype=bool)]
    for i in np.flatnonzero((sizes > 0) & ((a != b) | (sizes > most))).tolist():
        c, stop, mine, own_ends, own_real = int(bounds[i]), int(bounds[i + 1]), hits[a[i] : b[i]], [], []
        first = c
        while c < stop:
            limit, found = min(stop, c + most), -1
            if c > first:  # the window restarts here: nearby positions see fewer bytes than the block-wide pass did
                early = early_windows(data[c : min(c + WINDOW - 1, limit)], m1, m2)
                at = int(early.argmax())
                found = c + at if early[at] else -1
            if found < 0:
                k = int(np.searchsorted(mine, c + WINDOW - 1 if c > first else c))
                if k < len(mine) and mine[k] < limit:
                    found = int(mine[k])
            c = found + 1 if found >= 0 else limit
            own_ends.append(c)
            own_real.append(found >= 0)
        owners.append(np.full(len(own_ends), i))
        ends.append(np.array(own_ends))
        starts.append(np.array([first, *own_ends[:-1]]))
        real.append(np.array(own_real))
    owner, end, start, hit = (np.concatenate(x) for x in (owners, ends, starts, real))
    order = np.argsort(end, kind="stable")
    owner, end, start, hit = owner[order], end[order].astype(np.int64), start[order].astype(np.int64), hit[order]
    level = np.zeros(len(end), dtype=np.int64)
    if hit.any():
        p = end[hit] - 1
        level[hit] = levels(digests(data, p, start[hit]), bits, fan_bits)
    return owner, end, level


def is_cut(data: np.ndarray, start: int, end: int, bits: int = BITS) -> bool:
    """Whether the chunk data[start:end] ends where its checksum or its length cuts it, and not only where data does."""
    if end - start == 1 << (bits + 2):
        return True
    m1, m2 = _masks(bits)
    digest = int(digests(data, np.array([end - 1]), np.array([start]))[0])
    return digest & m2 == m2 and (digest >> 16) & m1 == m1


def blob_id(data: bytes | memoryview) -> str:
    h = hashlib.sha1(b"blob %d\0" % len(data))
    h.update(data)
    return h.hexdigest()


def tree_id(entries: Sequence[tuple[int, bytes, str]]) -> str:
    """Id of a directory of (mode, name, hex id)."""
    ordered = sorted(entries, key=lambda e: e[1] + b"/" if e[0] & 0o170000 == 0o040000 else e[1])
    body = b"".join(b"%o %s\0%s" % (m, n, bytes.fromhex(o)) for m, n, o in ordered)
    return hashlib.sha1(b"tree %d\0" % len(body) + body).hexdigest()


def fold_chunks(chunks: Sequence[tuple[str, int, int]], most: int = TREE_MOST) -> tuple[int, str, int, list[tuple[str, list[tuple[int, bytes, str]]]]]:
    """(mode, id, size, nodes) of the tree over a file's chunks (id, length, level); nodes are (id, entries), children first.

    A chunk of level n closes all stacks below n, and a stack of `most` entries closes by itself; a single entry moves up
    as it is. Names are hex offsets within the node, padded to the width of its size."""
    stacks: list[list[tuple[int, str, int]]] = [[]]
    nodes: list[tuple[str, list[tuple[int, bytes, str]]]] = []

    def named(stack: Sequence[tuple[int, str, int]]) -> list[tuple[int, bytes, str]]:
        width, at, out = len(f"{sum(x[2] for x in stack):x}"), 0, []
        for mode, oid, size in stack:
            out.append((mode, f"{at:0{width}x}".encode(), oid))
            at += size
        return out

    def close(below: int) -> None:
        """Closes the stacks under `below`, and those above as long as they are full."""
        for depth in range(64):
            if depth >= below and len(stacks[depth]) < most:
                break
            full, stacks[depth] = stacks[depth], []
            if depth + 1 == len(stacks):
                stacks.append([])
            if len(full) > 1:
                entries = named(full)
                oid = tree_id(entries)
                nodes.append((oid, entries))
                full = [(0o040000, oid, sum(x[2] for x in full))]
            stacks[depth + 1] += full

    for oid, size, level in chunks:
        stacks[0].append((0o100644, oid, size))
        close(level)
    close(len(stacks) - 1)
    last = stacks[-1]
    if not last:
        return 0o100644, blob_id(b""), 0, nodes
    if len(last) == 1:
        return (*last[0], nodes)
    entries = named(last)
    nodes.append((tree_id(entries), entries))
    return 0o040000, nodes[-1][0], sum(x[2] for x in last), nodes


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, data, bounds) of blocks of whole contents."""
    for batch in batches:
        content = batch.column(1).cast(pa.large_binary())
        sizes = np.asarray(pc.fill_null(pc.binary_length(content), 0), dtype=np.int64)
        total, at = np.cumsum(sizes), 0
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _BLOCK, side="right")))
            part = content.slice(at, to - at)
            offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
            raw = part.buffers()[2]
            data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
            yield keys[at:to], data, offsets - offsets[0]
            at = to


def _spread(df: DataFrame) -> DataFrame:
    """Small inputs, as a file of a single row group, are spread over all cores; large ones stay as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, "key") if size < cores * _SMALL else df


def _splitter(bits: int, fan_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, bounds in _contents(batches):
            owner, end, level = cut(data, bounds, bits, fan_bits)
            first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, dtype=bool)
            start = np.where(first, bounds[owner], np.r_[0, end[:-1]]) if len(owner) else end
            rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0)) if len(owner) else end
            view = memoryview(data)
            oids = [blob_id(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            columns = [keys[owner], rank.astype(np.int32), start - bounds[owner], (end - start).astype(np.int32), level.astype(np.int32), oids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CHUNKS.types, strict=True)], schema=_CHUNKS)

    return run


def chunks(df: DataFrame, key: str, content: Column, bits: int = BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """(key, seq, ofs, len, level, oid) of every chunk of every row's content; null and empty contents have none.

    No shuffle, unless the input is small for the number of cores: each row is cut where it lies, and the contents themselves
    are not copied out."""
    rows = df.select(F.col(key).cast("long").alias("key"), content.alias("content")).where("content IS NOT NULL")
    return _spread(rows).mapInArrow(_splitter(bits, fan_bits), "key long, seq int, ofs long, len int, level int, oid string").withColumnRenamed("key", key)


def _rooter(bits: int, fan_bits: int, most: int, nodes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, bounds in _contents(batches):
            owner, end, level = cut(data, bounds, bits, fan_bits)
            view, rows, at = memoryview(data), [], 0
            for i, key in enumerate(keys.tolist()):
                own, start = [], int(bounds[i])
                while at < len(owner) and owner[at] == i:
                    stop = int(end[at])
                    own.append((blob_id(view[start:stop]), stop - start, int(level[at])))
                    start, at = stop, at + 1
                mode, oid, size, trees = fold_chunks(own, most)
                if nodes:
                    rows += [(key, tree, place, m, n.decode(), o) for tree, entries in trees for place, (m, n, o) in enumerate(entries)]
                else:
                    rows.append((key, mode, oid, size, len(own), len(trees)))
            names = ["key", "tree", "pos", "mode", "name", "oid"] if nodes else ["key", "mode", "oid", "size", "chunks", "trees"]
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()] if nodes else [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def file_roots(df: DataFrame, key: str, content: Column, bits: int = BITS, fan_bits: int = FAN_BITS, most: int = TREE_MOST) -> DataFrame:
    """(key, mode, oid, size, chunks, trees): each content's identity, the id of its only chunk or of the tree over its chunks."""
    rows = df.select(F.col(key).cast("long").alias("key"), content.alias("content")).where("content IS NOT NULL")
    return _spread(rows).mapInArrow(_rooter(bits, fan_bits, most, False), "key long, mode int, oid string, size long, chunks int, trees int").withColumnRenamed("key", key)


def file_nodes(df: DataFrame, key: str, content: Column, bits: int = BITS, fan_bits: int = FAN_BITS, most: int = TREE_MOST) -> DataFrame:
    """(key, tree, pos, mode, name, oid): the entries of all trees over contents of several chunks."""
    rows = df.select(F.col(key).cast("long").alias("key"), content.alias("content")).where("content IS NOT NULL")
    return _spread(rows).mapInArrow(_rooter(bits, fan_bits, most, True), "key long, tree string, pos int, mode int, name string, oid string").withColumnRenamed("key", key)


def rolling_digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest): the checksum after each whole text, from its last 64 bytes; higher-order functions only."""
    raw = F.hex(F.encode(F.col(text), "UTF-8"))
    tail = F.substr(raw, F.greatest(F.length(raw) - 127, F.lit(1)))
    n = (F.length(F.col("tail")) / 2).cast("int")
    byte = lambda i: F.conv(F.substr(F.col("tail"), 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    s1 = F.aggregate(places, F.lit(_S1).cast("long"), lambda acc, i: acc + byte(i))
    s2 = F.aggregate(places, F.lit(_S2).cast("long"), lambda acc, i: acc + byte(i) * (n - i))
    digest = F.shiftleft(s1, 16).bitwiseOR(s2.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))
    return df.where(F.col(text).isNotNull()).select(F.col(key), tail.alias("tail")).select(key, digest.alias("digest"))


def cut_out(content: Column) -> Column:
    """The bytes of a chunk (ofs, len) of its content."""
    return F.substr(content, (F.col("ofs") + 1).cast("int"), F.col("len"))


def join_chunks(parts: DataFrame, key: str, content: str = "part") -> DataFrame:
    """(key, content): chunks (key, seq, content) put together again in order."""
    return parts.groupBy(key).agg(F.expr(f"listagg(`{content}`) WITHIN GROUP (ORDER BY seq)").alias("content"))


def read_range(parts: DataFrame, key: str, begin: Column, size: Column, content: str = "part") -> DataFrame:
    """(key, content): bytes begin to begin + size of each content, from only those of its chunks (ofs, len) that overlap them."""
    touched = parts.where((F.col("ofs") < begin + size) & (F.col("ofs") + F.col("len") > begin))
    lo = F.greatest(begin - F.col("ofs"), F.lit(0))
    hi = F.least(begin + size - F.col("ofs"), F.col("len").cast("long"))
    return join_chunks(touched.withColumn(content, F.substr(F.col(content), (lo + 1).cast("int"), (hi - lo).cast("int"))), key, content)


def sizes_from_chunks(parts: DataFrame, key: str) -> DataFrame:
    """(key, size): where the last chunk ends."""
    return parts.groupBy(key).agg(F.max_by(F.col("ofs") + F.col("len"), "ofs").cast("long").alias("size"))


def hex_offsets(parts: DataFrame, key: str) -> DataFrame:
    """parts with `name`: the chunk's offset in hex, padded to the width of the whole size."""
    total = F.sum("len").over(Window.partitionBy(key))
    return parts.withColumn("name", F.lpad(F.lower(F.hex("ofs")), F.length(F.hex(total)), F.lit("0")))


def zero_runs(df: DataFrame, key: str, content: Column, least: int = 512, byte: int = 0) -> DataFrame:
    """(key, ofs, len): runs of at least `least` equal bytes (zeros), which a sparse file leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, bounds in _contents(batches):
            match = data == byte
            owner = np.repeat(np.arange(len(keys)), np.diff(bounds))
            edge = np.flatnonzero(np.r_[True, (match[1:] != match[:-1]) | (owner[1:] != owner[:-1])]) if len(data) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.r_[edge, len(data)])
            keep = match[edge] & (size >= least)
            at = edge[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys[owner[at]], pa.int64()), pa.array(at - bounds[owner[at]]), pa.array(size[keep].astype(np.int64))], names=["key", "ofs", "len"])

    rows = df.select(F.col(key).cast("long").alias("key"), content.alias("content")).where("content IS NOT NULL")
    return rows.mapInArrow(run, "key long, ofs long, len long").withColumnRenamed("key", key)


def chunks_across(df: DataFrame, group: str, order: str, content: Column, bits: int = BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """(group, seq, ofs, len, level, oid): chunks of each group's contents laid end to end in order, so that a chunk may span
    several of them. A group is one task's memory."""
    import pandas as pd

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        data = b"".join(bytes(c) for c in part["content"])
        _, end, level = cut(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), bits, fan_bits)
        start = np.r_[0, end[:-1]] if len(end) else end
        oids = [blob_id(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return pd.DataFrame({"grp": [part["grp"].iloc[0]] * len(end), "seq": np.arange(len(end)), "ofs": start, "len": end - start, "level": level, "oid": oids})

    rows = df.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("ord"), content.alias("content")).where("content IS NOT NULL")
    return rows.groupBy("grp").applyInPandas(run, "grp string, seq int, ofs long, len int, level int, oid string").withColumnRenamed("grp", group)
