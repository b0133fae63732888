"""Splitting directories: names are fed to the rolling checksum, and groups of entries become nodes of a tree."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.operators.chunking import BITS, WINDOW, _masks


@dataclass
class RecordSplitter:
    """feed() says whether a group ends after the record. The window runs on across records and restarts after a cut; a
    group longer than 2**(bits + 2) bytes is cut as well."""

    bits: int = BITS
    window: bytearray = field(default_factory=lambda: bytearray(WINDOW))
    place: int = 0
    s1: int = WINDOW * 31
    s2: int = WINDOW * 63 * 31
    size: int = 0

    def restart(self) -> None:
        self.window, self.place, self.s1, self.s2, self.size = bytearray(WINDOW), 0, WINDOW * 31, WINDOW * 63 * 31, 0

    def feed(self, record: bytes) -> tuple[bool, int | None]:
        m1, m2 = _masks(self.bits)
        for b in record:
            gone = self.window[self.place]
            self.s1 += b - gone
            self.s2 += self.s1 - WINDOW * (gone + 31)
            self.window[self.place], self.place = b, (self.place + 1) % WINDOW
            if self.s2 & m2 == m2 and self.s1 & m1 == m1:
                rest = (((self.s1 << 16) | (self.s2 & 0xFFFF)) & 0xFFFFFFFF) >> (self.bits + 1)
                extra = 0
                while rest & 1:
                    extra, rest = extra + 1, rest >> 1
                self.restart()
                self.size = len(record)
                if self.size > 1 << (self.bits + 2):
                    self.restart()
                return True, self.bits + extra
        self.size += len(record)
        if self.size > 1 << (self.bits + 2):
            self.restart()
            return True, None
        return False, None


def split_names(names: Sequence[str], bits: int = BITS) -> list[int]:
    """Group of each name; a group has more than one name, unless it is the last."""
    splitter, groups, held, group = RecordSplitter(bits), [], 0, 0
    for name in names:
        groups.append(group)
        held += 1
        if splitter.feed(name.encode())[0] and held > 1:
            group, held = group + 1, 0
    return groups


def split_directories(entries: DataFrame, directory: str, name: str, bits: int = BITS) -> DataFrame:
    """(directory, level, grp, first, last, members): how each directory's names, in byte order, split into groups, and the
    groups' first names in turn, until one group is left. A directory is one task's group."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        names = sorted((x for x in batch["name"] if x is not None), key=str.encode)
        nodes = [(x, x, x) for x in names]
        rows, level = [], 0
        while nodes:
            groups = split_names([n[0] for n in nodes], bits)
            parts = [[n for n, g in zip(nodes, groups, strict=True) if g == k] for k in range(groups[-1] + 1)]
            rows += [(batch["directory"].iloc[0], level, k, p[0][1], p[-1][2], len(p)) for k, p in enumerate(parts)]
            if len(parts) == 1:
                break
            nodes, level = [(p[0][0], p[0][1], p[-1][2]) for p in parts], level + 1
        return pd.DataFrame(rows, columns=["directory", "level", "grp", "first", "last", "members"])

    rows = entries.select(F.col(directory).cast("string").alias("directory"), F.col(name).alias("name"))
    return rows.groupBy("directory").applyInPandas(run, "directory string, level int, grp int, first string, last string, members int")


def abbreviate(names: Sequence[bytes]) -> list[bytes]:
    """Each name cut behind the first byte that tells it from all names that are neither its prefix nor begin with it.

    '.' and '..' never result. Sorted neighbours do not suffice, as prefix-related ones do not count, so the longest common
    prefix is sought outward until it cannot grow."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    ranked = [names[i] for i in order]
    out: list[bytes] = [b""] * len(names)

    def common(a: bytes, b: bytes) -> int:
        n = 0
        for x, y in zip(a, b):  # noqa: B905
            if x != y:
                break
            n += 1
        return n

    for r, name in enumerate(ranked):
        most = 0
        for step in (-1, 1):
            k, cap = r + step, len(name)
            while 0 <= k < len(ranked):
                n = common(name, ranked[k])
                cap = min(cap, n)
                if cap + 1 <= most:
                    break
                if n < len(name) and n < len(ranked[k]):  # not prefix-related
                    most = max(most, n + 1)
                    break
                k += step
        least = 3 if name.startswith(b"..") else 2 if name.startswith(b".") else 1
        out[order[r]] = name[: max(most, least)]
    return out


def abbreviations(entries: DataFrame, directory: str, name: str) -> DataFrame:
    """(directory, name, short) for the distinct names of each directory."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        names = batch["name"].tolist()
        return pd.DataFrame({"directory": batch["directory"], "name": names, "short": [x.decode(errors="surrogateescape") for x in abbreviate([n.encode() for n in names])]})

    rows = entries.select(F.col(directory).cast("string").alias("directory"), F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    return rows.groupBy("directory").applyInPandas(run, "directory string, name string, short string")


def flatten_splits(nodes: DataFrame, levels: Column | int) -> DataFrame:
    """(dir, name, oid): the leaves of split directories. nodes has (dir, level, node, name, child, oid); children of level
    0 are entries, those above are nodes of the level below. The depth is fixed per directory, so the joins are few."""
    at = nodes
    depth = levels if isinstance(levels, int) else nodes.agg(F.max("level")).first()[0] or 0
    out = None
    top = nodes.groupBy("dir").agg(F.max("level").alias("top"))
    frontier = at.join(top, "dir").where("level = top").select("dir", "level", "child", "name", "oid")
    for _ in range(depth + 1):
        leaves = frontier.where("level = 0").select("dir", "name", "oid")
        out = leaves if out is None else out.unionByName(leaves)
        inner = frontier.where("level > 0").select(F.col("dir").alias("d"), (F.col("level") - 1).alias("l"), F.col("child").alias("c"))
        frontier = inner.join(at, (F.col("d") == F.col("dir")) & (F.col("l") == F.col("level")) & (F.col("c") == F.col("node"))).select("dir", "level", "child", "name", "oid")
    return out


def feed_all(records: Iterator[bytes], bits: int = BITS) -> list[tuple[bool, int | None]]:
    splitter = RecordSplitter(bits)
    return [splitter.feed(r) for r in records]
