"""Scans: a directory tree as a Spark data source, text logs, and a seeded byte source."""

from __future__ import annotations

import grp
import json
import os
import pwd
import re
import stat
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stratalith.functions.codecs import METADATA, metadata_fields, metadata_record
from stratalith.functions.scalars import archive_path, extract_path

SCHEMA = (
    "path string, dev long, ino long, nlink long, mode int, uid long, gid long, size long, mtime long, ctime long, is_mount boolean, "
    "user string, grp string, rdev long, target string, xattrs map<string,binary>, error string"
)


class _Part(InputPartition):
    def __init__(self, path: str, walk: bool) -> None:
        self.path, self.walk = path, walk


def _account(number: int, group: bool) -> str | None:
    try:
        return grp.getgrgid(number).gr_name if group else pwd.getpwuid(number).pw_name
    except KeyError:
        return None


def _xattrs(path: str) -> dict[str, bytes]:
    try:
        return {n: os.getxattr(path, n, follow_symlinks=False) for n in os.listxattr(path, follow_symlinks=False)}
    except OSError:
        return {}


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].rstrip("/") or "/"
        self.one_device = options.get("xdev", "false").lower() == "true"
        lists = {k: json.loads(options.get(k, "[]")) for k in ("exclude", "exclude_rx", "xdev_exceptions")}
        self.exclude = {os.path.normpath(p) for p in lists["exclude"]}
        self.exclude_rx = [re.compile(x) for x in lists["exclude_rx"]]
        self.exceptions = {p.rstrip("/") for p in lists["xdev_exceptions"]}

    def partitions(self) -> list[InputPartition]:
        top = sorted(os.scandir(self.root), key=lambda e: e.name) if os.path.isdir(self.root) else []
        return [_Part(self.root, False), *(_Part(e.path, True) for e in top)]

    def read(self, part: _Part) -> Iterator[tuple]:
        device = os.lstat(self.root).st_dev
        accounts: dict[tuple[int, bool], str | None] = {}

        def account(number: int, group: bool) -> str | None:
            if (number, group) not in accounts:
                accounts[number, group] = _account(number, group)
            return accounts[number, group]

        def rows(path: str, walk: bool) -> Iterator[tuple]:
            try:
                st = os.lstat(path)
            except OSError:  # gone since it was listed
                return
            is_dir, error, target = stat.S_ISDIR(st.st_mode), None, None
            shown = path.rstrip("/") + "/" if is_dir else path
            if path != self.root and (os.path.normpath(path) in self.exclude or any(x.search(shown) for x in self.exclude_rx)):
                return
            if is_dir and walk and not (self.one_device and st.st_dev != device and path not in self.exceptions):
                try:
                    below = sorted(os.listdir(path), reverse=True)
                except OSError as e:  # it is shown, with what was wrong, and the scan goes on
                    below, error = [], str(e)
                for name in below:
                    yield from rows(f"{path}/{name}", True)
            if stat.S_ISLNK(st.st_mode):
                try:
                    target = os.readlink(path)
                except OSError as e:
                    error = str(e)
            size = 0 if is_dir else st.st_size
            yield (shown, st.st_dev, st.st_ino, st.st_nlink, st.st_mode, st.st_uid, st.st_gid, size, st.st_mtime_ns, st.st_ctime_ns, is_dir and st.st_dev != device,
                   account(st.st_uid, False), account(st.st_gid, True), st.st_rdev, target, _xattrs(path), error)

        yield from rows(part.path, part.walk)


class TreeSource(DataSource):
    """spark.read.format("filetree").load(folder): a row a file, a task an entry of the top folder; option xdev stays on one device."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(dict(self.options))


def scan_tree(spark: SparkSession, folder: str, one_device: bool = False, exclude: Sequence[str] = (), exclude_rx: Sequence[str] = (), xdev_exceptions: Sequence[str] = ()) -> DataFrame:
    """(path, dev, ino, ...) of everything below folder; names of directories end in '/'.

    exclude: paths that are left out with what lies below; exclude_rx: patterns, found anywhere in a path, that do the same;
    xdev_exceptions: mount points that one_device enters all the same. A directory that cannot be read has `error`."""
    spark.dataSource.register(TreeSource)
    options = {k: json.dumps(list(v)) for k, v in (("exclude", exclude), ("exclude_rx", exclude_rx), ("xdev_exceptions", xdev_exceptions))}
    return spark.read.format("filetree").option("xdev", str(one_device).lower()).options(**options).load(folder)


HOLE = 512


def write_sparsely(file: BinaryIO, content: bytes) -> None:
    """Writes content with holes for runs of at least HOLE zeros, by blocks of so many bytes."""
    data = np.frombuffer(content, dtype=np.uint8)
    whole = len(data) // HOLE
    zero = ~data[: whole * HOLE].reshape(whole, HOLE).any(axis=1)
    edges = np.r_[0, np.flatnonzero(zero[1:] != zero[:-1]) + 1, whole] if whole else np.zeros(1, dtype=np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if zero[a]:
            file.seek((b - a) * HOLE, os.SEEK_CUR)
        else:
            file.write(content[a * HOLE : b * HOLE])
    file.write(content[whole * HOLE :])
    file.truncate(len(content))


def file_writer(target: str, sparse: bool, owners: Mapping[int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas: writes rows (path, mode, mtime in nanoseconds, content) below target, and returns (path, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                place = os.path.join(target, r.path.lstrip("/"))
                if ".." in r.path.split("/"):
                    raise ValueError(f"{r.path} leads out of the target folder")
                os.makedirs(os.path.dirname(place), exist_ok=True)
                fresh = f"{place}.{uuid.uuid4().hex}.part"
                with open(fresh, "wb") as file:
                    if sparse:
                        write_sparsely(file, bytes(r.content))
                    else:
                        file.write(bytes(r.content))
                os.chmod(fresh, int(r.mode) & 0o7777)
                if owners and (uid := owners.get(os.stat(fresh).st_uid)) is not None:
                    os.chown(fresh, uid, -1)
                os.utime(fresh, ns=(int(r.mtime), int(r.mtime)))
                os.replace(fresh, place)
            yield pd.DataFrame({"path": rows["path"], "bytes": rows["content"].map(len)})

    return run


def file_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, length) of the files below folder; empty ones, which the binary source skips, come from the listing."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content", "length")
    nothing = scan_tree(spark, folder).where((F.col("size") == 0) & (F.col("mode").bitwiseAND(F.lit(0o170000)) == 0o100000))
    return found.unionByName(nothing.select("path", F.lit(b"").alias("content"), F.lit(0).cast("long").alias("length")))


def backup_times(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, utc) of the full and incremental sets that a collection log names, as in 'full 20240131T235959Z ...'."""
    found = F.regexp_extract(column, r"^\s*(full|inc)\s+(\d{8}T\d{6}Z)", 1)
    stamp = F.regexp_extract(column, r"^\s*(full|inc)\s+(\d{8}T\d{6}Z)", 2)
    return lines.where(found != "").select(found.alias("kind"), F.unix_seconds(F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'"))).alias("utc"))


def increment_times(lines: DataFrame, column: str = "value") -> DataFrame:
    """(utc, kind) of a parsable list of increments: seconds and the kind of file on each line; other lines are left out."""
    pattern = r"^\s*(\d+)\s+(\S+)\s*$"
    rows = lines.select(F.regexp_extract(column, pattern, 1).try_cast("long").alias("utc"), F.regexp_extract(column, pattern, 2).alias("kind"))
    return rows.where("utc IS NOT NULL")


def archive_metadata(rows: DataFrame) -> DataFrame:
    """(path, record) of scanned rows (as scan_tree gives): each path made relative, and its metadata as one encoded record."""
    clean = archive_path(F.col("path"))
    have = set(rows.columns)
    names = {"mode": "mode", "uid": "uid", "user": "user", "gid": "gid", "grp": "grp", "rdev": "rdev", "mtime": "mtime", "ctime": "ctime", "size": "size", "symlink": "target"}
    fields = [clean.alias("path"), *((F.col(c).cast("long") if METADATA[n].dataType.simpleString() == "bigint" else F.col(c)).alias(n) for n, c in names.items() if c in have)]
    return rows.select(clean.alias("path"), metadata_record(F.struct(*fields)).alias("record"))


def read_metadata(archive: DataFrame, strict: bool = True) -> DataFrame:
    """(path, and the fields of METADATA) of an archive's records; path is where to extract it. One that would leave the target folder
    is an error, or with strict false is left out."""
    rows = archive.select(metadata_fields("record").alias("m")).select("m.*")
    place = extract_path(F.col("path"))
    if strict:
        place = F.coalesce(place, F.raise_error(F.concat(F.lit("path leads out of the target: "), "path")).cast("string"))
    return rows.withColumn("path", place).where("path IS NOT NULL")


def snapshot_times(folders: DataFrame, path: str = "path") -> DataFrame:
    """(snapshot, branch, utc): one save for each pair of snapshot and branch folder '<snapshot>/<branch>/', dated by its ctime."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return folders.where(F.size(parts) == 2).groupBy(parts[0].alias("snapshot"), parts[1].alias("branch")).agg(F.max("ctime").alias("utc"))


def random_bytes(spark: SparkSession, size: int, seed: int = 0, block: int = 1 << 20) -> DataFrame:
    """(block, content): `size` bytes that depend on seed alone; each block is a counter-based stream of its own."""

    def run(batches):
        import pandas as pd

        for ids in batches:
            numbers = ids["id"].tolist()
            yield pd.DataFrame({"block": numbers, "content": [np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, n])).bytes(min(block, size - n * block)) for n in numbers]})

    return spark.range(-(-size // block)).mapInPandas(run, "block long, content binary")
