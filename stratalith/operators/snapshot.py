"""Comparing listings of files: what is new, stale or gone, hard links, precedence of merged listings, path predicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.storage import BROADCAST_ROWS

EMPTY_ID = "0" * 40
#: What else two restored paths have in common if they can be one file; columns that a table lacks are not compared.
_SAME_FILE = ("uid", "gid", "user", "group", "rdev", "size", "posix1e_acl", "linux_attr", "linux_xattr")
_COMPARED = ("size", "mtime", "ctime", "ino", "nlink")


def stale(old: str = "o", new: str = "n", check_device: bool = True) -> Column:
    """Whether the indexed row no longer describes the file. Both sides have size, mtime, ctime, ino, nlink, dev; the old one
    also oid, gitmode and present."""
    c = lambda side, name: F.col(f"{side}.{name}")
    out = ~c(old, "present") | (c(old, "oid") == EMPTY_ID) | (c(old, "gitmode") == 0)
    for name in (*_COMPARED, *(("dev",) if check_device else ())):
        out = out | ~c(old, name).eqNullSafe(c(new, name))
    return out


def compare_snapshots(old: DataFrame, new: DataFrame, key: str = "name", check_device: bool = True) -> DataFrame:
    """(name, status): 'new', 'stale', 'deleted' or 'same', from one full outer join."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    status = F.when(F.col(f"o.{key}").isNull(), "new").when(F.col(f"n.{key}").isNull(), "deleted").when(stale(check_device=check_device), "stale").otherwise("same")
    return joined.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), status.alias("status"))


def status_letter(present: Column, valid: Column, oid: Column) -> Column:
    """A for added, M for modified, D for deleted, blank for what is up to date."""
    return F.when(~present, "D").when(~valid & (oid == EMPTY_ID), "A").when(~valid, "M").otherwise(" ")


def clamp_times(rows: DataFrame, most: Column, columns: Sequence[str] = ("mtime", "ctime")) -> DataFrame:
    """rows with times at most `most`, so that what is edited while it is read looks stale the next time."""
    return rows.withColumns({c: F.least(F.col(c), most) for c in columns})


def hardlink_groups(files: DataFrame) -> DataFrame:
    """(dev, ino, links, first): the paths that share an inode, where there are several."""
    return files.groupBy("dev", "ino").agg(F.count(F.lit(1)).alias("links"), F.min("path").alias("first")).where("links > 1")


def hardlink_targets(files: DataFrame) -> DataFrame:
    """(path, target): the first path of the inode, for files with nlink > 1 that are not directories and not that path."""
    linked = files.where((F.col("nlink") > 1) & (F.col("mode").bitwiseAND(F.lit(0o170000)) != 0o040000))
    return linked.select("path", F.min("path").over(Window.partitionBy("dev", "ino")).alias("target")).where("path <> target")


def restore_links(files: DataFrame) -> DataFrame:
    """(path, link_to): restored paths that become links to an earlier path of the same target, content, times and mode, and the same
    (or both null) owner, device, size, ACLs, attributes and xattrs, of those that files has: see _SAME_FILE."""
    alike = Window.partitionBy("target", "oid", "mtime", "ctime", "mode", *(c for c in _SAME_FILE if c in files.columns)).orderBy("path")
    return files.where("target IS NOT NULL").select("path", F.first("path").over(alike).alias("link_to")).where("path <> link_to")


def merge_listings(*listings: DataFrame) -> DataFrame:
    """One row of each name: rows that are not valid before valid ones, real before made up (ctime 0), earlier listings before later."""
    every = None
    for i, x in enumerate(listings):
        x = x.withColumn("__from", F.lit(i))
        every = x if every is None else every.unionByName(x)
    order = Window.partitionBy("name").orderBy(F.col("valid").cast("int"), (F.col("ctime") == 0).cast("int"), "__from")
    return every.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__from")


def invalidate_parents(rows: DataFrame, name: str = "name") -> DataFrame:
    """(name, valid): a directory (its name ends in '/') stays valid only while all below it is. Each invalid row names its
    ancestors, so that is a group and a join on equality, not on prefixes."""
    parts = F.split(F.rtrim(F.col(name), F.lit("/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    broken = rows.where("NOT valid").select(F.explode(above).alias("__dir")).distinct()
    return rows.join(broken, F.col(name) == F.col("__dir"), "left").select(name, (F.col("valid") & F.col("__dir").isNull()).alias("valid"))


def metadata_offsets(rows: DataFrame, encoded: str) -> DataFrame:
    """(encoded, ofs): where each distinct encoded record lies in a store that appends them in order; sizes are summed by the
    first two bytes of their hash first, so the only global sum is over few rows."""
    distinct = rows.select(encoded).where(F.col(encoded).isNotNull()).distinct().withColumn("h", F.md5(encoded))
    cell = F.substring("h", 1, 3)
    placed = distinct.withColumn("cell", cell).withColumn("n", F.octet_length(encoded).cast("long"))
    total = placed.groupBy("cell").agg(F.sum("n").alias("t"))
    before = total.select("cell", (F.sum("t").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("cell").orderBy("h", encoded).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return placed.withColumn("inside", inside).join(before, "cell").select(encoded, (F.col("before") + F.col("inside")).alias("ofs"))


def reduce_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path) without those equal to or below another (a directory ends in '/'): each path looks for its own ancestors."""
    distinct = paths.select(F.col(path).alias("p")).where("p IS NOT NULL").distinct()
    pieces = F.regexp_extract_all("p", F.lit(r"([^/]*/|[^/]+$)"), 1)
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), ""))
    wanted = distinct.select("p", F.explode(above).alias("q")).where("q <> p AND endswith(q, '/')")
    hidden = wanted.join(distinct.select(F.col("p").alias("q")), "q", "left_semi").select("p").distinct()
    return distinct.join(hidden, "p", "left_anti").select(F.col("p").alias(path))


def exclude_paths(paths: DataFrame, excluded: DataFrame, path: str = "path") -> DataFrame:
    """Rows of paths that are neither among excluded (path) nor below one."""
    keyed = paths.withColumn("__p", F.rtrim(F.col(path), F.lit("/")))
    parts = F.split("__p", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    gone = excluded.select(F.rtrim("path", F.lit("/")).alias("__q")).distinct()
    few = gone.count() <= BROADCAST_ROWS
    hit = keyed.select("__p", F.explode(above).alias("__q")).join(F.broadcast(gone) if few else gone, "__q", "left_semi").select("__p").distinct()
    return keyed.join(hit, "__p", "left_anti").drop("__p")


def _finds(pattern: str) -> Callable[[Column], Column]:
    return lambda q: F.regexp_like(q, F.lit(pattern))


def exclude_patterns(paths: DataFrame, patterns: Sequence[str], path: str = "path") -> DataFrame:
    """Rows of paths that no pattern is found in, and that do not lie below a directory that one is found in."""
    pieces = F.regexp_extract_all(path, F.lit(r"([^/]*/|[^/]+$)"), 1)
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), ""))
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.exists(above, _finds(p))
    return paths.where(~hit)


def filter_prefixes(rows: DataFrame, prefixes: DataFrame, name: str = "name") -> DataFrame:
    """(prefix, name): rows under each prefix, the prefix itself included even where no row has it."""
    pieces = F.regexp_extract_all(name, F.lit(r"([^/]*/|[^/]+$)"), 1)
    above = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), ""))
    under = rows.select(name, F.explode(above).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix").select("prefix", name)
    return under.unionByName(prefixes.select("prefix", F.col("prefix").alias(name))).distinct()


def same_device(rows: DataFrame, root_dev: Column) -> DataFrame:
    """Rows on the root's device, and mount points."""
    return rows.where((F.col("dev") == root_dev) | F.col("is_mount"))


def order_violations(rows: DataFrame, order: str, name: str = "name") -> DataFrame:
    """Rows whose name is not less than the one before them, in each listing (a listing descends)."""
    return rows.withColumn("prev", F.lag(name).over(Window.partitionBy("listing").orderBy(order))).where(F.col(name) >= F.col("prev"))


def save_totals(rows: DataFrame) -> DataFrame:
    """(bytes, files, todo_bytes, todo_files): what a save reads through and what it has to store; rows: size, valid, is_dir."""
    file, todo = ~F.col("is_dir"), ~F.col("is_dir") & ~F.col("valid")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).cast("long")
    return rows.agg(total(file).alias("bytes"), F.count_if(file).alias("files"), total(todo).alias("todo_bytes"), F.count_if(todo).alias("todo_files"))


def already_saved(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """rows with `saved`: valid, and the object is stored."""
    known = objects.select(F.col("oid").alias("__oid")).distinct()
    return rows.join(known, rows["oid"] == F.col("__oid"), "left").withColumn("saved", F.col("valid") & F.col("__oid").isNotNull()).drop("__oid")
