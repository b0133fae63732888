"""Stored trees as relations: directories from paths, listings, path resolution, sizes, metadata by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.functions.hashing import DIRECTORY, tree_ids
from stratalith.functions.scalars import human_size, mode_string, type_mark
from stratalith.storage import BROADCAST_ROWS, written

MOST_HOPS = 100


def directory_ids(files: DataFrame, content: bool = False) -> DataFrame:
    """(dir, oid, entries) of every directory over files (path, mode, oid), the root being ''; with `content` also the encoded
    entries. Bottom up, a group a depth: the number of rounds is the depth of the deepest path."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = files.select(parts.alias("p"), "mode", "oid").where("size(p) > 0")
    now = written(rows.select(F.size("p").alias("depth"), F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), "/").alias("dir"), F.element_at("p", -1).alias("name"), "mode", "oid"), "entries")
    deepest = now.agg(F.max("depth")).first()[0] or 0
    above, out = None, None
    for depth in range(deepest, 0, -1):
        level = now.where(F.col("depth") == depth).select("dir", "name", "mode", "oid")
        if above is not None:
            up = F.split("dir", "/")
            level = level.unionByName(above.select(F.array_join(F.slice(up, F.lit(1), F.size(up) - 1), "/").alias("dir"), F.element_at(up, -1).alias("name"), F.lit(DIRECTORY).alias("mode"), "oid"))
        above = written(tree_ids(level, ["dir"], content), "trees")
        out = above if out is None else out.unionByName(above)
    return out if out is not None else tree_ids(files.select(F.col("path").alias("dir"), F.col("path").alias("name"), "mode", "oid"), ["dir"], content)


def list_directory(entries: DataFrame, hidden: str = "none") -> DataFrame:
    """Entries without names that begin with a dot ('none'), with them ('almost'), or with '.' and '..' as well ('all')."""
    dots = entries["name"].isin(".", "..")
    shown = ~F.startswith(entries["name"], F.lit(".")) if hidden == "none" else ~dots if hidden == "almost" else F.lit(True)
    return entries.where(shown)


def long_line(human: bool = False, marks: bool = False) -> Column:
    """A row (mode, user, grp, size, mtime in seconds, name) in the manner of ls -l."""
    size = F.coalesce(human_size(F.col("size")) if human else F.col("size").cast("string"), F.lit("-"))
    owner = F.concat(F.coalesce("user", F.lit("?")), F.lit("/"), F.coalesce("grp", F.lit("?")))
    when = F.coalesce(F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm"), F.lit("-".join(["?" * 4, "??", "??"]) + " ??" + ":??"))
    pad = lambda c, n: F.rpad(c, F.greatest(F.length(c), F.lit(n)), F.lit(" "))
    name = F.concat("name", type_mark(F.col("mode"))) if marks else F.col("name")
    return F.concat_ws(" ", pad(mode_string(F.col("mode")), 10), pad(owner, 11), F.lpad(size, F.greatest(F.length(size), F.lit(11)), F.lit(" ")), F.lpad(when, 16, F.lit(" ")), name)


def resolve(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """(path, node, error) of each distinct path of requests: the node it leads to, following symbolic links, or ENOENT,
    ENOTDIR, or ELOOP after more than MOST_HOPS of them.

    entries: (parent, name, node, kind, target); the root's node is '/', kind is dir, link or file. A round takes one
    component of all paths at once; a link puts its target's components in front of the rest."""
    split = lambda c: F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))
    up = entries.where("kind = 'dir'").select(F.col("node").alias("__n"), F.col("parent").alias("__up"))
    step = entries.select(F.col("parent").alias("__p"), F.col("name").alias("__name"), F.col("node").alias("__to"), F.col("kind").alias("__kind"), F.col("target").alias("__target"))
    now = written(requests.select("path").distinct().select("path", F.lit("/").alias("node"), F.lit("dir").alias("kind"), split(F.col("path")).alias("rest"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("error")), "walk")
    done = now.where("size(rest) = 0")
    now = now.where("size(rest) > 0")
    while not now.isEmpty():
        first, tail = F.col("rest")[0], F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))
        j = now.join(up, now["node"] == F.col("__n"), "left").join(step, (F.col("node") == F.col("__p")) & (first == F.col("__name")), "left")
        back, link = first == "..", F.col("__kind") == "link"
        jump = link & F.startswith("__target", F.lit("/"))
        hops = F.col("hops") + F.when(~back & link, 1).otherwise(0)
        moved = j.select(
            "path",
            F.when(back, F.coalesce("__up", F.lit("/"))).when(jump, "/").when(link, F.col("node")).otherwise(F.col("__to")).alias("node"),
            F.when(back | link, "dir").otherwise(F.col("__kind")).alias("kind"),
            F.when(~back & link, F.concat(split(F.col("__target")), tail)).otherwise(tail).alias("rest"),
            hops.alias("hops"),
            F.when(F.col("kind") != "dir", "ENOTDIR").when(~back & F.col("__to").isNull(), "ENOENT").when(hops > MOST_HOPS, "ELOOP").alias("error"),
        )
        moved = written(moved, "walk")
        over = "size(rest) = 0 OR error IS NOT NULL"
        done, now = done.unionByName(moved.where(over)), moved.where(f"NOT ({over})")
    return done.select("path", F.when(F.col("error").isNull(), F.col("node")).alias("node"), "error")


def align_metadata(entries: DataFrame, metadata: DataFrame, order: str = "name", place: str = "pos") -> DataFrame:
    """entries (dir, ...) with the record of metadata (dir, pos, record) at the same place of its directory's order. A
    directory whose counts differ gets no records at all: `aligned` is false there."""
    e = entries.withColumn("__r", F.row_number().over(Window.partitionBy("dir").orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("dir")))
    m = metadata.select(F.col("dir").alias("__d"), "record", F.row_number().over(Window.partitionBy("dir").orderBy(place)).alias("__q"), F.count(F.lit(1)).over(Window.partitionBy("dir")).alias("__m"))
    j = e.join(m, (F.col("dir") == F.col("__d")) & (F.col("__r") == F.col("__q")), "left")
    fits = F.coalesce(F.col("__n") == F.col("__m"), F.lit(False))
    return j.select(*entries.columns, F.when(fits, F.col("record")).alias("record"), fits.alias("aligned"))


def map_owners(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """rows with column replaced where mapping (old, new) has it. The mapping is broadcast only if it is counted to be small."""
    m = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new")).dropDuplicates(["__old"])
    m = F.broadcast(m) if m.count() <= BROADCAST_ROWS else m
    return rows.join(m, rows[column].eqNullSafe(F.col("__old")), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def owner_names(rows: DataFrame, accounts: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the name of the account (id, name), empty where there is none."""
    a = accounts.select(F.col("id").alias("__id"), F.col("name").alias("__name")).dropDuplicates(["__id"])
    return rows.join(a, rows[column] == F.col("__id"), "left").withColumn(name, F.coalesce("__name", F.lit(""))).drop("__id", "__name")


def usage(files: DataFrame) -> DataFrame:
    """(dir, bytes, files) below every directory of paths."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return files.select(F.explode(above).alias("dir"), "size").groupBy("dir").agg(F.sum("size").cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


def compare_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, difference) of trees (path, oid, mode): only_left, only_right, content, mode."""
    a, b = left.alias("a"), right.alias("b")
    kind = F.when(F.col("b.path").isNull(), "only_left").when(F.col("a.path").isNull(), "only_right").when(~F.col("a.oid").eqNullSafe(F.col("b.oid")), "content").when(~F.col("a.mode").eqNullSafe(F.col("b.mode")), "mode")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), kind.alias("difference")).where("difference IS NOT NULL")


def metadata_counts(entries: DataFrame) -> DataFrame:
    """(dir, expected): records in a directory's metadata list, one for itself and one for each entry that is no directory."""
    return entries.groupBy("dir").agg((1 + F.count(F.when(F.col("mode").bitwiseAND(F.lit(0o170000)) != DIRECTORY, 1))).alias("expected"))


def directory_metadata(entries: DataFrame, name: str = "name") -> DataFrame:
    """(dir, records) of directories with a real record at least, from entries (dir, name, mode, record): the directory's own
    first (null here), then that of each entry that is no directory in order of names, null where it has none."""
    listed = F.col("mode").bitwiseAND(F.lit(0o170000)) != DIRECTORY
    rows = entries.groupBy("dir").agg(F.array_sort(F.collect_list(F.when(listed, F.struct(F.col(name).alias("name"), "record")))).alias("r"), F.count("record").alias("real"))
    records = F.concat(F.array(F.lit(None).cast(entries.schema["record"].dataType)), F.transform("r", lambda x: x["record"]))
    return rows.where("real > 0").select("dir", records.alias("records"))


def first_by_name(entries: DataFrame, by: str = "dir", name: str = "name", order: str = "pos") -> DataFrame:
    """entries with `duplicate`: whether an earlier one of the directory has the name; writers keep the others."""
    return entries.withColumn("duplicate", F.row_number().over(Window.partitionBy(by, name).orderBy(order)) > 1)


def root_collisions(paths: DataFrame, by: str, path: str = "path") -> DataFrame:
    """(by, roots) of the saves whose paths begin in several roots."""
    root = F.filter(F.split(path, "/"), lambda s: s != "")[0]
    return paths.groupBy(by).agg(F.count_distinct(root).alias("roots")).where("roots > 1")


def default_mode(stored_mode: Column, chunked: Column) -> Column:
    """The mode shown for an entry without metadata; null for a stored mode of another kind."""
    kind, executable = stored_mode.bitwiseAND(F.lit(0o170000)), stored_mode.bitwiseAND(F.lit(0o100)) != 0
    return F.when(kind == 0o100000, F.when(executable, 0o100755).otherwise(0o100644)).when(kind == DIRECTORY, F.when(chunked, 0o100644).otherwise(0o040755)).when(kind == 0o120000, 0o120755)


def glob_match(name: Column, pattern: str) -> Column:
    """Shell patterns over a whole name: * ? [..] [!..]."""
    import fnmatch

    return F.regexp_like(name, F.lit("^" + fnmatch.translate(pattern).replace("(?>", "(?:").replace(r"\z", r"$").replace(r"\Z", r"$")))


def path_kind(path: Column) -> Column:
    """What a path of the store's view names: root, tags, tag, saves of a branch, latest, one save, or something inside it."""
    clean = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    tagged = clean[0] == ".tag"
    return (
        F.when(F.size(clean) == 0, "root")
        .when(tagged & (F.size(clean) == 1), "tags")
        .when(tagged & (F.size(clean) == 2), "tag")
        .when(F.size(clean) == 1, "branch")
        .when(~tagged & (F.size(clean) == 2) & (clean[1] == "latest"), "latest")
        .when(~tagged & (F.size(clean) == 2), "save")
        .otherwise("inside")
    )


def edit_metadata(rows: DataFrame, values: dict[str, object], clear: tuple[str, ...] = ()) -> DataFrame:
    """rows with owner columns set to values, or cleared."""
    changed = {c: F.lit(v).cast(rows.schema[c].dataType) for c, v in values.items()}
    return rows.withColumns(changed | {c: F.lit(None).cast(rows.schema[c].dataType) for c in clear})


def graph_path(ref: Column, names: Column) -> Column:
    """'ref a/b/' or 'ref a/b': how a walk came to an object; names end in '/' where they are directories."""
    return F.concat(ref, F.lit(" "), F.array_join(names, ""))
