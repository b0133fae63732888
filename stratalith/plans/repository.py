"""A store of saves as Parquet tables: objects once each, links between them, listings of saves, and versioned references."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions.hashing import DIRECTORY, object_id, tree_ids
from stratalith.functions.scalars import commit_text, mark_name
from stratalith.operators import chunking, graph, history, membership, snapshot, vfs
from stratalith.sources.files import file_writer
from stratalith.storage import written

_OBJECTS = "oid string, kind string, size long, content binary, pack string"
_LINKS = "src string, dst string"
_FILES = "save string, path string, mode int, oid string, size long, mtime long"
_CHUNKS = "root string, seq int, ofs long, len int, oid string"
_SAVES = "oid string, branch string, parent string, tree string, utc long, message string, author string"
_CONFIG = "name string, value string"
_REFS = "name string, oid string"
_MEMO = "src string, bits int, dst string"
_SCHEMAS = {"objects": _OBJECTS, "links": _LINKS, "files": _FILES, "chunks": _CHUNKS, "saves": _SAVES, "refs": _REFS, "config": _CONFIG, "memo": _MEMO}
NOBODY = "nobody <nobody@localhost>"
METHODS = ("ff", "replace", "new-tag", "pick", "force-pick", "append", "unnamed")


class Repository:
    """folder is a path that all executors reach. Tables only grow, but for what is replaced: then new versions are written
    beside the old ones, and one small file, the next generation, names the versions that count from then on. Generations
    are numbered, and only one writer can make the next one, so a replacement of several tables happens at once or not
    at all, and a reference changes only if it still has the expected value."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- tables

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.folder}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def generation(self) -> tuple[int, dict[str, int]]:
        """Number of the newest generation, and the version of each table that it names."""
        made = [n for n in self._names("generations") if n.endswith(".json")]
        if not made:
            return 0, {}
        fs, p = self._fs(f"{self.folder}/generations/{made[-1]}")
        stream = fs.open(p)
        try:
            return int(made[-1].removesuffix(".json")), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, versions: Mapping[str, int]) -> None:
        """Makes generation `number`, unless another writer has begun to."""
        fs, claim = self._fs(f"{self.folder}/generations/{number:09d}.claim")
        fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim):
            raise ValueError(f"another writer makes generation {number}; unlock() removes the claim of one that died")
        _, fresh = self._fs(f"{self.folder}/generations/.{number:09d}.tmp")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(dict(versions)).encode()))
        out.close()
        fs.rename(fresh, self._fs(f"{self.folder}/generations/{number:09d}.json")[1])

    def unlock(self) -> None:
        """Removes claims on generations that were never made."""
        names = self._names("generations")
        for name in names:
            if name.endswith(".claim") and name.replace(".claim", ".json") not in names:
                fs, p = self._fs(f"{self.folder}/generations/{name}")
                fs.delete(p, False)

    def table(self, name: str) -> DataFrame:
        """objects, links, files, chunks, saves, refs, config or memo, as of the newest generation."""
        path = f"{self.folder}/{name}/v{self.generation()[1].get(name, 0)}"
        fs, p = self._fs(path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(path)

    def _append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split(" ")[0] for c in _SCHEMAS[name].split(", ")]
        rows.select(*columns).write.mode("append").parquet(f"{self.folder}/{name}/v{self.generation()[1].get(name, 0)}")

    def _replace(self, **tables: DataFrame) -> None:
        """Writes new versions of tables and makes the generation that names them."""
        number, versions = self.generation()
        self._replace_at(number, versions, tables)

    def _replace_at(self, number: int, versions: Mapping[str, int], tables: Mapping[str, DataFrame]) -> None:
        made = {}
        for name, rows in tables.items():
            made[name] = max([versions.get(name, 0), *(int(v[1:]) for v in self._names(name))]) + 1
            rows.write.parquet(f"{self.folder}/{name}/v{made[name]}")
        self._publish(number + 1, {**versions, **made})

    # -- set-up

    def init(self, **config: str) -> str:
        """Creates the repository, or completes an old one; returns its random id. config are further settings."""
        have = {r["name"]: r["value"] for r in self.table("config").collect()}  # a few settings
        wanted = {"id": have.get("id") or f"{secrets.token_hex(16)}", **have, **config}
        if wanted != have:
            self._replace(config=self.spark.createDataFrame(sorted(wanted.items()), _CONFIG).coalesce(1))
        return wanted["id"]

    def config(self, name: str, default: str | None = None) -> str | None:
        row = self.table("config").where(F.col("name") == name).first()
        return row["value"] if row else default

    # -- references

    def ref(self, name: str) -> str | None:
        row = self.table("refs").where(F.col("name") == name).first()
        return row["oid"] if row else None

    def update_ref(self, name: str, new: str | None, expected: str | None, since: Mapping[str, int] | None = None) -> None:
        """Sets (or with None deletes) a reference that has the expected value. The check and the change belong to one
        generation: if another writer makes it first, this one fails. since: versions of tables that were written to, which
        must still be the ones that count."""
        number, versions = self.generation()
        if since is not None and any(versions.get(t, 0) != since.get(t, 0) for t in ("objects", "links", "files", "chunks", "saves")):
            raise ValueError("tables were replaced while they were written to")
        if self.ref(name) != expected:
            raise ValueError(f"{name} is not {expected} any more")
        rows = self.table("refs").where(F.col("name") != name)
        if new is not None:
            rows = rows.unionByName(self.spark.createDataFrame([(name, new)], _REFS))
        self._replace_at(number, versions, {"refs": rows.coalesce(1)})

    def refs(self, prefix: str = "refs/") -> DataFrame:
        """(name, oid) of the references below prefix."""
        return self.table("refs").where(F.startswith("name", F.lit(prefix)))

    def resolve(self, names: DataFrame) -> DataFrame:
        """(name, oid) of names (name): a branch's tip, otherwise the stored object of that id, null where there is neither."""
        return history.resolve_names(names, self.refs("refs/heads/"), self.table("objects"))

    def fetch(self, ids: DataFrame) -> DataFrame:
        """(oid, kind, size, content) of every id of ids (oid), all in one join; nulls where it is not stored."""
        return ids.select("oid").distinct().join(self.table("objects").select("oid", "kind", "size", "content"), "oid", "left")

    def fetch_ref(self, name: str) -> DataFrame:
        """fetch() of what a reference points to."""
        return self.fetch(self.table("refs").where(F.col("name") == name).select("oid"))

    def tag(self, name: str, oid: str, force: bool = False) -> None:
        """Names a stored object; only with force a name that is taken."""
        if not name or name.startswith("."):
            raise ValueError(f"{name!r} is not a name for a tag")
        if self.table("objects").where(F.col("oid") == oid).isEmpty():
            raise ValueError(f"{oid} is not stored")
        now = self.ref(f"refs/tags/{name}")
        if now is not None and not force:
            raise ValueError(f"tag {name} exists")
        self.update_ref(f"refs/tags/{name}", oid, now)

    def delete_tag(self, name: str, force: bool = False) -> None:
        """Removes a tag; with force it need not exist."""
        now = self.ref(f"refs/tags/{name}")
        if now is not None:
            self.update_ref(f"refs/tags/{name}", None, now)
        elif not force:
            raise ValueError(f"tag {name} does not exist")

    # -- save and restore

    def save(self, branch: str, files: DataFrame, utc: int, message: str = "", author: str = NOBODY, bits: int = chunking.BITS) -> str:
        """Stores files (path, mode, mtime, content) as a save on top of branch; returns its id. Only chunks, trees and
        commits that are not stored yet are written."""
        spark, ref = self.spark, f"refs/heads/{branch}"
        _, since = self.generation()
        parent = self.ref(ref)
        rows = written(files.select("path", "mode", "mtime", "content").withColumn("id", F.monotonically_increasing_id()), "incoming")
        content = F.coalesce(F.col("content"), F.lit(b""))
        roots = written(chunking.file_roots(rows, "id", content, bits).withColumnRenamed("mode", "stored"), "roots")
        cut = written(chunking.chunks(rows, "id", content, bits), "cut")
        pack = f"{branch}-{utc}"
        pieces = cut.join(rows.select("id", content.alias("content")), "id").select("oid", chunking.cut_out(F.col("content")).alias("content")).dropDuplicates(["oid"])
        nodes = written(chunking.file_nodes(rows, "id", content, bits), "nodes")
        pieces = pieces.unionByName(roots.where("chunks = 0").select("oid", F.lit(b"").alias("content")).distinct())
        blobs = pieces.select("oid", F.lit("blob").alias("kind"), F.octet_length("content").cast("long").alias("size"), "content")

        named = rows.drop("content").join(roots, "id")
        parts = F.filter(F.split("path", "/"), lambda s: s != "")
        stored_path = F.concat_ws("/", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), mark_name(F.element_at(parts, -1), F.col("mode"), F.col("stored")))
        stored_mode = F.when(F.col("stored") == DIRECTORY, DIRECTORY).when(F.col("mode").bitwiseAND(F.lit(0o111)) != 0, 0o100755).otherwise(0o100644)
        entries = written(named.select(stored_path.alias("path"), stored_mode.alias("mode"), "oid"), "entries")
        trees = written(vfs.directory_ids(entries, content=True), "dirs")
        tops = trees.where("dir = ''").select("oid").collect()
        tree = tops[0]["oid"] if tops else "4b825dc642cb6eb9a060e54bf8d69288fbee4904"  # the empty tree

        up = lambda c: F.regexp_replace(F.ltrim(c, F.lit("/")), r"/?[^/]*$", "")
        of_dir = trees.select(F.col("dir").alias("__dir"), F.col("oid").alias("src"))
        links = entries.select(up(F.col("path")).alias("__dir"), F.col("oid").alias("dst")).join(of_dir, "__dir").select("src", "dst")
        links = links.unionByName(trees.where("dir <> ''").select(up(F.col("dir")).alias("__dir"), F.col("oid").alias("dst")).join(of_dir, "__dir").select("src", "dst"))
        links = links.unionByName(nodes.select(F.col("tree").alias("src"), F.col("oid").alias("dst")))

        who = F.lit(author)
        one = spark.range(1).select(commit_text(F.lit(tree), F.lit(parent).cast("string"), who, F.lit(utc), F.lit(0), who, F.lit(utc), F.lit(0), F.lit(message)).alias("t"))
        made = one.select("t", object_id(F.encode("t", "UTF-8"), "commit").alias("oid")).first()
        oid = made["oid"]
        commits = spark.createDataFrame([(oid, "commit", len(made["t"].encode()), bytearray(made["t"].encode()))], "oid string, kind string, size long, content binary")
        links = links.unionByName(spark.createDataFrame([(oid, tree), *([(oid, parent)] if parent else [])], _LINKS))
        inner = trees.select("oid", "content").unionByName(tree_ids(nodes.select("id", "tree", "mode", "name", "oid"), ["id", "tree"], content=True).select("oid", "content"))
        inner = inner.dropDuplicates(["oid"]).select("oid", F.lit("tree").alias("kind"), F.octet_length("content").cast("long").alias("size"), "content")
        fresh = blobs.unionByName(inner).unionByName(commits).dropDuplicates(["oid"]).join(self.table("objects").select("oid"), "oid", "left_anti")
        self._append("objects", written(fresh.withColumn("pack", F.lit(pack)), "fresh"))
        known = self.table("links")
        self._append("links", written(links.distinct().join(known, ["src", "dst"], "left_anti"), "links"))
        shared = cut.join(roots.select("id", F.col("oid").alias("root")), "id").select("root", "seq", "ofs", "len", "oid").distinct()
        self._append("chunks", written(shared.join(self.table("chunks").select("root").distinct(), "root", "left_anti"), "chunks"))
        self._append("files", named.select(F.lit(oid).alias("save"), "path", F.col("mode").cast("int").alias("mode"), "oid", "size", F.col("mtime").cast("long").alias("mtime")))
        self._append("saves", spark.createDataFrame([(oid, branch, parent, tree, utc, message, author)], _SAVES))
        self.update_ref(ref, oid, parent, since)
        return oid

    def restore(self, save: str) -> DataFrame:
        """(path, mode, mtime, content) of a save."""
        files = self.table("files").where(F.col("save") == save)
        parts = self.table("chunks").join(files.select(F.col("oid").alias("root")).distinct(), "root").join(self.table("objects").select("oid", F.col("content").alias("part")), "oid")
        whole = chunking.join_chunks(parts, "root")
        return files.join(whole, files["oid"] == whole["root"], "left").select("path", "mode", "mtime", F.coalesce("content", F.lit(b"")).alias("content"))

    def restore_to(self, save: str, target: str, sparse: bool = False, owners: Mapping[int, int] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
        """Writes a save's files below target, a folder that all executors reach by this path; returns (path, bytes), a row a file.

        exclude: patterns of paths to leave out, as in snapshot.exclude_patterns. Files are written beside their place and
        moved there, so a task that runs again does no harm. sparse leaves holes for zeros; owners, if given, maps stored user
        ids (column uid of files, where there is one) to those to set. Modes and times are set on files."""
        rows = self.restore(save)
        rows = snapshot.exclude_patterns(rows, exclude) if exclude else rows
        return rows.select("path", "mode", "mtime", "content").mapInPandas(file_writer(target, sparse, dict(owners or {})), "path string, bytes long")

    def log(self, branch: str) -> DataFrame:
        """(tip, oid, utc, place, depth) of a branch, newest first."""
        tips = self.table("refs").where(F.col("name") == f"refs/heads/{branch}").select("oid")
        return history.rev_list(self.table("saves").select("oid", "parent", "utc"), tips)

    # -- upkeep

    def _live(self) -> DataFrame:
        return graph.reachable(self.table("links"), self.table("refs").select(F.col("oid").alias("node")))

    def fsck(self) -> DataFrame:
        """(oid, problem): blobs, trees and commits whose content does not hash to their id, and objects that are reached but missing."""
        objects = self.table("objects")
        found = F.when(F.col("kind") == "commit", object_id(F.col("content"), "commit")).when(F.col("kind") == "tree", object_id(F.col("content"), "tree")).otherwise(object_id(F.col("content")))
        broken = objects.where("content IS NOT NULL").where(found != F.col("oid"))
        lost = self._live().join(objects.select(F.col("oid").alias("node")), "node", "left_anti")
        return broken.select("oid", F.lit("content").alias("problem")).unionByName(lost.select(F.col("node").alias("oid"), F.lit("missing").alias("problem")))

    def remove_branch(self, branch: str) -> None:
        self.update_ref(f"refs/heads/{branch}", None, self.ref(f"refs/heads/{branch}"))

    def remove_saves(self, branch: str, drop: set[str]) -> str | None:
        """Writes the branch anew without the named saves; from the first one dropped on, saves get new ids. Returns the tip."""
        ref, (_, since) = f"refs/heads/{branch}", self.generation()
        tip = self.ref(ref)
        kept = self._history(self, tip)
        first = next((i for i, s in enumerate(kept) if s["oid"] in drop), len(kept))
        parent = kept[first - 1]["oid"] if first else None
        parent = self._recommit([s for s in kept[first:] if s["oid"] not in drop], parent, branch)
        self.update_ref(ref, parent, tip, since)
        return parent

    def _history(self, source: Repository, oid: str | None, depth: int | None = None) -> list:
        """Rows of saves that oid stands on, the oldest first: a history's rows, without its files."""
        if oid is None:
            return []
        order = history.rev_list(source.table("saves").select("oid", "parent", "utc"), self.spark.createDataFrame([(oid,)], "oid string"))
        order = order if depth is None else order.where(F.col("depth") <= depth)
        return source.table("saves").join(order.select("oid", "depth"), "oid").dropDuplicates(["oid"]).orderBy(F.desc("depth")).collect()

    def _recommit(self, saves: Sequence, parent: str | None, branch: str) -> str | None:
        """Commits for the trees of saves on top of parent, one on the other, with their authors, times and messages; returns the
        last one's id. Ids depend on each other and are made here; whatever is stored is written at once."""
        made = []
        for s in saves:
            author = s["author"] or NOBODY
            lines = [f"tree {s['tree']}", *([f"parent {parent}"] if parent else []), f"author {author} {s['utc']} +0000", f"committer {NOBODY} {s['utc']} +0000", "", s["message"]]
            raw = "\n".join(lines).encode()
            oid = hashlib.sha1(b"commit %d\0" % len(raw) + raw).hexdigest()
            made.append((oid, parent, raw, s))
            parent = oid
        if not made:
            return parent
        new = self.spark.createDataFrame([(o, "commit", len(raw), bytearray(raw), f"{branch}-rewritten", b, s["tree"], s["utc"], s["message"], s["author"], s["oid"]) for o, b, raw, s in made], f"{_OBJECTS}, parent string, tree string, utc long, message string, author string, old string")
        new = written(new.withColumn("branch", F.lit(branch)), "commits")
        fresh = written(new.join(self.table("objects").select("oid"), "oid", "left_anti"), "commits")
        self._append("objects", fresh)
        to = F.explode(F.array_compact(F.array("tree", "parent")))
        self._append("links", fresh.select(F.col("oid").alias("src"), to.alias("dst")))
        unsaved = written(new.join(self.table("saves").where(F.col("branch") == branch).select("oid"), "oid", "left_anti"), "commits")
        self._append("saves", unsaved)
        of = unsaved.select(F.col("oid").alias("new"), F.col("old").alias("save"))
        self._append("files", written(self.table("files").join(F.broadcast(of), "save").drop("save").withColumnRenamed("new", "save"), "files"))  # a history's few ids
        return parent

    def prune(self, branch: str, now: int, keep: Mapping[str, float]) -> list[str]:
        """Drops the saves that history.classify_saves does not keep; returns their ids."""
        rows = self.log(branch).select("oid", "utc", F.lit(branch).alias("branch"), F.col("oid").alias("id"))
        drop = [r["oid"] for r in history.classify_saves(rows, now, keep).where("NOT keep").select("oid").collect()]
        if drop:
            self.remove_saves(branch, set(drop))
        return drop

    def gc(self, threshold: int = 10) -> DataFrame:
        """Writes versions of the tables without dead objects, which one generation puts in place of the old ones; packs that the plan
        keeps stay whole. Returns the plan."""
        live = written(self._live(), "live")
        objects = self.table("objects")
        plan = written(graph.sweep_plan(objects.select("pack", F.col("oid").alias("node"), "kind"), live, threshold), "plan")
        kept = objects.join(plan.where("decision = 'keep'").select("pack"), "pack", "left_semi")
        rest = objects.join(plan.where("decision = 'rewrite'").select("pack"), "pack", "left_semi").join(live.select(F.col("node").alias("oid")), "oid", "left_semi")
        here = written(kept.unionByName(rest).select("oid"), "here")
        links, files, chunks, saves = (self.table(t) for t in ("links", "files", "chunks", "saves"))
        self._replace(
            objects=kept.unionByName(rest),
            links=links.join(here.select(F.col("oid").alias("src")), "src", "left_semi").select("src", "dst"),
            saves=saves.join(live.select(F.col("node").alias("oid")), "oid", "left_semi"),
            files=files.join(live.select(F.col("node").alias("save")), "save", "left_semi").select(*files.columns),
            chunks=chunks.join(here, "oid", "left_semi").select(*chunks.columns),
        )
        return plan

    def rewrite(self, source: Repository, src: str, branch: str, bits: int = chunking.BITS) -> str | None:
        """Saves the history of source's branch src anew, cut with other bits; a file of which a part is missing becomes a
        note that says so. A save that was rewritten so before, onto the same parent, is taken from the memo. Returns the tip."""
        tip = self.ref(f"refs/heads/{branch}")
        done = {(r["src"], r["parent"]): r["dst"] for r in self._memo(bits).collect()}  # a history's rows
        for s in self._history(source, source.ref(src)):
            if (known := done.get((s["oid"], tip))) is not None:
                self.update_ref(f"refs/heads/{branch}", known, tip)
                tip = known
                continue
            files = source.restore(s["oid"]).join(source.damaged(s["oid"]).withColumn("__lost", F.lit(True)), "path", "left")
            note = F.encode(F.concat(F.lit("A part of this file was missing when it was rewritten: "), "path", F.lit("\n")), "UTF-8")
            tip = self.save(branch, files.withColumn("content", F.when(F.col("__lost"), note).otherwise(F.col("content"))), s["utc"], s["message"], s["author"] or NOBODY, bits=bits)
            self._append("memo", self.spark.createDataFrame([(s["oid"], bits, tip)], _MEMO))
        return tip

    def _memo(self, bits: int) -> DataFrame:
        """(src, dst, parent) of earlier rewrites with so many bits whose results are stored still."""
        memo = self.table("memo").where(F.col("bits") == bits).select("src", F.col("dst").alias("oid"))
        return memo.join(self.table("saves").select("oid", "parent").distinct(), "oid").select("src", F.col("oid").alias("dst"), "parent")

    def walk(self, save: str, exclude: Sequence[str] = (), known: DataFrame | None = None) -> DataFrame:
        """(path, mode, oid, size, mtime) of a save's files, without those that patterns of exclude hide (as in
        snapshot.exclude_patterns) and those whose id is in known (oid), as converted before."""
        rows = self.table("files").where(F.col("save") == save).select("path", "mode", "oid", "size", "mtime")
        rows = snapshot.exclude_patterns(rows, exclude) if exclude else rows
        return rows if known is None else membership.missing(rows, known).select(*rows.columns)

    def damaged(self, save: str) -> DataFrame:
        """(path) of a save's files whose chunks are not all stored."""
        parts = self.table("chunks").join(self.table("objects").select("oid"), "oid", "left_anti").select(F.col("root").alias("oid"))
        files = self.table("files").where(F.col("save") == save)
        whole = self.table("chunks").select(F.col("root").alias("oid"))
        unknown = files.where("size > 0").join(whole, "oid", "left_anti")
        return files.join(parts, "oid", "left_semi").select("path").unionByName(unknown.select("path")).distinct()

    def _copy(self, source: Repository, oid: str) -> None:
        """Brings over what oid reaches and is not here."""
        root = self.spark.createDataFrame([(oid,)], "node string")
        present = self.table("objects").select(F.col("oid").alias("node"))
        wanted = written(graph.transfer_set(source.table("links"), root, present).select(F.col("node").alias("oid")), "wanted")
        self._append("objects", written(membership.exists(source.table("objects"), wanted).select("oid", "kind", "size", "content", "pack"), "objects"))
        self._append("links", written(source.table("links").join(wanted.select(F.col("oid").alias("src")), "src", "left_semi"), "links"))
        saves = written(membership.exists(source.table("saves"), wanted), "saves")
        self._append("saves", saves)
        self._append("files", written(source.table("files").join(saves.select(F.col("oid").alias("save")), "save", "left_semi"), "files"))
        roots = self.table("files").select(F.col("oid").alias("root")).distinct()
        chunks = source.table("chunks").join(roots, "root", "left_semi").join(self.table("chunks").select("root").distinct(), "root", "left_anti")
        self._append("chunks", written(chunks, "chunks"))

    def get(self, source: Repository, method: str, src: str, dest: str | None = None) -> str:
        """Copies what source's reference src (or stored object of that id) reaches and is not here, then sets dest.

        Methods: ff (dest must be an ancestor), replace, new-tag (dest must not exist), pick (the one save on top of dest, which
        must be no tag that exists), force-pick (a tag too), append (its history, or a tree as a save, on top of dest), unnamed
        (no reference changes). Picked and appended saves keep their authors and times. Both sides must cut contents alike."""
        if method not in METHODS:
            raise ValueError(f"{method} is none of {', '.join(METHODS)}")
        if (method == "unnamed") != (dest is None):
            raise ValueError(f"{method} takes {'no' if method == 'unnamed' else 'a'} destination")
        if source.config("bits") != self.config("bits"):
            raise ValueError("the repositories cut contents differently; rewrite() converts them")
        _, since = self.generation()
        oid, now = source.ref(src), None if dest is None else self.ref(dest)
        kind = source.table("objects").where(F.col("oid") == (oid or src)).select("kind").first()
        if oid is None and kind is not None:
            oid = src
        if oid is None:
            raise ValueError(f"{src} does not exist")
        if kind["kind"] != "commit" and method not in ("replace", "new-tag", "append", "unnamed"):
            raise ValueError(f"{method} takes a commit, and {src} is a {kind['kind']}")
        if method == "new-tag" and (now is not None or not dest.startswith("refs/tags/")):
            raise ValueError(f"{dest} exists, or is no tag")
        if method == "pick" and now is not None and dest.startswith("refs/tags/"):
            raise ValueError(f"{dest} exists; force-pick replaces it")
        if method == "replace" and dest.startswith("refs/heads/") and kind["kind"] != "commit":
            raise ValueError(f"a branch cannot be a {kind['kind']}")
        if method == "ff" and now is not None:
            parents = source.table("saves").where("parent IS NOT NULL").select(F.col("oid").alias("child"), "parent")
            asked = self.spark.createDataFrame([(oid, now)], "src string, dest string")
            if not history.fast_forwards(parents, asked).first()["allowed"]:
                raise ValueError(f"{dest} is not an ancestor of {src}")
        self._copy(source, oid)
        if method == "unnamed":
            return oid
        branch = dest.removeprefix("refs/heads/").removeprefix("refs/tags/")
        if method == "append" and kind["kind"] == "tree":
            oid = self._recommit([{"oid": oid, "tree": oid, "utc": int(time.time()), "message": "get", "author": NOBODY}], now, branch)
        elif method in ("pick", "force-pick", "append"):
            oid = self._recommit(self._history(source, oid, None if method == "append" else 0), now, branch)
        self.update_ref(dest, oid, now, since)
        return oid

    # -- one view of everything

    def view(self) -> DataFrame:
        """(parent, name, kind, mode, oid, size, mtime) of all that the store shows: '/' has the branches and '.tag'; '/.tag' the tags;
        a branch its saves by name and 'latest'; a save its files and folders. parent is a path without a last '/'."""
        heads = self.table("refs").where("startswith(name, 'refs/heads/')").select(F.substr("name", F.lit(12)).alias("branch"), "oid")
        tags = self.table("refs").where("startswith(name, 'refs/tags/')").select(F.substr("name", F.lit(11)).alias("name"), "oid")
        kinds = self.table("objects").select("oid", F.col("kind").alias("stored"))
        none = F.lit(None).cast("long")

        def items(df: DataFrame, parent, name, kind: str, mode, oid, size=none, mtime=none) -> DataFrame:
            return df.select(parent.alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), mode.cast("int").alias("mode"), oid.alias("oid"), size.cast("long").alias("size"), mtime.cast("long").alias("mtime"))

        folder, root = F.lit(0o040755), F.lit("/")
        no_oid = F.lit(None).cast("string")
        out = items(self.spark.range(1), root, F.lit(".tag"), "tags", folder, no_oid).unionByName(items(heads, root, F.col("branch"), "branch", folder, F.col("oid")))
        tagged = tags.join(kinds, "oid", "left")
        out = out.unionByName(items(tagged, F.lit("/.tag"), F.col("name"), "tag", F.when(F.col("stored") == "blob", 0o100644).otherwise(0o040755), F.col("oid")))
        saves = self.table("saves")
        reach = history.rev_list(saves.select("oid", "parent", "utc"), heads.select("oid").distinct()).select("tip", F.col("oid").alias("save"), "utc", F.col("place").alias("id"))
        placed = heads.join(reach, heads["oid"] == reach["tip"]).select("branch", "save", "utc", (-F.col("id")).alias("id"))
        named = written(history.save_names(placed), "names")
        at = F.concat(F.lit("/"), "branch")
        out = out.unionByName(items(named, at, F.col("name"), "save", folder, F.col("save"), mtime=F.col("utc")))
        newest = named.groupBy("branch").agg(F.max_by("save", "id").alias("save"), F.max("utc").alias("utc"))
        out = out.unionByName(items(newest, at, F.lit("latest"), "latest", F.lit(0o120755), F.col("save"), mtime=F.col("utc")))
        shown = self.table("files").join(named.select("save", F.concat_ws("/", at, "name").alias("top")), "save")
        parts = F.filter(F.split("path", "/"), lambda s: s != "")
        shown = shown.withColumn("p", parts).where("size(p) > 0")
        under = lambda n: F.concat_ws("/", F.col("top"), F.array_join(F.slice("p", F.lit(1), n), "/"))
        parent_of = lambda n: F.regexp_replace(under(n), "/$", "")
        leaf = F.size("p")
        out = out.unionByName(items(shown, parent_of(leaf - 1), F.element_at("p", -1), "file", F.col("mode"), F.col("oid"), F.col("size"), F.col("mtime")))
        inner = shown.where("size(p) > 1").withColumn("n", F.explode(F.sequence(F.lit(1), leaf - 1)))
        return out.unionByName(items(inner, parent_of(F.col("n") - 1), F.element_at("p", F.col("n")), "dir", folder, no_oid).distinct())
