"""A repository of snapshots as Parquet tables, and the commands over it as jobs.

Tables: ``snapshots`` (one row each, appended last: a snapshot is there when its row is), ``entries`` and ``chunk_refs``,
``chunks`` (data by bundle), ``bundles`` (what bundles say of themselves) and ``attempts``. Everything that a command adds
carries the id of its attempt; a snapshot's row names its attempt, and chunks count once their attempt is in ``attempts``.
So what a job that died has left is never read, and the same command can run again. Commands that rewrite write a new
generation beside the old one and switch by one numbered state file, which is there whole or not at all. Commands that
write take the one exclusive lock, which a job that dies leaves behind: ``is_dirty`` tells so, ``reconcile`` cleans up.
"""

from __future__ import annotations

import json
import os
import re
import socket
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.keys import Key
from cairn.model import BUNDLES, CHUNK_REFS, CHUNKS, SNAPSHOTS, Chunker, Compression, Config
from cairn.operators import chunking, codecs, compare, dedup, integrity, restore, retention, rollup, usage
from cairn.tables import materialize, remove_path

META = "type string, size bigint, mode bigint, uid bigint, gid bigint, mtime bigint, symlink_target string, major bigint, minor bigint, xattrs map<string,binary>"
ENTRY_SCHEMA = f"snapshot string, attempt string, path string, {META}, content_id string, tier string, inline binary, modified boolean"
TABLES = {"snapshots": SNAPSHOTS, "entries": ENTRY_SCHEMA, "chunk_refs": f"{CHUNK_REFS}, attempt string", "chunks": CHUNKS, "bundles": BUNDLES, "attempts": "attempt string"}
STATES_KEPT = 5
BROKEN = ".broken"


class RepositoryError(Exception):
    """A command that can't be carried out on this repository."""


def _names(schema: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in re.sub("<[^>]*>", "", schema).split(",")]


class Repository:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, keys: Iterable[Key] = ()):
        self.spark, self.root = spark, root.rstrip("/")
        self.keys = {k.name: k for k in keys}
        self.config = config or self._stored_config()
        #: Called before every write with the name of the table; tests end a command there.
        self._before = lambda table: None

    # ---- files ----

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _listed(self, folder: str) -> list[str]:
        fs, where = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _read_text(self, name: str) -> str:
        fs, where = self._fs(f"{self.root}/{name}")
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> None:
        fs, where = self._fs(f"{self.root}/{name}")
        out = fs.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()

    # ---- locks ----

    def locks(self) -> list[tuple[str, str]]:
        """(name, holder) of the locks that are held, or were when a job died."""
        return [(n, self._read_text(f"locks/{n}")) for n in self._listed("locks") if n.endswith(".lock")]

    @contextmanager
    def lock(self, exclusive: bool = True) -> Iterator[None]:
        """One exclusive lock and no other, or any number of shared ones. A lock is written first and then checked, so of
        two that come at once one at least sees the other."""
        name = f"{'exclusive' if exclusive else 'shared'}-{uuid.uuid4().hex}.lock"
        self._create(f"locks/{name}", f"{socket.gethostname()[:254]} {os.getpid()}")
        try:
            others = [(n, holder) for n, holder in self.locks() if n != name and (exclusive or n.startswith("exclusive"))]
            if others:
                raise RepositoryError(f"locked by {others[0][1]}; if that job is dead, reconcile the repository")
            yield
        finally:
            remove_path(self.spark, f"{self.root}/locks/{name}")

    def is_dirty(self) -> bool:
        """Whether a command that writes runs, or has died."""
        return any(n.startswith("exclusive") for n, _ in self.locks())

    # ---- state ----

    def _state(self) -> dict | None:
        """The state of the highest number. State files are renamed into place whole, and none is changed after."""
        names = [n for n in self._listed("state") if n.endswith(".json")]
        return json.loads(self._read_text(f"state/{names[-1]}")) if names else None

    def _write_state(self, **changes) -> None:
        state = (self._state() or {"number": 0, "generations": {}, "config": None}) | changes
        state["number"] += 1
        self._before("state")
        part, name = f"state/{uuid.uuid4().hex}.part", f"state/{state['number']:012d}.json"
        self._create(part, json.dumps(state))
        fs, source = self._fs(f"{self.root}/{part}")
        target = self._fs(f"{self.root}/{name}")[1]
        if fs.exists(target) or not fs.rename(source, target):
            raise RepositoryError(f"{name} can't be written: another command was faster")
        for old in [n for n in self._listed("state") if n.endswith(".json")][:-STATES_KEPT]:
            remove_path(self.spark, f"{self.root}/state/{old}")

    def _stored_config(self) -> Config:
        state = self._state()
        if state is None:
            raise RepositoryError(f"no repository at {self.root}")
        return _config(state["config"])

    @classmethod
    def init(cls, spark: SparkSession, root: str, config: Config | None = None, keys: Iterable[Key] = ()) -> Repository:
        repo = cls(spark, root, config or Config(), keys)
        if repo._state() is not None:
            raise RepositoryError(f"{root} is a repository already")
        repo.set_config(repo.config)
        return repo

    @classmethod
    def import_from(cls, spark: SparkSession, root: str, source: str, keys: Iterable[Key] = ()) -> Repository:
        """A repository at ``root`` with all that the one at ``source`` holds, and the settings of its newest snapshot."""
        there = cls(spark, source, keys=keys)
        newest = there.snapshots().agg(F.max_by("config", F.struct("ts", "snapshot"))).first()[0]
        repo = cls.init(spark, root, _config(json.loads(newest)) if newest else there.config, keys)
        with repo.lock():
            repo._switch(**{name: there._current(name) for name in TABLES})
        return repo

    def add_key(self, key: Key) -> None:
        """Makes a key known to this session; the repository only ever holds key names."""
        self.keys[key.name] = key

    def set_config(self, config: Config) -> None:
        """Settings for what comes; chunks that are stored keep theirs."""
        if config.encryption and config.encryption not in self.keys:
            raise RepositoryError(f"key {config.encryption} is not known")
        with self.lock():
            self.config = config
            self._write_state(config=asdict(config))

    # ---- tables ----

    def _generation(self, table: str) -> str:
        state = self._state()
        return f"{self.root}/{table}/{state['generations'].get(table, 'g0') if state else 'g0'}"

    def _table(self, name: str) -> DataFrame:
        path, schema = self._generation(name), TABLES[name]
        fs, where = self._fs(path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(where) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, df: DataFrame) -> None:
        self._before(name)
        df.select(*_names(TABLES[name])).write.mode("append").parquet(self._generation(name))

    def _switch(self, **tables: DataFrame) -> None:
        """Replaces tables at once: new files are complete before the state names them; the old ones go after."""
        old = [self._generation(t) for t in tables]
        generations = dict((self._state() or {"generations": {}})["generations"])
        for t, df in tables.items():
            generations[t] = f"g{uuid.uuid4().hex}"
            self._before(t)
            df.select(*_names(TABLES[t])).write.parquet(f"{self.root}/{t}/{generations[t]}")
        self._write_state(generations=generations)
        for path in old:
            remove_path(self.spark, path)

    def _committed(self, df: DataFrame) -> DataFrame:
        return df.join(self._table("attempts").distinct(), "attempt", "left_semi")

    def snapshots(self) -> DataFrame:
        return self._table("snapshots")

    def _known(self, df: DataFrame) -> DataFrame:
        """Rows of snapshots that are there, by the attempt that their row names."""
        return df.join(self.snapshots().select("snapshot", "attempt"), ["snapshot", "attempt"], "left_semi")

    def _current(self, name: str) -> DataFrame:
        """The rows of a table that count."""
        df = self._table(name)
        if name in ("entries", "chunk_refs"):
            return self._known(df)
        return self._committed(df) if name in ("chunks", "bundles") else df

    def entries(self, name: str | None = None) -> DataFrame:
        e = self._current("entries")
        return e.where(F.col("snapshot") == name) if name else e

    def chunk_refs(self, name: str | None = None) -> DataFrame:
        r = self._current("chunk_refs")
        return r.where(F.col("snapshot") == name) if name else r

    def chunks(self) -> DataFrame:
        return self._current("chunks")

    def index(self) -> DataFrame:
        """(hash, len, mode, bundle_no, chunk_no): without the data column, which is not read for it."""
        return self.chunks().select("hash", "len", "mode", "bundle_no", "chunk_no")

    def bundles(self) -> DataFrame:
        """One row a bundle, as its chunks say. The encoded size is that of the stored data."""
        return self._described(self.chunks()).drop("attempt", "codec", "hash_method", "key")

    @staticmethod
    def _described(chunks: DataFrame) -> DataFrame:
        said = ("mode", "attempt", "codec", "hash_method", "key")
        sizes = chunks.select("bundle_no", "chunk_no", "hash", "len", *said, F.octet_length("data").alias("stored"))
        kinds = sizes.groupBy("bundle_no").agg(*(F.min(c).alias(c) for c in said))
        return dedup.bundles(sizes, F.col("stored")).join(kinds, "bundle_no")

    def bundle_list(self) -> DataFrame:
        """One row a bundle, as written with it; the file it would have among all of them."""
        listed = self._current("bundles")
        return listed.withColumn("path", dedup.fan_out(F.col("bundle_id"), F.lit(listed.count())))

    # ---- commands ----

    def backup(self, entries: DataFrame, name: str, ts: str, host: str | None = None, path: str = "/", full: bool = False, user_names: dict | None = None, group_names: dict | None = None) -> DataFrame:
        """Takes a snapshot of ``entries`` (path, type, size, mode, uid, gid, mtime, symlink_target, data; major, minor and xattrs where there are).

        Entries that the latest snapshot of the same host and path has unchanged keep their chunks, and their contents
        aren't read; small contents are kept with their entry, others are chunked, and chunks that the repository lacks
        are packed and stored. The snapshot's row comes last; a command that ends before has left nothing that is read.
        """
        if self.snapshots().where(F.col("snapshot") == name).limit(1).count():
            raise RepositoryError(f"snapshot {name} exists")
        with self.lock():
            return self._backup(entries, name, ts, host or socket.gethostname()[:254], path, full, user_names or {}, group_names or {})

    def _backup(self, entries: DataFrame, name: str, ts: str, host: str, path: str, full: bool, user_names: dict, group_names: dict) -> DataFrame:
        spark, attempt = self.spark, uuid.uuid4().hex
        before = self.snapshots().where((F.col("host") == host) & (F.col("path") == path)).agg(F.max(F.struct("ts", "snapshot")).alias("at")).first()["at"]
        columns = ["path", *_names(META)]
        for c, kind in (("major", "bigint"), ("minor", "bigint"), ("xattrs", "map<string,binary>")):
            if c not in entries.columns:
                entries = entries.withColumn(c, F.lit(None).cast(kind))
        meta = entries.select(columns)
        if before is None or full:
            marked = meta.withColumn("unchanged", F.lit(False))
        else:
            marked = dedup.unchanged(meta, self.entries(before["snapshot"]).select("path", "type", "size", "mtime"))
        marked = materialize(marked, "backup-entries")
        changed = marked.where("not unchanged and type = 'file' and size > 0").select("path", "size")
        small = F.col("size") < dedup.INLINE_BYTES
        inline = entries.select("path", F.col("data").alias("inline")).join(changed.where(small).select("path"), "path", "left_semi")
        contents = entries.select("path", "data").join(changed.where(~small).select("path"), "path", "left_semi")
        pieces = materialize(chunking.content_chunks(contents, "data", self.config.chunker.method, self.config.chunker.size, ["path"], self.config.chunker.seed, self.config.hash, with_data=True), "backup-chunks")
        refs = pieces.select("path", "ord", "hash", "len")
        if before is not None and not full:
            same = marked.where("unchanged").select("path")
            refs = refs.unionByName(self.chunk_refs(before["snapshot"]).join(same, "path", "left_semi").select("path", "ord", "hash", "len"))
            inline = inline.unionByName(self.entries(before["snapshot"]).join(same, "path", "left_semi").where("inline is not null").select("path", "inline"))
        refs = materialize(refs, "backup-refs")

        fresh = dedup.first_seen(pieces.select("hash", "len", "path", "ord"), ["path", "ord"], []).join(self.index().select("hash"), "hash", "left_anti")
        packed = materialize(dedup.pack(fresh, ["path", "ord"], self.config.bundle_size).withColumn("bundle_no", F.col("bundle_no") + self._next_bundle()), "backup-packed")
        data = pieces.select("path", "ord", "data").join(packed.select("path", "ord", "hash", "len", "bundle_no", "chunk_no"), ["path", "ord"])
        described = self._store(data.withColumns({"mode": F.lit("data"), "hash_method": F.lit(self.config.hash)}), attempt)

        lists = refs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "hash"))).alias("list"))
        content_id = F.coalesce(F.md5(F.array_join(F.transform("list", lambda c: c["hash"]), ",")), F.md5("inline"))
        tier = F.when(F.col("type") == "file", dedup.storage_tier(F.col("size"), F.col("n"))).otherwise("none")
        rows = marked.join(lists, "path", "left").join(inline, "path", "left").withColumns({"content_id": content_id, "tier": tier, "modified": F.lit(False), "snapshot": F.lit(name), "attempt": F.lit(attempt)})
        self._append("entries", rows)
        self._append("chunk_refs", refs.withColumns({"snapshot": F.lit(name), "attempt": F.lit(attempt)}))

        totals = marked.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.when(~F.col("unchanged"), F.col("size"))), F.lit(0)).alias("changed"), F.count_if(F.col("type") == "directory").alias("dirs"), F.count_if(F.col("type") != "directory").alias("files")).first()
        new = described.agg(F.coalesce(F.sum("raw_size"), F.lit(0)).alias("raw"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("bundles"), F.coalesce(F.sum("encoded_size"), F.lit(0)).alias("stored")).first()
        row = (
            name, attempt, None, host, path, json.dumps(asdict(self.config)), totals["size"], totals["changed"], new["raw"], new["stored"], new["bundles"], new["chunks"],
            new["raw"] / new["chunks"] if new["chunks"] else None, totals["dirs"], totals["files"], False, user_names, group_names,
        )
        self._append("snapshots", spark.createDataFrame([row], SNAPSHOTS).withColumn("ts", F.to_timestamp(F.lit(ts))))
        return self.snapshots().where(F.col("snapshot") == name)

    def _next_bundle(self) -> int:
        return (self.index().agg(F.max("bundle_no")).first()[0] or 0) + 1

    def _store(self, data: DataFrame, attempt: str) -> DataFrame:
        """Adds chunks (hash, len, mode, bundle_no, chunk_no, hash_method, data) by today's codec and key; returns their bundles' rows."""
        encoded = codecs.compressed(F.col("data"), self.config.compression)
        key = self.config.encryption
        if key:
            if key not in self.keys:
                raise RepositoryError(f"key {key} is not known")
            encoded = codecs.encrypted(encoded, self.keys[key].column())
        codec = str(self.config.compression) if self.config.compression else None
        said = {"attempt": attempt, "codec": codec, "key": key}
        stored = data.withColumns({"data": encoded} | {c: F.lit(v).cast("string") for c, v in said.items()})
        self._append("chunks", stored.repartition("bundle_no").sortWithinPartitions("bundle_no", "chunk_no"))
        written = self._table("chunks").where(F.col("attempt") == attempt)
        described = materialize(self._described(written), "bundles")
        self._append("bundles", described)
        self._append("attempts", self.spark.createDataFrame([(attempt,)], TABLES["attempts"]))
        return described

    def _opened(self, chunks: DataFrame) -> DataFrame:
        """Chunks with their data decrypted, each by the key that it names; damaged data becomes null."""
        used = [r[0] for r in chunks.select("key").where("key is not null").distinct().collect()]  # a handful of names
        unknown = [k for k in used if k not in self.keys]
        if unknown:
            raise RepositoryError(f"key {unknown[0]} is not known")
        data: Column = F.col("data")
        for k in used:
            data = F.when(F.col("key") == k, F.try_aes_decrypt(F.col("data"), self.keys[k].column(), F.lit("GCM"))).otherwise(data)
        return chunks.withColumn("data", data)

    def _stored(self, wanted: DataFrame | None = None) -> DataFrame:
        """(hash, len, data) with the data as it was, by the codec and key of each chunk; the latest place of a hash counts.

        With ``wanted`` (hash) only these chunks are read.
        """
        chunks = self.chunks()
        if wanted is not None:
            chunks = chunks.join(wanted.select("hash").distinct(), "hash", "left_semi")
        latest = dedup.latest_location(chunks.select("hash", F.col("bundle_no").alias("bundle_id"), "chunk_no")).withColumnRenamed("bundle_id", "bundle_no")
        found = self._opened(chunks.join(latest, ["hash", "bundle_no", "chunk_no"], "left_semi"))
        return found.select("hash", "len", codecs.decompressed_by(F.col("data"), F.col("codec")).alias("data"))

    def restore(self, name: str, below: str = "/", users: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
        """Entries of a snapshot at or below a path, with their contents.

        ``users`` and ``groups`` (id, name) are those of this host: owners get the id that their stored name has here,
        and keep theirs where the name is unknown.
        """
        entries = self.entries(name)
        if below != "/":
            entries = entries.where((F.col("path") == below) | F.startswith("path", F.lit(below.rstrip("/") + "/")))
            if not entries.limit(1).count():
                raise RepositoryError(f"{below} is not in snapshot {name}")
        for column, stored, local in (("uid", "user_names", users), ("gid", "group_names", groups)):
            if local is not None:
                there = self.snapshots().where(F.col("snapshot") == name).select(F.explode(stored).alias("id", "name"))
                entries = compare.remap_owner(entries, there, local, column).drop(column, "name").withColumnRenamed(f"local_{column}", column)
        refs = self.chunk_refs(name).join(entries.select("path"), "path", "left_semi")
        data = restore.reassemble(refs, self._stored(refs), ["path"])
        return entries.join(data, "path", "left").withColumn("data", F.coalesce("inline", "data")).drop("inline")

    def read(self, name: str, path: str, offset: int, size: int) -> bytes:
        """Bytes of one file; only chunks that overlap the range are fetched."""
        entry = self.entries(name).where(F.col("path") == path).select("inline").first()
        if entry is None:
            raise RepositoryError(f"{path} is not in snapshot {name}")
        if entry["inline"] is not None:
            return bytes(entry["inline"])[offset : offset + size]
        refs = restore.overlapping(self.chunk_refs(name).where(F.col("path") == path), ["path"], offset, size)
        row = restore.cut_range(refs, self._stored(refs), ["path"], offset, size).first()
        return bytes(row["data"]) if row else b""

    def list(self, name: str | None = None, path: str = "/") -> DataFrame:
        if name is None:
            return self.snapshots().orderBy("snapshot")
        return compare.listing(rollup.with_names(self.entries(name)), path)

    def info(self, name: str | None = None, path: str | None = None) -> DataFrame:
        if name is None:
            return usage.info(self.bundles())
        if path is not None:
            return compare.resolve(self.entries(name), path)
        saved = F.try_divide(F.col("dedup_size").cast("double"), F.col("changed_size").cast("double")) - 1
        return self.snapshots().where(F.col("snapshot") == name).withColumn("dedup_saved", saved * 100)

    def rollup(self, name: str) -> DataFrame:
        return rollup.rollup(self.entries(name).where("type <> 'directory'").select("path", "size"))

    def statistics(self) -> DataFrame:
        """Statistics of the bundles' sizes and counts by mode; a null mode is all of them."""
        return usage.bundle_statistics(self.bundles())

    def method_counts(self) -> DataFrame:
        """How many bundles use each codec, hash and key."""
        return usage.method_counts(self._current("bundles"), ["codec", "hash_method", "key"])

    def diff(self, old: str, new: str) -> DataFrame:
        drop = ["snapshot", "attempt", "tier", "modified", "inline", "xattrs"]
        return compare.diff(self.entries(old).drop(*drop), self.entries(new).drop(*drop))

    def versions(self, path: str) -> DataFrame:
        dated = self.entries().where(F.col("path") == path).join(self.snapshots().select("snapshot", "ts"), "snapshot")
        first = dated.groupBy("path", "type", "mtime", "size").agg(F.min(F.struct("ts", "snapshot")).alias("at"))
        return first.select("path", "type", "mtime", "size", "at.snapshot").orderBy("mtime", "snapshot")

    def duplicates(self, name: str, min_size: int = 1) -> DataFrame:
        """Groups of files with equal contents, by their lists of chunks."""
        files = self.entries(name).where((F.col("type") == "file") & (F.col("size") >= min_size))
        groups = files.groupBy("content_id", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path"))
        return groups.where("copies > 1 and content_id is not null")

    def analyze(self) -> DataFrame:
        return usage.usage(self.chunk_refs(), self.index().select("hash", "len", "bundle_no"), self.bundles())

    def prune(self, prefix: str = "", force: bool = False, **counts: int) -> DataFrame:
        """Snapshots that the calendar doesn't keep; with ``force`` they are removed."""
        gone = materialize(retention.removable(self.snapshots().select("snapshot", "ts"), prefix=prefix, **counts), "prune")
        if force:
            with self.lock():
                self._remove_snapshots(gone.select("snapshot"))
        return gone

    def _remove_snapshots(self, names: DataFrame) -> None:
        self._switch(snapshots=materialize(self.snapshots().join(names, "snapshot", "left_anti"), "snapshots"))

    def remove(self, name: str, path: str | None = None) -> None:
        """Removes a snapshot, or a path of it; the snapshot then says that it was modified."""
        with self.lock():
            if path is None:
                self._remove_snapshots(self.snapshots().where(F.col("snapshot") == name).select("snapshot"))
                return
            kept = compare.remove_subtree(self.entries(name), path)
            entries = self.entries().where(F.col("snapshot") != name).unionByName(kept)
            refs = self.chunk_refs().join(entries.select("snapshot", "path"), ["snapshot", "path"], "left_semi")
            marked = self.snapshots().withColumn("modified", F.col("modified") | (F.col("snapshot") == name))
            self._switch(entries=materialize(entries, "entries"), chunk_refs=materialize(refs, "refs"), snapshots=materialize(marked, "snapshots"))

    def copy(self, name: str, to: str) -> None:
        """The same snapshot under another name: entries and references, no data."""
        if self.snapshots().where(F.col("snapshot") == to).limit(1).count():
            raise RepositoryError(f"snapshot {to} exists")
        attempt = F.lit(uuid.uuid4().hex)
        with self.lock():
            for table in ("entries", "chunk_refs"):
                self._append(table, materialize(getattr(self, table)(name).withColumns({"snapshot": F.lit(to), "attempt": attempt}), "copy"))
            self._append("snapshots", materialize(self.snapshots().where(F.col("snapshot") == name).withColumns({"snapshot": F.lit(to), "attempt": attempt}), "copy"))

    def vacuum(self, ratio: float = 0.0, combine: bool = False, force: bool = False) -> DataFrame:
        """The bundles that compaction would rewrite; with ``force`` it does: live chunks are packed anew by today's codec and key, under their names; dead ones go.

        Nothing changes unless every live chunk that was there is there after, in no rewritten bundle.
        """
        with self.lock(exclusive=force):
            plan = materialize(usage.vacuum_plan(self.analyze(), ratio, self.config.bundle_size, combine), "vacuum")
            if force:
                self._compact(plan.where("rewrite").select("bundle_no"))
        return plan

    def _compact(self, chosen: DataFrame) -> None:
        attempt = uuid.uuid4().hex
        live = self.chunk_refs().select("hash").distinct()
        stay, bundles = self.chunks().join(chosen, "bundle_no", "left_anti"), self._current("bundles").join(chosen, "bundle_no", "left_anti")
        # a hash that stands elsewhere too needs no second place
        needed = live.join(stay.select("hash"), "hash", "left_anti")
        moved = self._opened(self.chunks().join(chosen, "bundle_no", "left_semi").join(needed, "hash", "left_semi"))
        place = F.struct("bundle_no", "chunk_no")
        latest = moved.groupBy("hash").agg(F.max(place).alias("_at"))
        moved = moved.join(latest, "hash").where(place == F.col("_at")).select("hash", "len", "mode", "hash_method", F.col("bundle_no").alias("from_no"), codecs.decompressed_by(F.col("data"), F.col("codec")).alias("data"))
        moved = materialize(moved, "vacuum-moved")
        start = self._next_bundle()
        packed = dedup.pack(moved.select("hash", "len", "mode", "from_no"), ["from_no", "hash"], self.config.bundle_size, ["mode"])
        # bundles of different modes get numbers of their own
        numbers = {r["mode"]: r["n"] for r in packed.groupBy("mode").agg((F.max("bundle_no") + 1).alias("n")).collect()}
        first = {m: start + sum(n for k, n in numbers.items() if k < m) for m in numbers}
        if first:
            offset = F.coalesce(*(F.when(F.col("mode") == m, F.lit(v)) for m, v in first.items()))
            packed = packed.withColumn("bundle_no", F.col("bundle_no") + offset)
        self._store(moved.select("hash", "hash_method", "data").join(packed, "hash"), attempt)
        fresh = self._table("chunks").where(F.col("attempt") == attempt)
        chunks = materialize(stay.unionByName(fresh.select(*stay.columns)), "vacuum-chunks")
        lost = live.join(self.index().select("hash"), "hash", "left_semi").join(chunks.select("hash"), "hash", "left_anti")
        if lost.limit(1).count() or chunks.join(chosen, "bundle_no", "left_semi").limit(1).count():
            raise RepositoryError("compaction would lose chunks; nothing was changed")
        self._switch(chunks=chunks, bundles=materialize(bundles.unionByName(self._table("bundles").where(F.col("attempt") == attempt)), "vacuum-bundles"))

    # ---- checks ----

    def check_backups(self) -> DataFrame:
        """References that no stored chunk answers, but those of the originals that a repair has kept."""
        return integrity.missing_chunks(self.chunk_refs().where(~F.endswith("snapshot", F.lit(BROKEN))), self.index())

    def check_index(self) -> DataFrame:
        """Places in bundles that are not listed, or past their end, and hashes with more than one place."""
        listed = self._current("bundles")
        dangling = integrity.dangling_index(self.index(), listed).select("hash", "bundle_no", "chunk_no", "fault")
        twice = self.index().join(integrity.repeated_index(self.index()).select("hash"), "hash", "left_semi")
        return dangling.union(twice.select("hash", "bundle_no", "chunk_no", F.lit("repeated")))

    def check_repository(self) -> DataFrame:
        """(fault, what) of the catalog of bundles against the chunks."""
        return integrity.catalog_faults(self.index(), self._current("bundles"))

    def check_bundles(self) -> DataFrame:
        """Bundles whose chunks have another number or other sizes than was written with them."""
        return integrity.bundle_mismatch(self._current("bundles"), self.index()).select("bundle_no", "chunk_count", "raw_size", "found_chunks", "found_raw")

    def check_data(self) -> DataFrame:
        """Chunks whose bytes no longer hash to their name, each by its own settings: every chunk is read and hashed again."""
        return integrity.rehashed(self._opened(self.chunks())).where("not hash <=> found").withColumnRenamed("hash", "stored_hash")

    def reconcile(self) -> DataFrame:
        """Cleans up after jobs that died: (table, rows) of what they left, which goes, as do their locks. No command may run meanwhile."""
        for name, _ in self.locks():
            remove_path(self.spark, f"{self.root}/locks/{name}")
        report = []
        with self.lock():
            for name in ("entries", "chunk_refs", "chunks", "bundles"):
                left = self._table(name).count() - self._current(name).count()
                report.append((name, left))
                if left:
                    self._switch(**{name: materialize(self._current(name), "reconcile")})
                state = self._state()["generations"]
                for folder in self._listed(name):
                    if folder != state.get(name, "g0"):
                        remove_path(self.spark, f"{self.root}/{name}/{folder}")
        return self.spark.createDataFrame(report, "table string, rows bigint")

    def repair(self) -> DataFrame:
        """Mends what the checks find, and returns the snapshots that it changed, whose originals stay, as ``<name>.broken``.

        Chunks whose data is damaged go, and the catalog of bundles is made again from the chunks that are whole, so what
        a bundle that lost its end still holds is kept. Files that lost chunks become empty; entries below files go.
        """
        whole = ~F.endswith("snapshot", F.lit(BROKEN))
        with self.lock():
            bad = materialize(self.check_data().select("stored_hash", "bundle_no", "chunk_no"), "repair-bad")
            sound = self.chunks().join(bad, ["bundle_no", "chunk_no"], "left_anti")
            sound = materialize(sound.withColumn("chunk_no", F.row_number().over(Window.partitionBy("bundle_no").orderBy("chunk_no")).cast("bigint") - 1), "repair-chunks")
            self._switch(chunks=sound, bundles=materialize(self._described(sound), "repair-bundles"))
            lost = materialize(self.check_backups().select("snapshot", "path").distinct(), "repair-lost")
            gone = materialize(integrity.misplaced(self.entries().where(whole)), "repair-misplaced")
            touched = materialize(lost.select("snapshot").union(gone.select("snapshot")).distinct(), "repair-touched")
            entries = self.entries().join(gone, ["snapshot", "path"], "left_anti").join(lost.withColumn("lost", F.lit(True)), ["snapshot", "path"], "left")
            bad_file = F.coalesce("lost", F.lit(False))
            fixed = entries.withColumns({"size": F.when(bad_file, 0).otherwise(F.col("size")), "content_id": F.when(~bad_file, F.col("content_id")), "tier": F.when(bad_file, "none").otherwise(F.col("tier")), "modified": F.col("modified") | bad_file}).drop("lost")
            kept = self.entries().join(touched, "snapshot", "left_semi")
            refs = self.chunk_refs().join(lost, ["snapshot", "path"], "left_anti").join(gone, ["snapshot", "path"], "left_anti")
            kept_refs = self.chunk_refs().join(touched, "snapshot", "left_semi")
            changed = self.snapshots().join(touched.withColumn("touched", F.lit(True)), "snapshot", "left")
            marked = changed.withColumn("modified", F.col("modified") | F.coalesce("touched", F.lit(False))).drop("touched")
            original = self.snapshots().join(touched, "snapshot", "left_semi")
            renamed = lambda df: df.withColumn("snapshot", F.concat("snapshot", F.lit(BROKEN)))
            self._switch(
                entries=materialize(fixed.unionByName(renamed(kept)), "repair"), chunk_refs=materialize(refs.unionByName(renamed(kept_refs)), "repair"), snapshots=materialize(marked.unionByName(renamed(original)), "repair")
            )
        return touched


def _config(c: dict) -> Config:
    return Config(c["bundle_size"], Chunker(**c["chunker"]), Compression(**c["compression"]) if c["compression"] else None, c["hash"], c.get("encryption"))
