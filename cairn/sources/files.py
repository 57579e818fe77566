"""File trees and tar archives as entries, and back."""

from __future__ import annotations

import io
import os
import re
import stat
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.scalars import excluded, glob_regex
from cairn.model import pax_record
from cairn.tables import materialize

SCHEMA = "path string, type string, size bigint, mode bigint, uid bigint, gid bigint, mtime bigint, symlink_target string, major bigint, minor bigint, xattrs map<string,binary>, data binary"
_KINDS = {stat.S_IFREG: "file", stat.S_IFDIR: "directory", stat.S_IFLNK: "symlink", stat.S_IFBLK: "block_device", stat.S_IFCHR: "char_device", stat.S_IFIFO: "named_pipe"}
_TAR = {"file": tarfile.REGTYPE, "directory": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE, "block_device": tarfile.BLKTYPE, "char_device": tarfile.CHRTYPE, "named_pipe": tarfile.FIFOTYPE}
_FROM_TAR = {v: k for k, v in _TAR.items()} | {tarfile.AREGTYPE: "file"}
_XATTR = "SCHILY.xattr."
FIELDS = tuple(part.split()[0] for part in re.sub("<[^>]*>", "", SCHEMA).split(", "))
#: Contents that a task holds before it hands them on.
BATCH_BYTES = 64 << 20


def contents(spark: SparkSession, root: str, excludes: list[str] = ()) -> DataFrame:
    """Files of any store that Spark reads: path, size, mtime and content. Columns that a query doesn't use aren't read."""
    base = root.rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^.*?" + re.escape(base.split(":", 1)[-1].lstrip("/")), "")
    out = df.select(path.alias("path"), F.lit("file").alias("type"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("content").alias("data"))
    return out.where(~excluded(F.col("path"), list(excludes)))


def _entry(root: str, relative: str, with_data: bool) -> dict:
    full = os.path.join(root, relative.lstrip("/")) if relative != "/" else root
    s = os.lstat(full)
    kind = _KINDS.get(stat.S_IFMT(s.st_mode), "file")
    device = kind.endswith("_device")
    attrs = {}
    if hasattr(os, "listxattr"):
        try:
            attrs = {k: os.getxattr(full, k, follow_symlinks=False) for k in os.listxattr(full, follow_symlinks=False)}
        except OSError:
            attrs = {}
    data = None
    if kind == "file" and with_data:
        with open(full, "rb") as f:
            data = f.read()
    return {
        "path": relative, "type": kind, "size": s.st_size if kind == "file" else 0, "mode": stat.S_IMODE(s.st_mode), "uid": s.st_uid, "gid": s.st_gid, "mtime": int(s.st_mtime),
        "symlink_target": os.readlink(full) if kind == "symlink" else None, "major": s.st_rdev >> 8 if device else None, "minor": s.st_rdev & 255 if device else None, "xattrs": list(attrs.items()), "data": data,
    }


def _batch(rows: list[dict], errors: list | None = None) -> pa.RecordBatch:
    big = pa.int64()
    kinds = {
        "path": pa.string(), "type": pa.string(), "size": big, "mode": big, "uid": big, "gid": big, "mtime": big, "symlink_target": pa.string(), "major": big, "minor": big,
        "xattrs": pa.map_(pa.string(), pa.binary()), "data": pa.binary(),
    }
    columns = [pa.array([r[k] for r in rows], t) for k, t in kinds.items()]
    names = list(kinds)
    if errors is not None:
        columns.append(pa.array(errors, pa.string()))
        names.append("error")
    return pa.RecordBatch.from_arrays(columns, names=names)


def _listing(root: str, device: int | None, pattern: str | None):
    """Rows of what stands in folders: (path, type, error); what matches the pattern is passed over, with all below it."""
    skip = re.compile(pattern) if pattern else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                try:
                    with os.scandir(os.path.join(root, folder.lstrip("/"))) as found:
                        for e in found:
                            path = f"{folder.rstrip('/')}/{e.name}"
                            if skip and skip.search(path):
                                continue
                            inside = e.is_dir(follow_symlinks=False) and (device is None or e.stat(follow_symlinks=False).st_dev == device)
                            if inside or not e.is_dir(follow_symlinks=False):
                                rows.append((path, inside, None))
                except OSError as problem:
                    rows.append((folder, False, str(problem)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["path", "folder", "error"])

    return run


def walk(spark: SparkSession, root: str, excludes: list[str] = (), same_device: bool = True) -> DataFrame:
    """(path, folder, error) of all below a folder that all executors mount; a folder that can't be read is told with its error.

    Executors list the folders of one depth at a time, so a job a depth; the driver holds no names.
    """
    pattern = "|".join(f"(?:{r})" for r in map(glob_regex, excludes) if r)
    run = _listing(root, os.lstat(root).st_dev if same_device else None, pattern)
    found = level = spark.createDataFrame([("/", True, None)], "path string, folder boolean, error string")
    while True:
        folders = level.where("folder and error is null").select("path")
        n = folders.count()
        if not n:
            return found
        level = materialize(folders.repartition(min(n // 100 + 1, 1000)).mapInArrow(run, "path string, folder boolean, error string"), "walk")
        found = found.unionByName(level)


def _read_entries(spark: SparkSession, root: str, excludes: list[str], same_device: bool, with_data: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, errors = [], []
            for name in batch.column(0).to_pylist():
                try:
                    rows.append(_entry(root, name, with_data))
                    errors.append(None)
                except OSError as problem:
                    rows.append(dict.fromkeys(FIELDS) | {"path": name})
                    errors.append(str(problem))
                if sum(len(r["data"] or b"") for r in rows) > BATCH_BYTES:
                    yield _batch(rows, errors)
                    rows, errors = [], []
            yield _batch(rows, errors)

    listed = walk(spark, root, excludes, same_device)
    names = listed.where("error is null").select("path")
    n = names.count()
    entries = names.repartition(max(1, min(n // 1000 + 1, 1000))).mapInArrow(run, f"{SCHEMA}, error string")
    lost = listed.where("error is not null").select("path", "error")
    return entries.unionByName(lost, allowMissingColumns=True)


def scan(spark: SparkSession, root: str, excludes: list[str] = (), same_device: bool = True, with_data: bool = True) -> DataFrame:
    """Entries below a folder that all executors mount, with what only a file system knows: owner, mode, links, devices, attributes.

    Folders that an exclude line matches are not entered. What can't be read is not among them: :func:`unreadable` tells it.
    """
    return _read_entries(spark, root, excludes, same_device, with_data).where("error is null").drop("error")


def unreadable(spark: SparkSession, root: str, excludes: list[str] = (), same_device: bool = True) -> DataFrame:
    """(path, error) of entries whose metadata or contents can't be read, and of folders that can't be listed."""
    return _read_entries(spark, root, excludes, same_device, True).where("error is not null").select("path", "error")


def member_path(name: str) -> str:
    """The path of an archive's member: its steps below the root; dots that are part of a name stay."""
    return "/" + "/".join(p for p in name.split("/") if p not in ("", "."))


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """Entries of tar archives, an archive a task; several roots stand under ``/archive``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = []
                with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                    for m in tar:
                        kind = _FROM_TAR.get(m.type)
                        link = m.linkname if kind == "symlink" else None
                        body = tar.extractfile(m).read() if m.isreg() or m.islnk() else None
                        device = kind in ("block_device", "char_device")
                        attrs = [(k.removeprefix(_XATTR), v.encode("utf-8", "surrogateescape")) for k, v in m.pax_headers.items() if k.startswith(_XATTR)]
                        rows.append({
                            "path": member_path(m.name), "type": kind or "file", "size": len(body) if body is not None else 0, "mode": m.mode, "uid": m.uid, "gid": m.gid, "mtime": int(m.mtime),
                            "symlink_target": link, "major": m.devmajor if device else None, "minor": m.devminor if device else None, "xattrs": attrs, "data": body,
                        })
                if len({r["path"].split("/")[1] for r in rows}) > 1:
                    for r in rows:
                        r["path"] = "/archive" + r["path"].rstrip("/")
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def tar_bytes(rows: list[dict]) -> bytes:
    """A tar archive of entries in order of path: long names as the format's extension, attributes as extended records."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for r in sorted(rows, key=lambda r: r["path"]):
            info = tarfile.TarInfo(r["path"].lstrip("/") or ".")
            info.type, info.mode, info.uid, info.gid, info.mtime = _TAR[r["type"]], r["mode"] or 0, r["uid"] or 0, r["gid"] or 0, r["mtime"] or 0
            info.linkname, info.devmajor, info.devminor = r.get("symlink_target") or "", r.get("major") or 0, r.get("minor") or 0
            data = bytes(r["data"] or b"") if r["type"] == "file" else b""
            info.size = len(data)
            attrs = dict(r.get("xattrs") or {})
            if attrs:
                body = b"".join(pax_record(_XATTR + k, bytes(v)) for k, v in sorted(attrs.items()))
                header = tarfile.TarInfo("././@PaxHeader")
                header.type, header.size = tarfile.XHDTYPE, len(body)
                tar.addfile(header, io.BytesIO(body))
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def write_tars(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by, tar): an archive for each group, which must fit a row as an archive of a snapshot's folder does."""

    def run(frame):
        import pandas as pd

        rows = frame.to_dict("records")
        return pd.DataFrame([{**{k: rows[0][k] for k in by}, "tar": tar_bytes(rows)}])

    kinds = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in by)
    return entries.groupBy(*by).applyInPandas(run, f"{kinds}, tar binary")


def _restore(row: dict, root: str, folder_mode: bool) -> list[str]:
    """Makes one entry; returns what of it this host or this user would not take."""
    full, kind, problems = os.path.join(root, row["path"].lstrip("/")), row["type"], []

    def attempt(what: str, function, *arguments, **named) -> None:
        try:
            function(*arguments, **named)
        except OSError as problem:
            problems.append(f"{what}: {problem.strerror}")

    if kind == "directory":
        os.makedirs(full, exist_ok=True)
        if not folder_mode:
            return problems
    else:
        os.makedirs(os.path.dirname(full), exist_ok=True)
        if kind == "file":
            part = f"{full}.{os.getpid()}.part"  # a task that runs again writes the file again, whole
            with open(part, "wb") as f:
                f.write(bytes(row["data"] or b""))
            os.replace(part, full)
        else:
            if os.path.lexists(full):
                os.unlink(full)
            if kind == "symlink":
                os.symlink(row["symlink_target"], full)
            elif kind == "named_pipe":
                os.mkfifo(full)
            else:
                flag = stat.S_IFBLK if kind == "block_device" else stat.S_IFCHR
                attempt("device", os.mknod, full, 0o600 | flag, os.makedev(row["major"] or 0, row["minor"] or 0))
                if problems:
                    return problems
    if row["path"] == "/":
        return problems  # the folder that it is restored to stays as it is
    if row["uid"] is not None and row["gid"] is not None:
        attempt("owner", os.chown, full, row["uid"], row["gid"], follow_symlinks=False)
    for name, value in row["xattrs"] or []:
        attempt(f"attribute {name}", os.setxattr, full, name, bytes(value), follow_symlinks=False)
    if kind != "symlink":
        attempt("mode", os.chmod, full, row["mode"] if row["mode"] is not None else 0o644)
    attempt("time", os.utime, full, (row["mtime"] or 0, row["mtime"] or 0), follow_symlinks=False)
    return problems


def restore_files(entries: DataFrame, root: str) -> DataFrame:
    """Writes entries below a folder that all executors mount: folders, then files, links, pipes and devices, then what folders carry.

    Owners, modes, times, extended attributes and devices are set as far as the user may. Returns (path, problem) for
    what could not be: a restore without rows there is complete. The root folder itself keeps its own metadata.
    """

    def run(folder_mode: bool):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(r["path"], p) for r in batch.to_pylist() for p in _restore(r, root, folder_mode)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["path", "problem"])

        return make

    rows = entries.select(*FIELDS)
    folders, out = rows.where("type = 'directory'"), None
    for part, folder_mode in ((folders, False), (rows.where("type <> 'directory'"), False), (folders.repartition(1).sortWithinPartitions(F.length("path").desc()), True)):
        done = materialize(part.mapInArrow(run(folder_mode), "path string, problem string"), "restored")
        out = done if out is None else out.unionByName(done)
    return out
