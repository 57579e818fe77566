"""Comparing snapshots: diffs, changed bytes, versions, duplicates and owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.scalars import parent

META = ("type", "size", "mode", "uid", "gid", "mtime", "symlink_target")
QUICK = ("mtime", "type", "size")


def same(columns: tuple[str, ...], left: str = "o", right: str = "n") -> Column:
    """Whether the columns agree, nulls included."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def diff(old: DataFrame, new: DataFrame, meta: tuple[str, ...] = META, content: str = "content_id") -> DataFrame:
    """(change, path): ``add`` and ``del`` at the topmost path that differs only, ``mod`` where metadata or content does.

    Both tables have a row for every entry, directories too. A full outer join on path finds what differs; what was
    added or removed below something added or removed is told by its parent's row.
    """
    meta = tuple(c for c in meta if c in old.columns and c in new.columns)
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    gone, came = F.col("n.path").isNull(), F.col("o.path").isNull()
    differs = ~same(meta) | ~F.col(f"o.{content}").eqNullSafe(F.col(f"n.{content}"))
    changes = joined.select(F.coalesce("n.path", "o.path").alias("path"), F.when(came, "add").when(gone, "del").when(differs, "mod").alias("change")).where("change is not null")
    tops = changes.where("change <> 'mod'").select(F.col("path").alias("_up"))
    below = changes.where("change <> 'mod'").withColumn("_parent", parent(F.col("path"))).join(tops, F.col("_parent") == F.col("_up"), "left_anti").drop("_parent")
    return changes.where("change = 'mod'").unionByName(below).select("change", "path")


def changed_bytes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Entries and bytes, all and those that the previous snapshot lacks or has with another mtime, type or size."""
    joined = current.alias("n").join(previous.alias("o"), F.col("n.path") == F.col("o.path"), "left")
    changed = F.col("o.path").isNull() | ~same(QUICK)
    return joined.agg(
        F.count(F.lit(1)).alias("entries"), F.sum("n.size").alias("size"), F.count_if(changed).alias("changed_entries"), F.sum(F.when(changed, F.col("n.size")).otherwise(0)).alias("changed_size")
    )


def versions(entries: DataFrame, snapshot_order: str = "snapshot") -> DataFrame:
    """Distinct versions (type, mtime, size) of each path with the earliest snapshot that has them."""
    return entries.groupBy("path", "type", "mtime", "size").agg(F.min(snapshot_order).alias("snapshot"))


def versions_in_order(found: DataFrame, snapshot_order: str = "snapshot") -> DataFrame:
    """Versions with their ``place`` in the history of their path, by time."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("mtime", "size", snapshot_order))
    return found.withColumn("place", place)


def duplicates(contents: DataFrame, min_size: int = 1) -> DataFrame:
    """Groups of paths with equal content: (content_id, size, copies, paths). ``contents`` is (path, size, data).

    Sizes are counted first: contents of a size of their own are never hashed.
    """
    large = contents.where(F.col("size") >= min_size)
    shared = large.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    hashed = large.join(shared, "size", "left_semi").select("path", "size", F.md5("data").alias("content_id"))
    return hashed.groupBy("content_id", "size").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def duplicate_members(contents: DataFrame, min_size: int = 1) -> DataFrame:
    """A row for each path in a group of equal contents, so that no group is gathered."""
    large = contents.where(F.col("size") >= min_size)
    shared = large.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    hashed = large.join(shared, "size", "left_semi").select("path", "size", F.md5("data").alias("content_id"))
    groups = hashed.groupBy("content_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(groups, "content_id")


def remap_owner(entries: DataFrame, names: DataFrame, local: DataFrame, column: str = "uid") -> DataFrame:
    """Adds ``name`` and ``local_<column>``: the id that the name has here; the stored id where the name is unknown."""
    there = names.select(F.col("id").alias("_id"), F.col("name"))
    here = local.select(F.col("id").alias("_local"), F.col("name").alias("_name"))
    joined = entries.join(there, F.col(column) == F.col("_id"), "left").join(here, F.col("name") == F.col("_name"), "left")
    return joined.withColumn(f"local_{column}", F.coalesce("_local", column)).drop("_id", "_local", "_name")


def latest_reference(snapshots: DataFrame, by: list[str], ts: str, name: str) -> DataFrame:
    """The newest snapshot of each group, ties to the greatest name."""
    return snapshots.groupBy(*by).agg(F.max(F.struct(ts, name)).alias("at")).select(*by, f"at.{ts}", f"at.{name}")


def remove_subtree(entries: DataFrame, path: str) -> DataFrame:
    return entries.where((F.col("path") != path) & ~F.startswith("path", F.lit(path.rstrip("/") + "/")))


def resolve(entries: DataFrame, path: str) -> DataFrame:
    """The entries on the way to a path, the root first."""
    parts = [p for p in path.split("/") if p]
    ways = ["/"] + ["/" + "/".join(parts[: i + 1]) for i in range(len(parts))]
    return entries.where(F.col("path").isin(ways)).orderBy(F.length("path"))


def listing(entries: DataFrame, path: str) -> DataFrame:
    """The children of a directory by name."""
    return entries.where(F.col("parent") == path).orderBy("name")


def numbered_listing(entries: DataFrame, offset: int = 0) -> DataFrame:
    """Children of every directory with their place among them, from ``offset`` on, as a reader that comes back continues."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("name"))
    return entries.withColumn("place", place).where(F.col("place") > offset)
