"""Rollups along directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import ancestors, base_name, parent


def directories(entries: DataFrame) -> DataFrame:
    """All directories above the paths of ``entries``."""
    return entries.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()


def with_directories(entries: DataFrame, fill: dict) -> DataFrame:
    """``entries`` and a row for every directory above them; ``fill`` has the other columns' values of directories."""
    rows = directories(entries).select("path", *[F.lit(fill.get(c)).cast(entries.schema[c].dataType).alias(c) for c in entries.columns if c != "path"])
    return entries.unionByName(rows)


def rollup(entries: DataFrame) -> DataFrame:
    """(path, cum_size, cum_dirs, cum_files) of every directory: all below it, and itself among the directories.

    ``entries`` are files. Each is told to its ancestors, and partial sums keep what moves to a row for each directory
    and task, however many files the root has.
    """
    told = entries.select("path", "size", F.explode(ancestors(F.col("path"))).alias("dir"))
    files = told.groupBy("dir").agg(F.sum("size").alias("cum_size"), F.count(F.lit(1)).alias("cum_files"))
    own = F.concat(F.array(F.col("path")), F.when(F.col("path") == "/", F.array().cast("array<string>")).otherwise(ancestors(F.col("path"))))
    dirs = directories(entries).select(F.explode(own).alias("dir")).groupBy("dir").agg(F.count(F.lit(1)).alias("cum_dirs"))
    return files.join(dirs, "dir").select(F.col("dir").alias("path"), "cum_size", "cum_dirs", "cum_files")


def with_names(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"parent": parent(F.col("path")), "name": base_name(F.col("path"))})


def name_tree(names: DataFrame, column: str) -> DataFrame:
    """Snapshot names with slashes as a tree: every directory above them and how many names are below it."""
    path = F.concat(F.lit("/"), F.col(column))
    return names.select(F.explode(ancestors(path)).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("names"))
