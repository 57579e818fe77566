"""What a mounted snapshot answers, as queries over its entries. Everything is read-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalars import base_name, device_number, parent

BLOCK = 512


def lookup(entries: DataFrame, folder: str, name: str) -> DataFrame:
    return entries.where((parent(F.col("path")) == folder) & (base_name(F.col("path")) == name))


def lookup_all(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """The entries that ``asked`` (parent, name) names, in any directories: a semi join, so no directory is gathered."""
    named = entries.withColumns({"_parent": parent(F.col("path")), "_name": base_name(F.col("path"))})
    a = asked.select(F.col("parent").alias("_parent"), F.col("name").alias("_name"))
    return named.join(a, ["_parent", "_name"], "left_semi").drop("_parent", "_name")


def attributes(entries: DataFrame) -> DataFrame:
    """Size in bytes and blocks, times, kind, permissions, owner and device number of each entry."""
    rdev = device_number(F.col("device.major"), F.col("device.minor")) if "device" in entries.columns else F.lit(None).cast("bigint")
    return entries.select("path", F.col("type").alias("kind"), "size", F.floor(F.col("size") / BLOCK).alias("blocks"), F.timestamp_seconds("mtime").alias("mtime"), F.col("mode").bitwiseAND(0o7777).alias("perm"), "uid", "gid", rdev.alias("rdev"))


def link_target(entries: DataFrame, path: str) -> DataFrame:
    """The target of a symbolic link; no row for anything else."""
    return entries.where((F.col("path") == path) & (F.col("type") == "symlink")).select("symlink_target")


def attribute(name: str, column: str = "xattrs") -> Column:
    """An extended attribute's value, null where there is none."""
    return F.try_element_at(F.col(column), F.lit(name))


def attribute_names(column: str = "xattrs") -> Column:
    """Names of the extended attributes, each ended by a zero byte, in order."""
    return F.aggregate(F.array_sort(F.map_keys(column)), F.lit(""), lambda acc, n: F.concat(acc, n, F.lit("\0")))


def file_system(bundles: DataFrame) -> DataFrame:
    """Blocks of all raw data, as a file system tells its size."""
    return bundles.agg(F.floor(F.coalesce(F.sum("raw_size"), F.lit(0)) / BLOCK).alias("blocks"), F.lit(BLOCK).alias("block_size"))
