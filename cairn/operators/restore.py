"""Putting contents together again, whole or by range."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.model import decode_chunk_list, encode_chunk_list


def reassemble(refs: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """(by, data): the contents that the references describe. ``chunks`` has a row for each hash.

    A content is a row, so its chunks meet in one task as they must; many references to one chunk are spread by the join.
    """
    joined = refs.join(chunks.select("hash", "data"), "hash")
    parts = F.array_sort(F.collect_list(F.struct("ord", "data")))
    return joined.groupBy(*by).agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["data"])).alias("data"))


def overlapping(refs: DataFrame, by: list[str], start: int, size: int) -> DataFrame:
    """The references that ``size`` bytes from ``start`` of each content overlap, with ``_from``, where each begins."""
    before = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = refs.withColumn("_from", F.coalesce(F.sum("len").over(before), F.lit(0)))
    return placed.where((F.col("_from") < start + size) & (F.col("_from") + F.col("len") > start))


def cut_range(wanted: DataFrame, chunks: DataFrame, by: list[str], start: int, size: int) -> DataFrame:
    """(by, data): the bytes of the range from the references of :func:`overlapping`."""
    skip = F.greatest(F.lit(start) - F.col("_from"), F.lit(0))
    take = F.least(F.col("len"), F.lit(start + size) - F.col("_from")) - skip
    cut = wanted.join(chunks.select("hash", "data"), "hash").withColumn("data", F.substring("data", (skip + 1).cast("int"), take.cast("int")))
    parts = F.array_sort(F.collect_list(F.struct("ord", "data")))
    return cut.groupBy(*by).agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["data"])).alias("data"))


def read_range(refs: DataFrame, chunks: DataFrame, by: list[str], start: int, size: int) -> DataFrame:
    """(by, data): ``size`` bytes from ``start`` of each content, of which only the chunks that overlap are read."""
    return cut_range(overlapping(refs, by, start, size), chunks, by, start, size)


def encoded_lists(refs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, list): the chunk list of each content in ``refs`` (keys, ord, hash, len), as bytes in the order of ord."""
    lists = refs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "hash", "len"))).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encode_chunk_list([(c["hash"], c["len"]) for c in row]) for row in batch.column("list").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(data, pa.binary())], names=[*keys, "list"])

    return lists.mapInArrow(run, lists.drop("list").schema.add("list", "binary"))


def decoded_lists(lists: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, hash, len) of chunk lists (keys, list); the reverse of :func:`encoded_lists`."""
    kinds = lists.select(*keys).schema.add("ord", "integer").add("hash", "string").add("len", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_chunk_list(data) for data in batch.column("list").to_pylist()]
            at = pa.array([i for i, row in enumerate(found) for _ in row], pa.int64())
            columns = [pa.array([n for row in found for n in range(len(row))], pa.int32()), pa.array([h for row in found for h, _ in row], pa.string()), pa.array([n for row in found for _, n in row], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns], names=kinds.names)

    return lists.select(*keys, "list").mapInArrow(run, kinds)
