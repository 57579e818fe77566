"""Integrity: references without chunks, places without bundles, sizes that disagree, contents that changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.hashes import digests
from cairn.functions.scalars import ancestors
from cairn.model import Compression
from cairn.operators.codecs import decompress


def missing_chunks(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References that the index can't place."""
    return refs.join(index.select("hash"), "hash", "left_anti")


def dangling_index(index: DataFrame, bundles: DataFrame) -> DataFrame:
    """Places in bundles that aren't there, or past a bundle's last chunk; ``fault`` says which."""
    b = bundles.select(F.col("bundle_no").alias("_no"), "chunk_count")
    joined = index.join(b, F.col("bundle_no") == F.col("_no"), "left")
    fault = F.when(F.col("_no").isNull(), "no bundle").when(F.col("chunk_no") >= F.col("chunk_count"), "no chunk")
    return joined.withColumn("fault", fault).where("fault is not null").drop("_no", "chunk_count")


def repeated_index(index: DataFrame) -> DataFrame:
    return index.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bundle_mismatch(bundles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bundles whose chunk list has another length or another sum of sizes than they say."""
    found = chunks.groupBy("bundle_no").agg(F.count(F.lit(1)).alias("found_chunks"), F.sum("len").alias("found_raw"))
    out = bundles.join(found, "bundle_no", "left").fillna(0, ["found_chunks", "found_raw"])
    return out.where((F.col("found_chunks") != F.col("chunk_count")) | (F.col("found_raw") != F.col("raw_size")))


def changed_chunks(chunks: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Chunks whose bytes have another hash than they are stored under."""
    return chunks.where(digest(F.col("data")) != F.col("hash"))


def rehashed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``found``: what each stored chunk (hash, data, codec, hash_method) hashes to now; null where it can't even be decoded."""
    names = [c for c in chunks.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, codec, method in zip(batch.column("data"), batch.column("codec"), batch.column("hash_method"), strict=True):
                try:
                    codec = codec.as_py()
                    found.append(digests(method.as_py(), [decompress(data.as_py(), codec and Compression.parse(codec))])[0])
                except Exception:  # each codec has errors of its own; any of them means damage
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.string())], names=[*names, "found"])

    schema = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in names)
    return chunks.mapInArrow(run, f"{schema}, found string")


def catalog_faults(index: DataFrame, bundles: DataFrame) -> DataFrame:
    """(fault, what): hashes and places that stand twice, bundles listed twice, chunks without a bundle and bundles without chunks."""
    twice = lambda df, keys, fault, what: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(fault).alias("fault"), what.cast("string").alias("what"))
    place = F.concat_ws("/", F.col("bundle_no").cast("string"), F.col("chunk_no").cast("string"))
    out = twice(index, ["hash"], "hash twice", F.col("hash")).union(twice(index, ["bundle_no", "chunk_no"], "place twice", place)).union(twice(bundles, ["bundle_no"], "bundle twice", F.col("bundle_no")))
    delta = catalog_delta(index.select("bundle_no").distinct(), bundles.select("bundle_no").distinct(), "bundle_no")
    return out.union(delta.select(F.when(F.col("change") == "new", "bundle not listed").otherwise("bundle without chunks"), F.col("bundle_no").cast("string")))


def misplaced(entries: DataFrame) -> DataFrame:
    """(snapshot, path) of entries below something that is no directory; ``entries`` is (snapshot, path, type, ..)."""
    others = entries.where("type <> 'directory'").select("snapshot", F.col("path").alias("_up"))
    return entries.select("snapshot", "path", F.explode(ancestors(F.col("path"))).alias("_up")).join(others, ["snapshot", "_up"], "left_semi").select("snapshot", "path").distinct()


def catalog_delta(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, change): ``new`` for what is found and not known, ``gone`` for the reverse."""
    new = found.join(known, key, "left_anti").select(key, F.lit("new").alias("change"))
    return new.union(known.join(found, key, "left_anti").select(key, F.lit("gone").alias("change")))


def repaired(entries: DataFrame, refs: DataFrame, index: DataFrame) -> DataFrame:
    """Entries as a repair leaves them: one whose content can't be read whole becomes empty, and ``modified`` says so."""
    broken = missing_chunks(refs, index).select(F.col("path").alias("_path")).distinct()
    joined = entries.join(broken, F.col("path") == F.col("_path"), "left").withColumn("modified", F.col("_path").isNotNull())
    return joined.withColumn("size", F.when(F.col("modified"), 0).otherwise(F.col("size"))).drop("_path")
