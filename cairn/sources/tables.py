"""Snapshot tables over ordinary tables: documents and pages as files, their versions, chunks and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.chunking import fixed_chunks
from cairn.operators.dedup import bundles, first_seen, pack
from cairn.tables import materialize, read_table

EPOCH = 1704067200
CHUNK = 1024
BUNDLE = 65536


def document_path():
    return F.format_string("/%s/%s/%d.txt", "source", "lang", "doc_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as file entries with their content."""
    data = F.col("text").cast("binary")
    return read_table(spark, sf_dir, "documents").select(
        document_path().alias("path"), F.lit("file").alias("type"), F.octet_length(data).cast("long").alias("size"), F.lit(420).cast("long").alias("mode"), (F.col("doc_id") % 7).alias("uid"),
        (F.col("doc_id") % 3).alias("gid"), (F.lit(EPOCH) + 60 * F.col("doc_id")).alias("mtime"), data.alias("data"), "doc_id", "source",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as file entries under their host."""
    data = F.col("html").cast("binary")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return read_table(spark, sf_dir, "pages").select(
        F.format_string("/%s/%d.html", host, "page_id").alias("path"), F.octet_length(data).cast("long").alias("size"), data.alias("data"), "page_id", "url"
    )


def snapshot(spark: SparkSession, sf_dir: str, version: int) -> DataFrame:
    """Entries of version 1, 2 or 3 of the documents: files come, go, change, or change their time only."""
    d = documents(spark, sf_dir)
    changed = F.lit(version >= 2) & (F.col("doc_id") % 7 == 0)
    touched = F.lit(version >= 3) & (F.col("doc_id") % 13 == 0)
    data = F.when(changed, F.concat("data", F.lit(b" v2"))).otherwise(F.col("data"))
    out = d.where(F.col("doc_id") % 10 != (0 if version == 1 else 1)).withColumn("data", data)
    out = out.withColumns({"size": F.octet_length("data").cast("long"), "mtime": F.col("mtime") + F.when(changed, 86400).otherwise(0) + F.when(touched, 3600).otherwise(0)})
    return out.withColumn("content_id", F.md5("data"))


def references(spark: SparkSession, sf_dir: str, size: int = CHUNK) -> DataFrame:
    """(path, doc_id, ord, offset, len, hash) of the documents in fixed-size chunks."""
    return fixed_chunks(documents(spark, sf_dir), "data", size, ["path", "doc_id"])


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks (hash, len, path, ord) with bundle_no and chunk_no, in the order of first sight, written once."""
    seen = first_seen(references(spark, sf_dir), ["path", "ord"], ["doc_id"])
    return materialize(pack(seen, ["path", "ord"], BUNDLE), "packed")


def bundle_table(placed: DataFrame) -> DataFrame:
    return bundles(placed, F.col("len") * 3 / 5).withColumn("mode", F.when(F.col("bundle_no") % 5 == 0, "meta").otherwise("data"))
