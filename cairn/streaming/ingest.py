"""Continuous ingest: files as they arrive, chunks that are new to the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cairn.operators.chunking import content_chunks
from cairn.operators.dedup import new_chunks

_INDEX = "hash string, len bigint"


def stream_chunks(contents: DataFrame, key: str, content: str, method: str = "fastcdc", size: int = 16 * 1024, hash_method: str = "blake2") -> DataFrame:
    """Chunks of a stream of contents; a map over rows, so it needs no state."""
    return content_chunks(contents, content, method, size, [key], 0, hash_method)


def distinct_chunks(chunks: DataFrame, time: str, delay: str) -> DataFrame:
    """Chunks not seen within the watermark: state holds one digest for each chunk of that time."""
    return chunks.withWatermark(time, delay).dropDuplicatesWithinWatermark(["hash"])


def ingest(spark: SparkSession, contents: DataFrame, index: str, checkpoint: str, **chunker) -> StreamingQuery:
    """Appends the digests of new chunks to the table at ``index``, batch by batch.

    A batch that runs again after a failure finds what it appended before, and appends nothing twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(index)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        known = spark.read.schema(_INDEX).parquet(index) if there else spark.createDataFrame([], _INDEX)
        new_chunks(rows, known).select("hash", F.col("len").cast("long").alias("len")).write.mode("append").parquet(index)

    chunks = stream_chunks(contents, chunker.pop("key", "path"), chunker.pop("content", "data"), **chunker)
    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
