"""What operators of this subpackage share: words, keys of rows, and offsets of blocks; and the engine's written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.tables import materialize, read_table, release, running_total, scratch_root

__all__ = ["WORD", "keyed", "materialize", "read_table", "release", "row_hashes", "running_offset", "running_total", "scratch_root", "text_or_empty"]

#: A word, wherever an operator counts words: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def row_hashes() -> list[Column]:
    """(u, v), 128 bits of hash that rows of equal doc_id and text share, and other rows don't."""
    text = text_or_empty()
    return [F.xxhash64(F.lit(1), "doc_id", text).alias("u"), F.xxhash64(F.lit(2), text, "doc_id").alias("v")]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with :func:`row_hashes`."""
    return docs.select("*", *row_hashes())


def running_offset(df: DataFrame, group: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the same ``group`` that come earlier in ``order``.

    ``df`` is one row per (group, order) - counts of blocks, never of documents - so that a window over it stays small.
    """
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)))
