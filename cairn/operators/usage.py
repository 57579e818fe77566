"""Storage statistics, usage of bundles, and what compaction would gain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def info(bundles: DataFrame) -> DataFrame:
    """Counts, sizes and ratios of all bundles."""
    sums = bundles.agg(F.count(F.lit(1)).alias("bundles"), F.sum("encoded_size").alias("encoded_size"), F.sum("raw_size").alias("raw_size"), F.sum("chunk_count").alias("chunks"))
    ratio = F.try_divide(F.col("encoded_size").cast("double"), F.col("raw_size").cast("double"))
    return sums.withColumns({"compression_ratio": ratio, "avg_chunk_size": F.try_divide(F.col("raw_size").cast("double"), F.col("chunks").cast("double"))})


def value_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """min, max, avg, sample deviation (0 for less than two) and counts by distance from the average in deviations.

    Buckets: below two deviations, below one, within one, within two, above. Statistics join back by group: one row each.
    """
    stats = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"), F.count(F.lit(1)).alias("n"))
    if by:
        joined = df.select(*by, value).join(stats, by)
    else:
        row = stats.first()
        joined = df.select(value).withColumns({c: F.lit(row[c]).cast(stats.schema[c].dataType) for c in ("min", "max", "avg", "stddev", "n")})
    v, mean, dev, alone = F.col(value), F.col("avg"), F.col("stddev"), F.col("n") < 2
    bucket = F.when(alone, "m").when(v < mean - 2 * dev, "xs").when(v < mean - dev, "s").when(v < mean + dev, "m").when(v < mean + 2 * dev, "l").otherwise("xl")
    counts = [F.count_if(F.col("_b") == b).alias(f"count_{b}") for b in ("xs", "s", "m", "l", "xl")]
    return joined.withColumn("_b", bucket).groupBy(*by).agg(*(F.first(c).alias(c) for c in ("min", "max", "avg", "stddev", "n")), *counts)


def bundle_statistics(bundles: DataFrame) -> DataFrame:
    """:func:`value_stats` of raw and encoded size and number of chunks, for each mode and, with a null mode, for all bundles."""
    values = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in ("raw_size", "encoded_size", "chunk_count")))
    modes = F.array(F.col("mode"), F.lit(None).cast("string"))
    rows = bundles.select(F.explode(modes).alias("mode"), values.alias("all")).select(F.coalesce("mode", F.lit("")).alias("mode"), F.explode("all").alias("m")).select("mode", "m.*")
    return value_stats(rows, "v", ["mode", "measure"]).withColumn("mode", F.nullif("mode", F.lit("")))


def method_counts(bundles: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, method, n, share): how many bundles use each method of each kind."""
    rows = bundles.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("method")) for c in columns))).alias("m")).select("m.kind", "m.method")
    counts = rows.groupBy("kind", "method").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("_total"))
    return counts.join(totals, "kind").withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def usage(refs: DataFrame, index: DataFrame, bundles: DataFrame) -> DataFrame:
    """Per bundle the raw bytes that live references use, the ratio, and used and unused encoded bytes; unused bundles too.

    ``refs`` are the chunks that some snapshot reaches. A chunk counts once, however many references it has.
    """
    live = refs.select("hash").distinct().join(index, "hash")
    used = live.groupBy("bundle_no").agg(F.sum("len").alias("used_raw"), F.count(F.lit(1)).alias("used_chunks"))
    out = bundles.join(used, "bundle_no", "left").withColumns({"used_raw": F.coalesce("used_raw", F.lit(0)), "used_chunks": F.coalesce("used_chunks", F.lit(0))})
    out = out.withColumn("ratio", F.coalesce(F.try_divide(F.col("used_raw").cast("double"), F.col("raw_size").cast("double")), F.lit(0.0)))
    return out.withColumns({"used_size": F.floor(F.col("ratio") * F.col("encoded_size")).cast("long"), "unused_size": F.floor((1 - F.col("ratio")) * F.col("encoded_size")).cast("long")})


def reclaim_histogram(used: DataFrame, steps: int = 10) -> DataFrame:
    """For each tenth i: how much would be freed and how much rewritten by compacting bundles used at most so far.

    A bundle is counted once, at the first step that takes it; running sums over the steps do the rest.
    """
    spark = used.sparkSession
    step = F.ceil(F.round(F.col("ratio") * steps, 9)).cast("int")
    by_step = used.groupBy(step.alias("step")).agg(F.sum("unused_size").alias("u"), F.sum("used_size").alias("w"), F.count(F.lit(1)).alias("b"))
    grid = spark.range(steps + 1).select(F.col("id").cast("int").alias("step"))
    so_far = Window.orderBy("step")
    out = grid.join(by_step, "step", "left")
    return out.select("step", *(F.coalesce(F.sum(a).over(so_far), F.lit(0)).alias(b) for a, b in (("b", "bundles"), ("u", "reclaim"), ("w", "rewrite"))))


def vacuum_plan(used: DataFrame, ratio: float, bundle_size: int, combine: bool = True) -> DataFrame:
    """Adds ``rewrite`` and why: bundles used at most ``ratio``, and with ``combine`` small ones where a mode has two of them."""
    out = used.withColumn("by_ratio", F.col("ratio") <= ratio)
    if not combine:
        return out.withColumns({"by_size": F.lit(False), "rewrite": F.col("by_ratio")})
    small = (F.col("encoded_size") * 4 < bundle_size) & ~F.col("by_ratio")
    counts = out.groupBy("mode").agg(F.count_if(small).alias("_small"))
    out = out.join(counts, "mode").withColumn("by_size", small & (F.col("_small") >= 2)).drop("_small")
    return out.withColumn("rewrite", F.col("by_ratio") | F.col("by_size"))


def vacuum_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(
        F.count_if("rewrite").alias("bundles"), F.sum("encoded_size").alias("total"), F.sum("used_size").alias("used"),
        F.coalesce(F.sum(F.when(F.col("rewrite"), F.col("unused_size"))), F.lit(0)).alias("reclaim"), F.coalesce(F.sum(F.when(F.col("rewrite"), F.col("used_size"))), F.lit(0)).alias("rewritten"),
    )
