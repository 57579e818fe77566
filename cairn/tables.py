"""Written intermediate tables, and running totals and ranks over any number of partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_PER_BLOCK = 200_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    It is ``spark.checkpoint.dir``; only where that is unset, in local runs as of tests, the warehouse holds it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends at files that outlive any executor.

    The job's shuffle files go when it ends: nothing reads them once the table stands.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch_path = path
    return back


def remove_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialize` wrote, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            remove_path(table.sparkSession, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it is a plain scan of fewer: a small file then keeps all of them busy.

    A scan of more partitions, as of any large table, stays as it is, without a shuffle; so does what has shuffled already.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or "Scan parquet" not in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def running_total(df: DataFrame, group: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the same ``group`` before this one in ``order``.

    Rows are sorted into ranges and written with their range's number; sums of ranges give each range its start, a
    window within the range the rest. No task holds a group, and the one window over ranges holds a row for each.
    ``group`` and ``order`` together tell rows apart.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c) for c in [*group, *order]]
    dealt = materialize(df.withColumn("_amount", amount).repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "running-total")
    by_range = dealt.groupBy(*group, "_range").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    own = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(starts, [*group, "_range"]).withColumn(name, F.col("_start") + F.coalesce(F.sum("_amount").over(own), F.lit(0)))
    return out.drop("_amount", "_range", "_start")
