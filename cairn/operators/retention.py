"""Which snapshots a calendar of retention keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _period(ts: Column, unit: str) -> Column:
    """A period's number, greater for later ones, in the session's time zone."""
    return {
        "daily": F.datediff(ts, F.lit("1970-01-01")),
        "weekly": F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts),
        "monthly": F.year(ts) * 100 + F.month(ts),
        "yearly": F.year(ts),
    }[unit].cast("long")


def keep(snapshots: DataFrame, ts: str = "ts", name: str = "snapshot", prefix: str = "", **counts: int) -> DataFrame:
    """``snapshots`` with a flag for each unit and ``keep``: the newest of each of the latest N periods that have any.

    ``counts`` are daily, weekly, monthly and yearly. Ties on the time go to the greatest name. Newest ones are found by
    aggregation (one row a period), the latest N periods among them by top-k, so no task sorts all snapshots.
    """
    if not any(counts.values()):
        raise ValueError("keep at least one period: everything would be removed")
    out = snapshots.where(F.startswith(name, F.lit(prefix))) if prefix else snapshots
    flags = []
    for unit, n in counts.items():
        if not n:
            continue
        flag = f"keep_{unit}"
        newest = out.withColumn("_p", _period(F.col(ts), unit)).groupBy("_p").agg(F.max(F.struct(ts, name)).alias("at"))
        kept = newest.orderBy(F.col("_p").desc()).limit(n).select(F.col(f"at.{name}").alias("_name"), F.lit(True).alias(flag))
        out = out.join(kept, F.col(name) == F.col("_name"), "left").drop("_name").withColumn(flag, F.coalesce(flag, F.lit(False)))
        flags.append(F.col(flag))
    kept = flags[0]
    for f in flags[1:]:
        kept = kept | f
    return out.withColumn("keep", kept)


def removable(snapshots: DataFrame, **kw) -> DataFrame:
    return keep(snapshots, **kw).where("not keep")


def marks(snapshots: DataFrame, ts: str, name: str, unit: str) -> DataFrame:
    """Each snapshot with its period and its place in it, the newest first."""
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.col(ts).desc(), F.col(name).desc()))
    return snapshots.withColumn("period", _period(F.col(ts), unit)).withColumn("place", place)
