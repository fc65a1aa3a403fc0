"""Running totals over a whole table, or large groups of it, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch


def running_total(rows: DataFrame, value: str, order: list[str], by: list[str], name: str = "running") -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row, in ``order`` within ``by``.

    Rows are ranged by (by, order); a task sums its own range, and what stands
    before a range comes from one row for each range and group.  Rows equal in
    ``order`` are summed in an order that is their own.  The ranged rows are
    written once, so that both see the same ranges after any retry.
    """
    path = scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum(value).over(inside))
    parts = ranged.groupBy("_range", *by).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    same: Column = summed["_range"] == before["_range"]
    for b in by:
        same = same & summed[b].eqNullSafe(before[b])
    joined = summed.join(before, same).select(*(summed[c] for c in rows.columns), (F.col("_inside") + F.col("_before")).alias(name))
    return joined
