"""The audit log and the metrics made from it and from the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts(log: DataFrame) -> DataFrame:
    """Events by (operation, success)."""
    return log.groupBy("operation", "success").agg(F.count(F.lit(1)).alias("events"))


def tail(log: DataFrame, n: int, by: str) -> DataFrame:
    """The last n events of each ``by``, newest first; only n rows a key leave a task.

    Each task keeps its own n newest of a key, so a key with most of the log
    doesn't gather in one task.
    """
    newest = (F.desc("ts"), F.desc("event_id"))
    own = log.withColumn("_part", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    first = own.withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*newest))).where(F.col("_rank") <= n)
    return first.withColumn("age", F.row_number().over(Window.partitionBy(by).orderBy(*newest))).where(F.col("age") <= n).drop("_part", "_rank")


def exposition(gauges: dict[str, float], events: list[tuple[str, bool, int]]) -> str:
    """Gauges and event counts as Prometheus text."""
    lines = []
    for name, value in gauges.items():
        lines += [f"# TYPE pool_{name} gauge", f"pool_{name} {value:g}"]
    lines.append("# TYPE pool_audit_events_total counter")
    lines += [f'pool_audit_events_total{{operation="{o}",success="{str(s).lower()}"}} {n}' for o, s, n in sorted(events)]
    return "\n".join(lines) + "\n"
