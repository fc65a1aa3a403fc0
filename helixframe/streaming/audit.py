"""The audit log as a stream; each function works on a stream and on a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Longer than any table's span of time.
UNBOUNDED = "365000 days"


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, users and value by window and type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = timed.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    counted = grouped.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after ``gap`` without events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = timed.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return counted.select("user_id", F.col("session_window.start").alias("session_start"), "events")


def distinct(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicates(["event_id", "ts"])


def drained(spark: SparkSession, path: str, schema, build, out: str, files_at_once: int = 1000, late: str = UNBOUNDED, whole: bool = False) -> DataFrame:
    """Runs ``build`` over all files of ``path`` as a stream and returns what it wrote.

    A group's newest row wins; checkpoint and results go under ``out``.  Groups
    that can merge, as sessions do, have no newest row: with ``whole`` every
    batch writes all groups, and those of the last batch are returned.
    Files come in any order, so ``build`` is given ``late``, the time by which an event
    may be older than the newest one: the default is longer than any table's span,
    so that no event is dropped at any number of files, and all groups are held.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = build(source, late=late).writeStream.outputMode("complete" if whole else "update").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    if whole:
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.coalesce(F.lit(last), F.lit(0)))
    return rows
