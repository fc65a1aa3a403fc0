"""Streams over many files, whatever their order."""

from pyspark.sql import functions as F

from helixframe.sources.tables import scratch
from helixframe.streaming import audit as stream


def test_drained_stream_counts_events_of_unordered_files(spark):
    days = [9, 2, 30, 1, 17]
    events = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "event_id long, day int").select("event_id", F.timestamp_seconds(F.col("day") * 86400).alias("ts"), F.lit("a").alias("event_type"), F.lit(1.5).alias("value"))
    path = scratch(spark, "unordered")
    for i in range(len(days)):  # a file each, the newest event not last
        events.where(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(path)
    rows = stream.drained(spark, path, events.schema, stream.windowed, scratch(spark, "drained"), files_at_once=1)
    newest = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("n"))
    assert [tuple(r["n"]) for r in newest.collect()] == [(1, 1.5)] * len(days)


def test_streamed_sessions_merge_over_files(spark):
    minutes = [0, 40, 20, 200, 215, 59]  # in the order of arrival: the third joins the first two
    events = spark.createDataFrame([(i, m) for i, m in enumerate(minutes)], "event_id long, m int").select("event_id", F.timestamp_seconds(F.col("m") * 60).alias("ts"), F.lit(7).alias("user_id"))
    path = scratch(spark, "arriving")
    for i in range(len(minutes)):
        events.where(F.col("event_id") == i).coalesce(1).write.mode("append").parquet(path)
    rows = stream.drained(spark, path, events.schema, stream.sessions, scratch(spark, "drained"), files_at_once=1, whole=True)
    assert sorted(r["events"] for r in rows.collect()) == [2, 4]
    assert {tuple(r) for r in rows.drop("batch").collect()} == {tuple(r) for r in stream.sessions(events).collect()}


def test_streamed_events_are_distinct(spark):
    events = spark.createDataFrame([(1, 5), (2, 5), (1, 5), (1, 6), (3, 9), (3, 9)], "event_id long, s int").select("event_id", F.timestamp_seconds("s").alias("ts"))
    path = scratch(spark, "repeated")
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(path)
    rows = stream.drained(spark, path, events.schema, stream.distinct, scratch(spark, "drained"), files_at_once=1)
    assert sorted(r["event_id"] for r in rows.collect()) == [1, 1, 2, 3]
