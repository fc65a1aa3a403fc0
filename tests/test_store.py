"""A pool on disk: versions under two codecs side by side, deletion and return of a name, a damaged payload."""

import uuid

import pytest
from pyspark.sql import functions as F

from helixframe.operators import audit, pool, store
from helixframe.sources import fasta
from helixframe.sources.tables import scratch

FILES = "file_id long, filename string, payload binary, created_at long"


@pytest.fixture
def path(spark):
    return scratch(spark, f"store-{uuid.uuid4().hex}")


def contents(df):
    return {(r["filename"], r["version"]): (r["status"], None if r["payload"] is None else bytes(r["payload"])) for r in df.collect()}


def test_versions_live_side_by_side(spark, path):
    store.write(path, spark.createDataFrame([(1, "a", b"one", 10), (2, "a", b"two" * 90, 20), (3, "b", b"", 5)], FILES))
    store.migrate(spark, path, spark.createDataFrame([("a",)], "filename string"), "yinyang", 2, F.lit(30))
    every = store.load(spark, path)
    assert sorted((r["filename"], r["version"], r["codec"]) for r in every.collect()) == [("a", 1, "ternary"), ("a", 2, "ternary"), ("a", 3, "yinyang"), ("b", 1, "ternary")]
    asked = every.select("filename", "version").unionByName(spark.createDataFrame([("a", 9), ("none", None)], "filename string, version int"))
    assert contents(store.read(spark, path, asked)) == {("a", 1): ("ok", b"one"), ("a", 2): ("ok", b"two" * 90), ("a", 3): ("ok", b"two" * 90), ("b", 1): ("ok", b""), ("a", 9): ("missing", None), ("none", None): ("missing", None)}


def test_deleted_names_can_return(spark, path):
    store.write(path, spark.createDataFrame([(1, "a", b"one", 10), (2, "b", b"two", 10)], FILES), parity=0)
    store.delete(spark, path, spark.createDataFrame([("a",)], "filename string"), F.lit(15))
    assert [r["filename"] for r in store.current(store.load(spark, path)).collect()] == ["b"]
    store.write(path, spark.createDataFrame([(3, "a", b"new", 20)], FILES), parity=0)
    assert contents(store.read(spark, path, spark.createDataFrame([("a", None)], "filename string, version int"))) == {("a", 1): ("ok", b"new")}
    assert store.scan_report(store.scan(spark, path, "a")).first().asDict() == {"files": 1, "healthy": 1, "corrupted": 0}


NEWEST = "filename string, version int"


def names(spark, *some):
    return spark.createDataFrame([(n,) for n in some], "filename string")


def test_a_pool_that_is_not_there_is_empty(spark, path):
    assert store.version(spark, path) == 0 and store.load(spark, path).count() == 0
    assert contents(store.read(spark, path, spark.createDataFrame([("a", None)], NEWEST))) == {("a", None): ("missing", None)}
    assert store.delete(spark, path, names(spark, "a"), F.lit(1)) is None and store.compact(spark, path) == 0


def test_migration_there_and_back(spark, path):
    store.write(path, spark.createDataFrame([(1, "a", b"some bytes" * 30, 10)], FILES))
    store.migrate(spark, path, names(spark, "a"), "yinyang", 2, F.lit(20))
    store.migrate(spark, path, names(spark, "a"), "ternary", 0, F.lit(30))
    every = store.load(spark, path)
    assert [(r["version"], r["codec"], r["redundancy"]) for r in every.orderBy("version").collect()] == [(1, "ternary", 4), (2, "yinyang", 2), (3, "ternary", 0)]
    assert contents(store.read(spark, path, every.select("filename", "version"))) == {("a", v): ("ok", b"some bytes" * 30) for v in (1, 2, 3)}


def test_a_retry_writes_once_and_two_writes_are_two_versions(spark, path):
    files = spark.createDataFrame([(1, "a", b"bytes", 10)], FILES)
    first = store.write(path, files, request="r1")
    assert store.write(path, files, request="r1") == first and store.version(spark, path) == 1
    store.write(path, files, parity=2)
    every = store.load(spark, path)
    assert contents(store.read(spark, path, every.select("filename", "version"))) == {("a", 1): ("ok", b"bytes"), ("a", 2): ("ok", b"bytes")}
    with pytest.raises(ValueError):
        store.write(path, files.unionByName(files))


def test_of_two_writers_one_is_refused(spark, path):
    files = spark.createDataFrame([(1, "a", b"bytes", 10)], FILES)
    store.write(path, files, expected=0)
    with pytest.raises(store.Refused):
        store.write(path, files.withColumn("payload", F.lit(b"other")), expected=0)
    with pytest.raises(store.Refused):
        store.delete(spark, path, names(spark, "a"), F.lit(20), expected=0)
    assert contents(store.read(spark, path, spark.createDataFrame([("a", None)], NEWEST))) == {("a", 1): ("ok", b"bytes")}
    # an entry that is cut off counts for nothing, and its number isn't used again
    open(f"{path.removeprefix('file://')}/log/000000000002.json", "w").write('{"number": 2, "kind": "wri')
    assert store.load(spark, path).count() == 1 and store.version(spark, path) == 2
    store.write(path, files)
    assert store.load(spark, path).count() == 2


def test_room_is_checked_before_a_write(spark, path):
    files = spark.createDataFrame([(1, "a", b"x" * 89, 10)], FILES)
    store.write(path, files, parity=1, capacity=4 * 162 + 648)
    with pytest.raises(store.Refused):
        store.write(path, files, parity=0, capacity=4 * 162 + 648 + 4 * 162 - 1)
    assert store.load(spark, path).count() == 1


@pytest.mark.parametrize("lost,status", [("source_index in (0, 2)", "ok"), ("is_parity", "ok"), ("source_index in (1, 3, 5, 8)", "ok"), ("source_index < 5", "missing"), ("true", "lost")])
def test_lost_strands_come_back_from_parity(spark, path, lost, status):
    from helixframe.plans.store import _harm

    text = bytes(range(150))
    store.write(path, spark.createDataFrame([(1, "a", text, 10), (2, "b", text, 10)], FILES))
    _harm(spark, path, F.expr(f"file_id = 1 and ({lost})"))
    assert contents(store.read(spark, path, spark.createDataFrame([("a", None), ("b", None)], NEWEST))) == {("a", 1): (status, text if status == "ok" else None), ("b", 1): ("ok", text)}
    assert store.scan_report(store.scan(spark, path)).first()[:] == (2, 2 if status == "ok" else 1, 0 if status == "ok" else 1)


def test_compaction_touches_only_folders_that_hold_dead_strands(spark, path):
    import glob

    text = bytes(range(200))
    store.write(path, spark.createDataFrame([(i, f"f{i}", text, 10) for i in range(6)], FILES))
    store.write(path, spark.createDataFrame([(9, "g", text, 10)], FILES), "yinyang")
    store.delete(spark, path, names(spark, "f2"), F.lit(20))
    here = lambda: set(glob.glob(f"{path.removeprefix('file://')}/strands/gen=*/codec=*/bucket=*/*.parquet"))
    before, dead = here(), store.all_strands(spark, path).where("file_id = 2").count()
    place = store.all_strands(spark, path).where("file_id = 2").select("bucket").first()[0]
    assert store.compact(spark, path) == dead > 0 and store.compact(spark, path) == 0
    gone = before - here()
    assert gone and all(f"codec=ternary/bucket={place}/" in f for f in gone) and store.all_strands(spark, path).where("file_id = 2").count() == 0
    every = store.load(spark, path)
    assert {r["status"] for r in store.read(spark, path, every.select("filename", "version")).collect()} == {"ok"} and every.count() == 6


def test_log_is_appended_and_bad_lines_are_skipped(spark, path):
    done = spark.createDataFrame([(7, 100, True), (8, 200, False)], "file_id long, created_at long, success boolean")
    store.record(path, done, "write", F.lit(3))
    store.record(path, done.limit(1), "delete", F.lit(4))
    spark.createDataFrame([("not an event",)], "value string").write.mode("append").text(f"{path}/audit")
    log = fasta.read_audit(spark, f"{path}/audit").where("operation is not null")
    assert {(r["operation"], r["success"]): r["events"] for r in audit.counts(log).collect()} == {("write", True): 1, ("write", False): 1, ("delete", True): 1}


def test_sealed_payloads_open_with_their_secret(spark):
    box = spark.range(1).select(store.sealed(F.lit(b"abc"), F.lit("s"), F.lit("n")).alias("box"))
    row = box.select(store.opened(F.col("box"), F.lit("s")).alias("right"), store.opened(F.col("box"), F.lit("t")).alias("wrong"), (F.col("box.body") != F.col("box.wrapped")).alias("differ")).first()
    assert bytes(row["right"]) == b"abc" and row["wrong"] is None and row["differ"]


def test_metrics_as_text():
    text = audit.exposition({"files": 2.0}, [("write", True, 3), ("read", False, 1)])
    assert text == '# TYPE pool_files gauge\npool_files 2\n# TYPE pool_audit_events_total counter\npool_audit_events_total{operation="read",success="false"} 1\npool_audit_events_total{operation="write",success="true"} 3\n'


def test_euclidean_distance(spark):
    from helixframe.functions import bits

    row = spark.range(1).select(bits.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d")).first()
    assert row["d"] == 5


def test_keys_are_made_in_as_many_tasks_as_there_are_cores(spark, path):
    from helixframe.operators import keys

    keys.add(spark, path, spark.range(2000).coalesce(1).withColumnRenamed("id", "file_id"), "s")
    held = spark.read.parquet(f"{path}/keys")
    assert held.count() == 2000 and len(held.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert keys.opened(spark, path, "s").count() == 2000 and keys.opened(spark, path, "t").count() == 0


def test_payloads_are_dealt_out_by_bucket_and_their_strands_are_not(spark, path):
    files = spark.createDataFrame([(i, f"f{i}", bytearray(b"abc" * (1 + i)), i) for i in range(40)], "file_id long, filename string, payload binary, created_at long")
    made = pool.strands(store.dealt(files), "ternary", 4, sized=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # the plan's lines go from the result to the input
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") < plan.index("Exchange")
    store.write(path, files)
    held = store.all_strands(spark, path)
    # a folder's strands come from one task, each stripe in one piece
    lying = spark.read.schema(store.STRANDS).parquet(f"{path}/strands").withColumn("file", F.input_file_name())
    assert lying.groupBy("bucket").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0
    assert held.where("data_strands is null or parity <> 4").count() == 0
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
