"""A pool that lasts: its catalog, strands and log as tables under one path.

What a verb makes is written first, under a name of its own, and counts from the
moment its entry stands in the pool's log: strands, then catalog, then the entry.
An entry is a small numbered file that is created only if it isn't there, so of
two writers that expect the same number one is refused, and what a failed attempt
has written is never read.  A verb that is tried again under the same request
finds its entry and does nothing.

State is added to: writing appends versions, deleting a tombstone, and what is
current is an aggregate of the catalog.  Strands belong to the write that made
them, so one content may be stored any number of times under any codecs.  They
lie in folders by codec and by bucket of their file's hash; only ``compact``
replaces folders, those with strands that no version reaches.  Requests are
tables too: any number of versions is read by joins, and lost strands come back
from parity.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..sources.fasta import append_audit
from ..sources.tables import written
from . import codecs, pool
from . import parity as stripes

BUCKETS = 64
#: Versions, at most, whose names are broadcast, and folders that a task writes without sorting its strands first.
FEW, FOLDERS = 100_000, 8
#: An entry of the log: its number, the write it makes count, the request it answers, and for a compaction the folders it replaces.
ENTRY = "number long, kind string, write string, request string, removed long, dropped array<struct<gen:string,codec:string,bucket:int>>"
STRANDS = "write string, file_id long, stripe int, source_index int, is_parity boolean, seq string, data_strands int, parity int, gen string, codec string, bucket int"
CATALOG = (
    "file_id long, filename string, created_at long, size long, content_hash string, codec string, profile string, redundancy int, data_strands long, parity_strands long, archive_id string, deleted boolean, write string"
)


class Refused(Exception):
    """Another writer was first, or the pool has no room."""


def bucket(file_id: Column) -> Column:
    return F.pmod(F.xxhash64(file_id), F.lit(BUCKETS)).cast("int")


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> int:
    """The number of the pool's last entry, whole or not; 0 for a pool that isn't there."""
    fs, at = _place(spark, f"{path}/log")
    if not fs.exists(at):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)


def log(spark: SparkSession, path: str) -> DataFrame:
    """The pool's whole entries."""
    if not version(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(f"{path}/log").where("number is not null and write is not null")


def commit(spark: SparkSession, path: str, kind: str, write: str, request: str | None = None, expected: int | None = None, removed: int = 0, dropped: list[dict] | None = None) -> int:
    """Makes a write count; its number.  With ``expected``, only if the pool's last entry has that number, else ``Refused``."""
    at = version(spark, path) if expected is None else expected
    while True:
        entry = {"number": at + 1, "kind": kind, "write": write, "request": request, "removed": removed, "dropped": dropped or []}
        fs, file = _place(spark, f"{path}/log/{at + 1:012d}.json")
        try:
            out = fs.create(file, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception) + str(e.java_exception.getClass()):
                raise
            if expected is not None:
                raise Refused(f"the pool is past entry {expected}") from None
            at += 1
            continue
        out.write(bytearray(json.dumps(entry).encode() + b"\n"))
        out.close()
        return at + 1


def answered(spark: SparkSession, path: str, request: str | None) -> str | None:
    """The write that answered a request before."""
    if request is None:
        return None
    row = log(spark, path).where(F.col("request") == request).select("write").first()
    return row and row["write"]


def write(path: str, files: DataFrame, codec: str = "ternary", parity: int = pool.PARITY, request: str | None = None, expected: int | None = None, capacity: int | None = None, user: Column | None = None) -> str:
    """Appends ``files`` (file_id, filename, payload, created_at) as new versions, with their strands; the name of the write.

    ``request`` names the attempt, so that a retry writes once; ``expected`` is
    the pool's version that the writer has seen; ``capacity`` is the number of
    nucleotides that the pool's versions may have; ``user`` is noted in the audit
    log.  A file_id stands for one row of ``files``.
    """
    spark = files.sparkSession
    if before := answered(spark, path, request):
        return before
    if files.groupBy("file_id").count().where("count > 1").head(1):
        raise ValueError("a file_id stands for one row")
    name = f"w{uuid.uuid4().hex}"
    entries = pool.catalog(files, codec, parity).withColumn("deleted", F.lit(False)).withColumn("file_id", F.col("file_id").cast("long"))
    if capacity is not None:
        size = lambda rows: rows.agg(F.sum(pool.nucleotides())).first()[0] or 0
        if size(load(spark, path)) + size(entries) > capacity:
            raise Refused("the pool has no room for these files")
    made = pool.strands(dealt(files.withColumn("file_id", F.col("file_id").cast("long"))), codec, parity, sized=True)
    made = made.withColumns({"write": F.lit(name), "bucket": bucket(F.col("file_id")), "codec": F.lit(codec), "parity": F.lit(parity)})
    put(made, f"{path}/strands/gen={name}", "codec", "bucket")
    entries.write.parquet(f"{path}/catalog/write={name}")
    commit(spark, path, "write", name, request, expected)
    if user is not None:
        record(path, entries.select("file_id", "created_at", F.lit(True).alias("success")), "write", user)
    return name


def dealt(files: DataFrame) -> DataFrame:
    """``files`` by bucket, so that payloads are shuffled and not their strands, which are many times as large; a bucket is as many tasks as there are to spare."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    part = F.pmod(F.shiftright(F.xxhash64("file_id"), 16), F.lit(max(1, n // BUCKETS)))
    return files.repartition(n, bucket(F.col("file_id")), part)


def put(strands: DataFrame, path: str, *folders: str) -> None:
    """Writes strands by folder as they come: a file for each folder that a task has strands of, and no sort, which would keep a copy of them all."""
    conf, name = strands.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, FOLDERS)
    try:
        strands.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    finally:
        conf.set(name, before)


def delete(spark: SparkSession, path: str, names: DataFrame, at: Column, request: str | None = None, expected: int | None = None, user: Column | None = None) -> str | None:
    """Appends a tombstone for each current file of ``names`` (filename) at the time ``at``; the name of the write, none for a pool that isn't there."""
    if not version(spark, path):
        return None
    if before := answered(spark, path, request):
        return before
    name = f"w{uuid.uuid4().hex}"
    gone = current(load(spark, path)).join(names.select("filename").distinct(), "filename", "left_semi").drop("version", "write")
    gone = gone.withColumns({"deleted": F.lit(True), "created_at": at.cast("long")})
    gone.write.parquet(f"{path}/catalog/write={name}")
    commit(spark, path, "delete", name, request, expected)
    if user is not None:
        done = spark.read.parquet(f"{path}/catalog/write={name}")
        record(path, done.select("file_id", "created_at", F.lit(True).alias("success")), "delete", user)
    return name


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the catalog that counts, tombstones too."""
    entries = log(spark, path).where("kind in ('write', 'delete')").select("write")
    if not version(spark, path) or not entries.head(1):
        return spark.createDataFrame([], CATALOG)
    # as many rows as there were writes
    return spark.read.schema(CATALOG).parquet(f"{path}/catalog").join(F.broadcast(entries), "write", "left_semi")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The catalog's versions that no later tombstone covers, numbered from 1 by age in each filename; none for a pool that isn't there."""
    rows = catalog(spark, path)
    ends = rows.where("deleted").groupBy("filename").agg(F.max("created_at").alias("ended"))
    alive = rows.where(~F.col("deleted")).join(ends, "filename", "left").where(F.col("ended").isNull() | (F.col("created_at") > F.col("ended"))).drop("ended", "deleted")
    return alive.withColumn("version", F.row_number().over(Window.partitionBy("filename").orderBy("created_at", "file_id", "write")))


def current(catalog: DataFrame) -> DataFrame:
    """The newest version of each filename; only one row a name leaves a task."""
    newest = catalog.groupBy("filename").agg(F.max_by(F.struct(*(c for c in catalog.columns if c != "filename")), F.struct("created_at", "file_id", "write")).alias("row"))
    return newest.select("filename", "row.*")


def all_strands(spark: SparkSession, path: str) -> DataFrame:
    """Strands in the folders that count: write, file_id, stripe, source_index, is_parity, seq, gen, codec, bucket."""
    entries = log(spark, path)
    # as many rows as there were writes, and as there were folders replaced
    gens = entries.where("kind in ('write', 'compact')").select(F.col("write").alias("gen"))
    dropped = entries.select(F.explode("dropped").alias("d")).select("d.*")
    return spark.read.schema(STRANDS).parquet(f"{path}/strands").join(F.broadcast(gens), "gen", "left_semi").join(F.broadcast(dropped), ["gen", "codec", "bucket"], "left_anti")


def strands(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The strands of the versions in ``wanted`` (write, file_id, codec)."""
    keys = wanted.select("write", "file_id", "codec", bucket(F.col("file_id")).alias("bucket")).distinct()
    return all_strands(spark, path).join(keys, ["codec", "bucket", "write", "file_id"], "left_semi")


def read(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Payloads of the requested versions (filename, version; null for the newest).

    One row a request: filename, version, file_id, payload, status (``ok``,
    ``missing`` for a version that isn't there, or what failed), mended (strands
    that parity gave).  As many strands of a stripe may be lost as it has parity
    strands.  A payload counts only if its hash is the catalog's.
    """
    known = load(spark, path)
    newest = known.groupBy("filename").agg(F.max("version").alias("last"))
    asked = requests.join(newest, "filename", "left").select("filename", F.coalesce("version", "last").alias("version"))
    found = written(asked.join(known, ["filename", "version"], "left"), "found")
    key = F.struct("write", "file_id")
    decoded = None
    # a handful of codecs, each with the most parity strands that a stripe has
    for codec, most, n in found.where("size > 0").groupBy("codec").agg(F.max("redundancy"), F.count(F.lit(1))).collect():
        mine = found.where((F.col("codec") == codec) & (F.col("size") > 0)).select("write", "file_id", "codec", bucket(F.col("file_id")).alias("bucket"))
        # strands aren't shuffled: few versions pick theirs; of many, what their writes hold is opened where it lies, and picked by file, as payloads are a fraction of their strands
        names = ["codec", "bucket", "write", "file_id"] if n <= FEW else ["codec", "write"]
        held = all_strands(spark, path).where(F.col("codec") == codec).join(F.broadcast(mine.select(*names).distinct()), names, "left_semi")
        data, made = stripes.mended(held.select(key.alias("file_id"), "stripe", "source_index", "is_parity", "seq", "data_strands", "parity"), most)
        out = codecs.decode(data if made is None else data.unionByName(made), codec)
        # strands are counted only where some were lost
        out = out.withColumn("mended", F.lit(0).cast("long")) if made is None else out.join(made.groupBy("file_id").agg(F.count(F.lit(1)).alias("mended")), "file_id", "left")
        out = out.withColumnRenamed("file_id", "entry")
        decoded = out if decoded is None else decoded.unionByName(out)
    if decoded is None:
        decoded = spark.createDataFrame([], "entry struct<write:string,file_id:long>, payload binary, status string, mended long")
    right = bits.content_hash(F.col("payload")) == F.col("content_hash")
    empty = F.col("size") == 0
    state = F.when(F.col("file_id").isNull(), "missing").when(empty, "ok").when(F.col("status").isNull(), "lost").when(F.col("status") != "ok", F.col("status")).when(right, "ok").otherwise("hash")
    whole = found.withColumn("entry", key).join(decoded, "entry", "left")
    return whole.select("filename", "version", "file_id", F.when(empty, F.lit(b"")).when(right, F.col("payload")).alias("payload"), state.alias("status"), F.coalesce("mended", F.lit(0)).alias("mended"))


def migrate(spark: SparkSession, path: str, names: DataFrame, codec: str, parity: int, at: Column, request: str | None = None, expected: int | None = None) -> str | None:
    """Reads the newest version of each named file and writes it again, as a version under another codec at the time ``at``; files that have that codec stay."""
    if before := answered(spark, path, request):
        return before
    newest = current(load(spark, path)).where(F.col("codec") != codec).join(names.select("filename").distinct(), "filename", "left_semi")
    back = read(spark, path, newest.select("filename", F.lit(None).cast("int").alias("version"))).where("status = 'ok'")
    # a write looks at its files more than once
    back = written(back.select("file_id", "filename", "payload"), "back")
    return write(path, back.select("file_id", "filename", "payload", at.cast("long").alias("created_at")), codec, parity, request, expected)


def compact(spark: SparkSession, path: str) -> int:
    """Removes the strands that no version reaches; how many.

    Folders that hold such strands are rewritten without them, under the
    compaction's own name, and go when its entry stands; other folders aren't
    touched.  Refused if another verb is faster.
    """
    seen = version(spark, path)
    if not seen:
        return 0
    live = load(spark, path).select("write", "file_id").distinct().withColumn("live", F.lit(True))
    marked = all_strands(spark, path).join(live, ["write", "file_id"], "left")
    folders = marked.groupBy("gen", "codec", "bucket").agg(F.count_if(F.col("live").isNull()).alias("dead")).where("dead > 0")
    # a row a folder: names, not strands
    touched = folders.collect()
    if not touched:
        return 0
    removed, name = sum(r["dead"] for r in touched), f"w{uuid.uuid4().hex}"
    dropped = [{"gen": r["gen"], "codec": r["codec"], "bucket": r["bucket"]} for r in touched]
    place = F.broadcast(spark.createDataFrame([(d["gen"], d["codec"], d["bucket"]) for d in dropped], "gen string, codec string, bucket int"))
    kept = marked.where("live").join(place, ["gen", "codec", "bucket"], "left_semi").drop("live", "gen")
    # whole stripes in order, few files a folder
    kept = kept.repartition(BUCKETS, "bucket").sortWithinPartitions("codec", "bucket", "write", "file_id", "stripe", "source_index")
    put(kept, f"{path}/strands/gen={name}", "codec", "bucket")
    commit(spark, path, "compact", name, expected=seen, removed=removed, dropped=dropped)
    for d in dropped:
        fs, at = _place(spark, f"{path}/strands/gen={d['gen']}/codec={d['codec']}/bucket={d['bucket']}")
        fs.delete(at, True)
    return removed


def scan(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Whether each current file whose name starts with ``prefix`` can be read: filename, status, mended (strands that only parity has)."""
    names = current(load(spark, path)).where(F.col("filename").startswith(prefix))
    return read(spark, path, names.select("filename", F.lit(None).cast("int").alias("version"))).select("filename", "status", "mended")


def scan_report(scanned: DataFrame) -> DataFrame:
    """Totals of a scan: files, healthy (readable, with parity or without), corrupted."""
    healthy = F.col("status") == "ok"
    return scanned.agg(F.count(F.lit(1)).alias("files"), F.count_if(healthy).alias("healthy"), F.count_if(~healthy).alias("corrupted"))


def record(path: str, done: DataFrame, operation: str, user: Column) -> None:
    """Appends an event to the pool's audit log for each row of ``done`` (file_id, created_at as epoch seconds, success)."""
    events = done.select(F.col("file_id").cast("long").alias("event_id"), F.timestamp_seconds("created_at").alias("ts"), F.lit(operation).alias("operation"), user.cast("long").alias("user_id"), "success")
    append_audit(events, f"{path}/audit")


def sealed(payload: Column, secret: Column, name: Column) -> Column:
    """A struct of the payload under a key of its own (AES-GCM) and that key wrapped under the secret."""
    key = F.unhex(F.substring(F.sha2(F.concat(secret.cast("binary"), name.cast("binary")), 256), 1, 32))
    return F.struct(F.aes_encrypt(payload, key).alias("body"), F.aes_encrypt(key, master(secret)).alias("wrapped"))


def master(secret: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.lit("master:"), secret).cast("binary"), 256), 1, 32))


def opened(box: Column, secret: Column) -> Column:
    """The payload of a sealed struct; null under a wrong secret."""
    return F.try_aes_decrypt(box["body"], F.try_aes_decrypt(box["wrapped"], master(secret)))
