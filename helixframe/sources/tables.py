"""Tables as files of the pool, and a place for what a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where they come in fewer partitions than there are cores; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def spread_by(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` in at least as many partitions as there are cores, before a step that makes much of few bytes: by size alone they may come in one."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part: its name's bytes."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"))
    return rows.select(F.col("p_partkey").cast("long").alias("file_id"), F.col("p_name").alias("filename"), F.encode("p_name", "UTF-8").alias("payload"), F.col("p_partkey").cast("long").alias("created_at"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document: its text's bytes, named ``source/doc_id.lang``."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("")))
    return rows.select(F.col("doc_id").alias("file_id"), name.alias("filename"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"), F.col("doc_id").alias("created_at"), "source")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; where that is unset, a local folder in local mode, as in tests, and an error on a cluster."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="helixframe-"))
    path = f"{place.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(context.applicationId, []).append(path)
    return path


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table in a scratch folder: computed once, and there after executors are lost."""
    path = scratch(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def forgotten(spark: SparkSession, rows: DataFrame) -> None:
    """Removes what ``written`` has made of ``rows``, once nothing rests on it any more."""
    for path in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes what this session has written on its way; results that rest on it can't be read afterwards."""
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
