"""Where operators put what they must write, and joins that survive hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a local one in local mode, as in tests, and an error on a cluster."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _local:
            import tempfile

            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        place = _local[context.applicationId]
    return place.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Removes what this session's operators have written in the shared folder; their results can't be read afterwards."""
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot if it holds over 1/HOT of the rows, so that there are at most HOT hot keys.
HOT = 1000


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """Inner join on ``key``; ``right`` has one row a key, and ``rows`` counts the left rows of it.

    Keys with over 1/1000 of all rows, of which there are at most 1000, are
    broadcast; the others meet in a shuffled join, where none is hot.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) > total / HOT
    hot, rest = right.where(is_hot).drop(rows), right.where(~is_hot).drop(rows)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(rest, key))
