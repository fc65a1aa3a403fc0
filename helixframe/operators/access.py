"""Random access: an index that gives every file of a pool a pair of primers, and reads of the whole pool told apart by them.

An index is a path with the library, what was registered, what was removed, and
the log that ``store`` keeps too: a registration counts from its entry on, and of
two that were made at once the second is made again, so no pair is given twice.
A pair of a removed file isn't given again, as strands with it may still be about.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import primers, store

ENTRIES = "file_id long, filename string, size long, content_hash string, ordinal int, write string"
GONE = "file_id long, write string"


def create(path: str, library: DataFrame) -> None:
    """An index over a library (ordinal from 0 without gaps, primer_id, fwd, rev)."""
    library.select("ordinal", "primer_id", "fwd", "rev").write.parquet(f"{path}/library")


def library(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ordinal int, primer_id string, fwd string, rev string").parquet(f"{path}/library")


def _rows(spark: SparkSession, path: str, kind: str, shape: str, upto: int | None = None) -> DataFrame:
    """Rows of one kind that count, with the number of their entry; of entries up to ``upto``, if it is given."""
    entries = store.log(spark, path).where(F.col("kind") == kind).select("write", "number")
    if upto is not None:
        entries = entries.where(F.col("number") <= upto)
    if not entries.head(1):
        return spark.createDataFrame([], f"{shape}, number long")
    # as many rows as there were calls
    return spark.read.schema(shape).parquet(f"{path}/{kind}").join(F.broadcast(entries), "write")


def load(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The files that are registered, with their pairs: file_id, filename, size, content_hash, ordinal, primer_id, fwd, rev."""
    ends = _rows(spark, path, "gone", GONE, upto).groupBy("file_id").agg(F.max("number").alias("ended"))
    alive = _rows(spark, path, "entries", ENTRIES, upto).join(ends, "file_id", "left").where("ended is null or ended < number")
    return alive.select("file_id", "filename", "size", "content_hash", "ordinal").join(library(spark, path), "ordinal").select("file_id", "filename", "size", "content_hash", "ordinal", "primer_id", "fwd", "rev")


def register(path: str, files: DataFrame, order: list[str], request: str | None = None, expected: int | None = None) -> str:
    """Gives files (file_id, filename, size, content_hash) the next free pairs, in order; the name of the write.

    A file that is registered keeps its pair.  If the library has too few pairs
    left, ``store.Refused`` and none is given.  ``request`` and ``expected`` are
    those of ``store.write``.
    """
    spark = files.sparkSession
    if files.where("file_id is null").head(1) or files.groupBy("file_id").count().where("count > 1").head(1):
        raise ValueError("a file_id stands for one row")
    while True:
        if before := store.answered(spark, path, request):
            return before
        seen = store.version(spark, path) if expected is None else expected
        used = _rows(spark, path, "entries", ENTRIES, seen).agg(F.max("ordinal")).first()[0]
        first = 0 if used is None else used + 1
        fresh = files.join(load(spark, path, seen).select("file_id"), "file_id", "left_anti")
        pairs = library(spark, path).where(F.col("ordinal") >= first)
        if fresh.count() > pairs.count():
            raise store.Refused("the library has too few pairs left")
        name = f"w{uuid.uuid4().hex}"
        given = primers.assigned(fresh, pairs.withColumn("ordinal", F.col("ordinal") - first), order).drop("fwd", "rev")
        named = given.join(library(spark, path).select("primer_id", "ordinal"), "primer_id")
        named.select(F.col("file_id").cast("long"), "filename", F.col("size").cast("long"), "content_hash", "ordinal").write.parquet(f"{path}/entries/write={name}")
        try:
            store.commit(spark, path, "entries", name, request, seen)
        except store.Refused:
            if expected is not None:
                raise
            continue  # another call was first: its pairs are taken now
        return name


def remove(spark: SparkSession, path: str, ids: DataFrame, request: str | None = None, expected: int | None = None) -> str:
    """Takes files (file_id) out of the index; ids that aren't in it don't matter."""
    if before := store.answered(spark, path, request):
        return before
    name = f"w{uuid.uuid4().hex}"
    ids.where("file_id is not null").select(F.col("file_id").cast("long")).distinct().write.parquet(f"{path}/gone/write={name}")
    store.commit(spark, path, "gone", name, request, expected)
    return name


def resolved(hits: DataFrame, registered: DataFrame) -> DataFrame:
    """Search hits (file_id) with the pair of each file: ordinal, primer_id, fwd, rev; null for a file that has none."""
    return hits.join(registered.select("file_id", "ordinal", "primer_id", "fwd", "rev"), "file_id", "left")


def tagged(strands: DataFrame, registered: DataFrame) -> DataFrame:
    """``strands`` (file_id, seq) between their file's primers; those of files without a pair go."""
    return primers.tagged(strands.join(registered.select("file_id", "primer_id"), "file_id"), registered).drop("primer_id")


def retrieved(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Of reads of a whole pool (strand_id, which names a read, seq, any others) those of the resolved hits, without primers, with file_id.

    A read belongs to a hit if the head is its forward primer and the end is its
    reverse primer, each within the tolerated edits.  Reads are compared with
    the pairs of the hits alone, and only with those they share a seed with.
    """
    asked = hits.where("primer_id is not null").select("file_id", "ordinal", "primer_id", "fwd", "rev")
    found = primers.identified(reads, asked).where("found is not null").withColumnRenamed("found", "primer_id")
    return primers.untagged(found, asked).where("seq is not null").join(asked.select("primer_id", "file_id"), "primer_id").drop("primer_id")
