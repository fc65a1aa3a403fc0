"""Strands as FASTA-like text, and catalogs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import valid_strand


def write_fasta(strands: DataFrame, path: str) -> None:
    """A header line and a sequence line for each strand (name, seq)."""
    strands.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, is_valid) of each record.  Blank lines and comments (#) are skipped; a name is null for a sequence that follows none.

    Records are split at ``>``, so a file is read in parallel and needs no order of lines.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace("value", r"^>", ""), r"\r?\n")
    rows = records.select(lines.alias("lines"))
    body = F.filter(F.transform(F.slice(F.col("lines"), 2, F.size("lines")), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    return rows.select(F.trim(F.col("lines")[0]).alias("name"), F.array_join(body, "").alias("seq")).where("seq <> ''").withColumn("is_valid", valid_strand(F.col("seq")))


AUDIT = "event_id long, ts timestamp, operation string, user_id long, success boolean"


def append_audit(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines."""
    events.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log; lines that aren't events are skipped."""
    return spark.read.schema(AUDIT).option("mode", "DROPMALFORMED").json(path)
