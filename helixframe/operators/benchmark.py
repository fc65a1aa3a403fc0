"""Codecs against each other on the same files: what they make, how well it keeps to the constraints, how long it takes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..sources.tables import written
from . import codecs, constraints, fountain

FOUNTAIN = "fountain"
REPORT = "codec string, input_bytes long, strands long, nucleotides long, bits_per_nt double, avg_gc double, max_run int, violating long, round_trip boolean, encode_seconds double, decode_seconds double"


def measured(files: DataFrame, limits: constraints.Limits = constraints.LIMITS["default"], names: tuple[str, ...] = (*codecs.CODECS, FOUNTAIN)) -> DataFrame:
    """A row for each codec: what all of ``files`` (file_id, payload) become, strands that break a constraint, whether all come back, and seconds.

    Strands are written once and measured where they lie; a codec takes a job to
    encode, one to measure and one to decode.
    """
    spark = files.sparkSession
    size = files.agg(F.sum(F.octet_length("payload").cast("long")), F.count_if(F.octet_length("payload") > 0)).first()
    rows = []
    for name in names:
        began = time.time()
        made = written(fountain.encode(files) if name == FOUNTAIN else codecs.encode(files, name), "encoded")
        encoded, began = time.time() - began, time.time()
        back = fountain.decode(made) if name == FOUNTAIN else codecs.decode(made, name)
        right = back.where("status = 'ok'").select("file_id", bits.content_hash(F.col("payload")).alias("hash")).join(files.select("file_id", bits.content_hash(F.col("payload")).alias("hash")), ["file_id", "hash"]).count()
        decoded = time.time() - began
        n, nt, gc, run, bad = constraints.tally(made, limits).first()
        rows.append((name, size[0] or 0, n, nt or 0, 8.0 * (size[0] or 0) / nt if nt else 0.0, gc or 0.0, run or 0, bad, right == size[1], encoded, decoded))
    return spark.createDataFrame(rows, REPORT)


def choice(report: DataFrame) -> DataFrame:
    """best_density, fastest_encoder, most_compliant: the codec that is, of equals the first by name."""
    first = lambda *order: F.min(F.struct(*order, "codec"))["codec"]
    return report.agg(first((-F.col("bits_per_nt")).alias("a")).alias("best_density"), first("encode_seconds").alias("fastest_encoder"), first("violating").alias("most_compliant"))
