"""How many strands and nucleotides each document takes under each codec, by closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARITY = 4
PRIMERS = 40


def strand_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: strand and nucleotide counts of the ternary, overlapping, two-rule and fountain codecs, and stored size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    up = lambda a, b: F.ceil(a / F.lit(b)).cast("long")
    trits, bases = 6 * (F.col("n_bytes") + 4), 4 * (F.col("n_bytes") + 4)
    segments = up(F.col("n_bytes") + 4, 16)
    out = docs.select("doc_id", n.alias("n_bytes")).withColumns({
        "ternary_strands": up(trits, 150),
        "overlap_strands": 1 + F.greatest(F.lit(0).cast("long"), up(trits - 150, 75)),
        "yinyang_strands": up(bases, 142),
        "fountain_droplets": F.greatest(up(segments * 3, 2), segments + 1),
    })
    stripes = up(F.col("ternary_strands"), 256 - PARITY)
    return out.withColumns({
        "ternary_nt": 162 * F.col("ternary_strands"),
        "overlap_nt": 162 * F.col("overlap_strands"),
        "yinyang_nt": bases + 8 * F.col("yinyang_strands"),
        "fountain_nt": 96 * F.col("fountain_droplets"),
        "parity_strands": PARITY * stripes,
        "stored_nt": 162 * F.col("ternary_strands") + PARITY * stripes * 648 + PRIMERS * (F.col("ternary_strands") + PARITY * stripes),
        "bits_per_nt": F.round(8 * F.col("n_bytes") / (162 * F.col("ternary_strands")), 6),
    })


QUERIES = {"strand_layout": strand_layout}

ORACLE_SQL = {
    "strand_layout": """
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
c AS (
  SELECT *, CAST(ceil(6 * (n_bytes + 4) / 150.0) AS BIGINT) AS ternary_strands,
    1 + greatest(0, CAST(ceil((6 * (n_bytes + 4) - 150) / 75.0) AS BIGINT)) AS overlap_strands,
    CAST(ceil(4 * (n_bytes + 4) / 142.0) AS BIGINT) AS yinyang_strands,
    CAST(ceil((n_bytes + 4) / 16.0) AS BIGINT) AS segments FROM d
), p AS (
  SELECT *, greatest(CAST(ceil(segments * 3 / 2.0) AS BIGINT), segments + 1) AS fountain_droplets,
    4 * CAST(ceil(ternary_strands / 252.0) AS BIGINT) AS parity_strands FROM c
)
SELECT doc_id, n_bytes, ternary_strands, overlap_strands, yinyang_strands, fountain_droplets,
  162 * ternary_strands AS ternary_nt, 162 * overlap_strands AS overlap_nt,
  4 * (n_bytes + 4) + 8 * yinyang_strands AS yinyang_nt, 96 * fountain_droplets AS fountain_nt, parity_strands,
  162 * ternary_strands + parity_strands * 648 + 40 * (ternary_strands + parity_strands) AS stored_nt,
  round(8.0 * n_bytes / (162 * ternary_strands), 6) AS bits_per_nt
FROM p
"""
}
