"""Queries on single strands: statistics, constraints, distances, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, dna
from ..operators import constraints
from ..sources.tables import document_files, part_files, table
from . import sql


def _part_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_files(spark, sf_dir).select(F.col("file_id").alias("p_partkey"), dna.pack(F.col("payload")).alias("seq"))


def strand_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return _part_strands(spark, sf_dir).select(
        F.col("p_partkey"), F.length(s).cast("long").alias("nt"), F.round(dna.gc_content(s), 6).alias("gc"), dna.max_run(s).cast("long").alias("max_run"), dna.max_run_base(s).alias("run_base"),
        dna.melting_temperature(s).cast("long").alias("tm"), dna.reverse_complement(s).alias("revcomp"), dna.palindrome(s).alias("is_palindrome"), (dna.unpack(s) == F.unhex(F.hex(dna.unpack(s)))).alias("bytes_back"),
    )


def gc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by tenths of the GC share of their packed text."""
    shares = document_files(spark, sf_dir).select(dna.packed_gc(F.col("payload")).alias("gc"))
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    counted = shares.select(F.least(F.floor(F.col("gc") * 10), F.lit(9)).cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("documents"))


def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constraints.violation_rows(_part_strands(spark, sf_dir), constraints.LIMITS["sequence-literal"], ("p_partkey",))
    return found.groupBy("p_partkey", "kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("position"), F.lit(-1)).cast("long").alias("first_position"))


def strand_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return _part_strands(spark, sf_dir).select("p_partkey", *(constraints.is_valid(s, constraints.LIMITS[k]).alias(k) for k in ("default", "relaxed", "strict")))


def local_gc_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dna.local_gc(F.col("seq"), 20)
    return _part_strands(spark, sf_dir).select("p_partkey", F.size(w).cast("long").alias("windows"), F.round(F.array_min(w), 6).alias("least"), F.round(F.array_max(w), 6).alias("most"))


def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b = dna.pack(F.encode("p_brand", "UTF-8")), dna.pack(F.encode("p_type", "UTF-8"))
    both = p.select(F.col("p_partkey").cast("long"), a.alias("a"), b.alias("b"))
    return both.select("p_partkey", F.levenshtein("a", "b").cast("long").alias("edits"), dna.hamming(F.col("a"), F.col("b")).cast("long").alias("hamming"), F.round(dna.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_files(spark, sf_dir)
    p = F.col("payload")
    return f.select(F.col("file_id").alias("p_partkey"), bits.djb2(p).alias("djb2"), bits.content_hash(p).alias("content_hash"), bits.trits(p).alias("trits"), F.hex(bits.with_length(p)).alias("framed"))


_PARTS = f"WITH s AS ({sql.PART_SEQ})"
QUERIES = {f.__name__: f for f in (strand_stats, gc_histogram, violation_counts, strand_validity, local_gc_windows, edit_distances, hashes)}
_LIMITS = {k: constraints.LIMITS[k] for k in ("default", "relaxed", "strict")}


def valid_sql(x: constraints.Limits) -> str:
    windows = f"list_transform(range(1, length(seq) - {x.window} + 2), lambda i: {sql.gc(f'substr(seq, i, {x.window})')})"
    mirrored = f"len(list_filter(range(1, length(seq) - {x.palindrome} + 2), lambda i: substr(seq, i, {x.palindrome}) = {sql.revcomp(f'substr(seq, i, {x.palindrome})')}))"
    local = f"len(list_filter({windows}, lambda g: g < {x.min_gc} OR g > {x.max_gc}))"
    return f"(length(seq) BETWEEN {x.min_length} AND {x.max_length} AND {sql.gc('seq')} BETWEEN {x.min_gc} AND {x.max_gc} AND {local} = 0 AND {sql.max_run('seq')} <= {x.max_run} AND {mirrored} = 0)"


_SEQ = constraints.LIMITS["sequence-literal"]
ORACLE_SQL = {
    "strand_stats": f"""{_PARTS}
SELECT p_partkey, CAST(length(seq) AS BIGINT) AS nt, round({sql.gc("seq")}, 6) AS gc, CAST({sql.max_run("seq")} AS BIGINT) AS max_run,
  list_filter(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r) = {sql.max_run("seq")})[1][1] AS run_base,
  CAST(2 * length(seq) + 2 * length(replace(replace(seq, 'A', ''), 'T', '')) AS BIGINT) AS tm, {sql.revcomp("seq")} AS revcomp, seq = {sql.revcomp("seq")} AS is_palindrome, true AS bytes_back FROM s""",
    "gc_histogram": f"""WITH d AS (SELECT {sql.pack("encode(coalesce(text, ''))")} AS seq FROM documents),
b AS (SELECT CAST(least(floor(coalesce({sql.gc("nullif(seq, '')")}, 0) * 10), 9) AS INTEGER) AS bin FROM d)
SELECT CAST(r AS INTEGER) AS bin, (SELECT count(*) FROM b WHERE b.bin = r) AS documents FROM range(10) t(r)""",
    "violation_counts": f"""{_PARTS},
v AS (
  SELECT p_partkey, 'too_long' AS kind, CAST(NULL AS BIGINT) AS position FROM s WHERE length(seq) > {_SEQ.max_length}
  UNION ALL SELECT p_partkey, 'gc', NULL FROM s WHERE {sql.gc("seq")} < {_SEQ.min_gc} OR {sql.gc("seq")} > {_SEQ.max_gc}
  UNION ALL SELECT p_partkey, 'local_gc', i - 1 FROM (SELECT *, unnest(range(1, length(seq) - {_SEQ.window} + 2)) AS i FROM s) WHERE {sql.gc(f"substr(seq, i, {_SEQ.window})")} < {_SEQ.min_gc} OR {sql.gc(f"substr(seq, i, {_SEQ.window})")} > {_SEQ.max_gc}
  UNION ALL SELECT p_partkey, 'homopolymer', i - 1 FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM s)
    WHERE (i = 1 OR substr(seq, i, 1) <> substr(seq, i - 1, 1)) AND regexp_matches(substr(seq, i, {_SEQ.max_run + 1}), '^(A{{{_SEQ.max_run + 1}}}|C{{{_SEQ.max_run + 1}}}|G{{{_SEQ.max_run + 1}}}|T{{{_SEQ.max_run + 1}}})')
  UNION ALL SELECT p_partkey, 'palindrome', min(i) - 1 FROM (SELECT *, unnest(range(1, length(seq) - w + 2)) AS i FROM (SELECT *, unnest(range({_SEQ.palindrome}, length(seq) + 1, 2)) AS w FROM s))
    WHERE substr(seq, i, w) = {sql.revcomp("substr(seq, i, w)")} GROUP BY p_partkey, w
)
SELECT p_partkey, kind, count(*) AS n, CAST(coalesce(min(position), -1) AS BIGINT) AS first_position FROM v GROUP BY p_partkey, kind""",
    "strand_validity": f"{_PARTS} SELECT p_partkey, {', '.join(f'{valid_sql(x)} AS "{k}"' for k, x in _LIMITS.items())} FROM s",
    "local_gc_windows": f"""{_PARTS}, w AS (SELECT p_partkey, list_transform(range(1, length(seq) - 18), lambda i: {sql.gc("substr(seq, i, 20)")}) AS g FROM s)
SELECT p_partkey, CAST(len(g) AS BIGINT) AS windows, round(list_min(g), 6) AS least, round(list_max(g), 6) AS most FROM w""",
    "edit_distances": f"""WITH s AS (SELECT p_partkey, {sql.pack("encode(p_brand)")} AS a, {sql.pack("encode(p_type)")} AS b FROM part),
h AS (SELECT *, least(length(a), length(b)) AS n, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) AS d FROM s)
SELECT p_partkey, CAST(levenshtein(a, b) AS BIGINT) AS edits, CAST(d AS BIGINT) AS hamming, round((n - d) * 1.0 / n, 6) AS similarity FROM h""",
    "hashes": f"""WITH p AS (SELECT p_partkey, encode(p_name) AS b FROM part), v AS (SELECT *, {sql.byte_list("b")} AS bytes FROM p)
SELECT p_partkey, list_reduce(bytes, lambda h, x: (h * 33 + x) % 4294967296, CAST(5381 AS BIGINT)) AS djb2, substr(sha256(b), 1, 16) AS content_hash,
  array_to_string(list_transform(bytes, lambda v: (v // 243 % 3)::VARCHAR || (v // 81 % 3) || (v // 27 % 3) || (v // 9 % 3) || (v // 3 % 3) || (v % 3)), '') AS trits,
  printf('%08X', octet_length(b)) || hex(b) AS framed FROM v""",
}
