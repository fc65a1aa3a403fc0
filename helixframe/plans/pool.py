"""Queries on the pool: statistics, versions, capacity, primers, blocks, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import access, blocks, codecs, noise, parity, pool, primers, search
from ..operators.running import running_total
from ..sources.fasta import read_fasta, write_fasta
from ..sources.tables import document_files, part_files, scratch, table, written
from . import sql

PRIMERS, BLOCK_LIMIT, CAPACITY = 100, 512, 100_000


def pool_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a stored file, and the pool as a whole (file_id -1)."""
    found = pool.planned_stat(pool.catalog(part_files(spark, sf_dir), "ternary", 4))
    key = F.when(F.col("is_total") == 1, F.lit(-1)).otherwise(F.col("file_id")).cast("long")
    return found.select(key.alias("file_id"), "strands", "data_strands", "parity_strands", "nucleotides", F.round("redundancy", 6).alias("redundancy"), F.round("avg_length", 6).alias("avg_length"))


def _order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a version of its customer's file."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("filename"), F.col("o_orderdate").alias("created_at"), F.round(F.col("o_totalprice")).cast("long").alias("size"), F.col("o_custkey").alias("custkey"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.versions(_order_files(spark, sf_dir), ["created_at", "file_id"])


def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("file_id", "filename", F.col("version").cast("long").alias("version"), "is_current", "size")


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.listed(_versions(spark, sf_dir), "customer/1").select("file_id", "filename", F.col("version").cast("long").alias("version"))


def _building(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("filename"))


def delete_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each file after the files of one market segment are deleted with all versions."""
    left = pool.delete(_order_files(spark, sf_dir), _building(spark, sf_dir))
    return left.groupBy("filename").agg(F.count(F.lit(1)).alias("versions"), F.sum("size").alias("size"))


def migrated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after the files of one market segment moved to the two-rule codec."""
    files = _versions(spark, sf_dir).withColumns({"codec": F.lit("ternary"), "redundancy": F.lit(4)})
    out = pool.migrate(files, _building(spark, sf_dir), "yinyang", 6)
    return out.select("filename", "file_id", "size", F.col("version").cast("long").alias("version"), "codec", F.col("redundancy").cast("long").alias("redundancy"), F.col("history").cast("long").alias("history"))


def capacity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents each tenant (source) can store, in order of id, before its nucleotides run out."""
    files = pool.catalog(document_files(spark, sf_dir)).join(document_files(spark, sf_dir).select("file_id", "source"), "file_id")
    nt = F.col("data_strands") * (162 + 40) + F.col("parity_strands") * (648 + 40)
    sized = files.select("file_id", F.coalesce("source", F.lit("")).alias("tenant"), nt.alias("nt"))
    used = running_total(sized, "nt", ["file_id"], ["tenant"], "used")
    return used.select("file_id", "tenant", "nt", "used", (F.col("used") <= CAPACITY).alias("accepted"))


def _tagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = primers.library_table(spark, PRIMERS)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("strand_id"), F.format_string("P%04d", F.col("s_suppkey") % PRIMERS).alias("primer_id"), dna.pack(F.encode("s_name", "UTF-8")).alias("seq"))
    return primers.tagged(s, pairs), pairs


def primer_untag(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, pairs = _tagged(spark, sf_dir)
    return primers.untagged(reads, pairs).select("strand_id", "primer_id", "seq")


def primer_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair that each supplier's tagged strand carries, by its sequence alone."""
    reads, pairs = _tagged(spark, sf_dir)
    return primers.identified(reads, pairs).select("strand_id", "found")


def selective_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of retrieving one brand's parts, with the packed brand as primer."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("strand_id"), F.col("p_brand").alias("primer_id"), dna.pack(F.encode("p_brand", "UTF-8")).alias("fwd"))
    target = p.orderBy("primer_id").select("primer_id", "fwd").limit(1)
    found = primers.retrieved(p, target)
    return primers.retrieval_quality(found).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as blocks of 512 bytes, and joined again."""
    cut = blocks.to_blocks(document_files(spark, sf_dir), BLOCK_LIMIT)
    n = cut.groupBy("file_id").agg(F.count(F.lit(1)).alias("blocks"))
    return blocks.from_blocks(cut).join(n, "file_id").select("file_id", "blocks", F.sha2("payload", 256).alias("sha256"))


def _block_address() -> Column:
    return F.col("file_id") * (1 << 20) + F.col("lba")


def read_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of every document read from a device that lost the first strand of each, with an address a document that was never written and one beyond the device."""
    cut = blocks.to_blocks(document_files(spark, sf_dir), BLOCK_LIMIT).select(_block_address().alias("lba"), "block")
    held = blocks.stored(cut, 2).where("is_parity or source_index > 0")
    unwritten = table(spark, sf_dir, "documents").select(((F.col("doc_id") + 1) * (1 << 20) - 1).alias("lba"))
    beyond = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("lba"))
    found = blocks.read(held, cut.select("lba").unionByName(unwritten).unionByName(beyond), 1 << 62, 2)
    return found.select("lba", "status", F.sha2("block", 256).alias("sha256"))


def primer_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primer pairs drawn for each customer that a library keeps whose primers differ in eight places."""
    name = lambda side: F.concat_ws(":", "c_custkey", F.lit(side))
    drawn = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ordinal"), primers.drawn(name("fwd")).alias("fwd"), primers.drawn(name("rev")).alias("rev"))
    return primers.independent(drawn, 8)


def assigned_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair that each customer gets, in order of account balance, from a library of fewer pairs than customers."""
    pairs = primers.library_table(spark, PRIMERS)
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("custkey"), "c_acctbal")
    return primers.assigned(who, pairs, ["c_acctbal", "custkey"]).select("custkey", "primer_id")


def retrieved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' files of one search, read from a pool of all suppliers' tagged strands that lost the first strand of each file.

    The index gets odd keys first, then even ones; one nation's files are removed from it.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("file_id"), F.format_string("nation%d/%d.txt", "s_nationkey", "s_suppkey").alias("filename"), F.encode("s_name", "UTF-8").alias("payload"), F.col("s_suppkey").cast("long").alias("created_at"), "s_nationkey")
    place, made = scratch(spark, "access"), pool.catalog(s, "ternary", 2)
    access.create(place, primers.library_table(spark, max(1, s.count())))
    for odd in (1, 0):
        access.register(place, made.where(F.col("file_id") % 2 == odd), ["file_id"])
    access.remove(spark, place, s.where("s_nationkey = 11").select("file_id"))
    everyone = written(access.load(spark, place), "registered")
    left = pool.strands(s, "ternary", 2).where("is_parity or source_index > 0")
    reads = access.tagged(left, everyone).withColumn("strand_id", F.xxhash64("file_id", "stripe", "source_index")).drop("file_id")
    hits = written(access.resolved(search.search(everyone.select("file_id", "filename", "size", "content_hash"), "name:nation1 type:txt", 10), everyone), "hits")
    found = written(access.retrieved(reads, hits), "retrieved").join(made.select("file_id", F.col("data_strands").cast("int").alias("data_strands")), "file_id").withColumn("parity", F.lit(2))
    back = codecs.decode(parity.mend(found, 2), "ternary")
    return hits.join(back, "file_id", "left").select("file_id", "filename", "primer_id", "status", F.sha2("payload", 256).alias("sha256"))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("lba"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("write_id"))


def rewritten_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.rewritten(_writes(spark, sf_dir), ["at", "write_id"]).select("lba", "generation", "write_id")


def write_once_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.write_once(_writes(spark, sf_dir), ["at", "write_id"]).select("lba", "write_id", "status")


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source's documents cost to store on each device."""
    files = document_files(spark, sf_dir).select(F.coalesce("source", F.lit("")).alias("source"), F.octet_length("payload").cast("long").alias("size"))
    nt = files.groupBy("source").agg(F.sum(162 * pool.strand_count(F.col("size"), "ternary")).alias("nt"))
    prices = F.explode(F.array(*(F.struct(F.lit(k).alias("profile"), F.lit(p.usd_per_base).alias("usd")) for k, p in noise.PROFILES.items())))
    return nt.withColumn("price", prices).select("source", "price.profile", F.round(F.col("nt") * F.col("price.usd"), 4).alias("usd"))


def redundancy_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity strands and error after a vote that each part's size stands for as coverage, by device."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), F.col("p_size").alias("coverage"), F.explode(F.array(*map(F.lit, ("twist", "illumina", "nanopore")))).alias("profile"))
    rate = F.when(F.col("profile") == "twist", 0.03).when(F.col("profile") == "illumina", 0.35).otherwise(5.0)
    return p.select("p_partkey", "profile", pool.recommended_redundancy(F.col("profile"), F.col("coverage")).cast("long").alias("parity"), F.round(pool.voted_error(rate, F.col("coverage")), 9).alias("error"))


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's packed name written as FASTA and read back."""
    path = scratch(spark, "fasta")
    strands = part_files(spark, sf_dir).select(F.format_string("%06d", "file_id").alias("name"), dna.pack(F.col("payload")).alias("seq"))
    write_fasta(strands, path)
    return read_fasta(spark, path)


QUERIES = {
    f.__name__: f
    for f in (pool_stat, version_history, listed_files, delete_chains, migrated_files, capacity_check, primer_untag, primer_identify, selective_retrieval, block_round_trip, read_blocks, primer_library, assigned_primers, retrieved_files, rewritten_blocks, write_once_blocks, cost_estimate, redundancy_advice, fasta_round_trip)
}

_FILES = f"WITH d AS ({sql.DOCUMENT_FILES}), c AS (SELECT *, CASE WHEN size > 0 THEN CAST(ceil(6 * (size + 4) / 150.0) AS BIGINT) ELSE 0 END AS s FROM d)"
_VERSIONS = """WITH v AS (
  SELECT o_orderkey AS file_id, 'customer/' || o_custkey AS filename, CAST(round(o_totalprice) AS BIGINT) AS size, o_custkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""
ORACLE_SQL = {
    "pool_stat": """WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(ceil(6 * (octet_length(encode(p_name)) + 4) / 150.0) AS BIGINT) AS s FROM part),
r AS (SELECT id, s, 4 * CAST(ceil(s / 252.0) AS BIGINT) AS q FROM p)
SELECT CASE WHEN grouping(id) = 1 THEN -1 ELSE id END AS file_id, CAST(sum(s + q) AS BIGINT) AS strands, CAST(sum(s) AS BIGINT) AS data_strands, CAST(sum(q) AS BIGINT) AS parity_strands,
  CAST(sum(162 * s + 648 * q) AS BIGINT) AS nucleotides, round(sum(s + q) * 1.0 / sum(s), 6) AS redundancy, round(sum(162 * s + 648 * q) * 1.0 / sum(s + q), 6) AS avg_length FROM r GROUP BY ROLLUP (id)""",
    "version_history": f"{_VERSIONS} SELECT file_id, filename, version, version = n AS is_current, size FROM v",
    "listed_files": f"{_VERSIONS} SELECT file_id, filename, version FROM v WHERE version = n AND filename LIKE 'customer/1%'",
    "delete_chains": f"{_VERSIONS} SELECT filename, count(*) AS versions, CAST(sum(size) AS BIGINT) AS size FROM v WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY filename",
    "migrated_files": f"""{_VERSIONS}, b AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT filename, file_id, size, 1 AS version, 'yinyang' AS codec, 6 AS redundancy, n AS history FROM v SEMI JOIN b ON o_custkey = c_custkey WHERE version = n
UNION ALL SELECT filename, file_id, size, version, 'ternary', 4, 0 FROM v ANTI JOIN b ON o_custkey = c_custkey""",
    "capacity_check": f"""{_FILES}, n AS (SELECT file_id, coalesce(source, '') AS tenant, s * 202 + 4 * CAST(ceil(s / 252.0) AS BIGINT) * 688 AS nt FROM c),
u AS (SELECT *, CAST(sum(nt) OVER (PARTITION BY tenant ORDER BY file_id) AS BIGINT) AS used FROM n) SELECT file_id, tenant, nt, used, used <= {CAPACITY} AS accepted FROM u""",
    "primer_untag": f"SELECT CAST(s_suppkey AS BIGINT) AS strand_id, printf('P%04d', s_suppkey % {PRIMERS}) AS primer_id, {sql.pack('encode(s_name)')} AS seq FROM supplier",
    "primer_identify": f"SELECT CAST(s_suppkey AS BIGINT) AS strand_id, printf('P%04d', s_suppkey % {PRIMERS}) AS found FROM supplier",
    "selective_retrieval": f"""WITH p AS (SELECT p_partkey, p_brand, {sql.pack("encode(p_brand)")} AS fwd FROM part), t AS (SELECT min(p_brand) AS brand, arg_min(fwd, p_brand) AS target FROM p),
x AS (SELECT p_partkey, p_brand = brand AS hit, least(length(fwd), length(target)) AS n, len(list_filter(range(1, least(length(fwd), length(target)) + 1), lambda i: substr(fwd, i, 1) <> substr(target, i, 1))) AS d FROM p, t),
y AS (SELECT hit, CAST('0x' || substr(md5('42:' || p_partkey), 1, 8) AS BIGINT) / 4294967296.0 < CASE WHEN hit THEN 0.95 WHEN (n - d) * 1.0 / n > 0.8 THEN 0.01 * ((n - d) * 1.0 / n) ELSE 0.0001 END AS got FROM x)
SELECT round(coalesce(count(*) FILTER (got AND hit) * 1.0 / nullif(count(*) FILTER (got), 0), 1), 6) AS precision, round(coalesce(count(*) FILTER (got AND hit) * 1.0 / nullif(count(*) FILTER (hit), 0), 1), 6) AS recall FROM y""",
    "block_round_trip": f"WITH d AS ({sql.DOCUMENT_FILES}) SELECT file_id, CAST(ceil((size + 4) / 512.0) AS BIGINT) AS blocks, sha256(text) AS sha256 FROM d",
    "read_blocks": f"""WITH d AS ({sql.DOCUMENT_FILES}), h AS (SELECT file_id, size, printf('%08X', size) || hex(encode(text)) AS digits FROM d),
b AS (SELECT file_id, digits, unnest(range(0, CAST(ceil((size + 4) / 512.0) AS BIGINT))) AS i FROM h)
SELECT file_id * 1048576 + i AS lba, 'ok' AS status, sha256(unhex(rpad(substr(digits, i * 1024 + 1, 1024), 1024, '0'))) AS sha256 FROM b
UNION ALL SELECT (file_id + 1) * 1048576 - 1, 'never_written', NULL FROM d UNION ALL SELECT -1 - r_regionkey, 'out_of_range', NULL FROM region""",
    "primer_library": f"""WITH RECURSIVE c AS (SELECT CAST(c_custkey AS BIGINT) AS ordinal, substr(translate(md5(c_custkey || ':fwd'), '0123456789abcdef', 'AAAATTTTGGGGCCCC'), 1, 20) AS fwd, substr(translate(md5(c_custkey || ':rev'), '0123456789abcdef', 'AAAATTTTGGGGCCCC'), 1, 20) AS rev FROM customer),
p AS (SELECT ordinal, fwd, rev, unnest([fwd, rev]) AS q FROM c),
ok AS (SELECT ordinal, bool_and(length(replace(replace(q, 'A', ''), 'T', '')) BETWEEN 8 AND 12 AND {sql.max_run("q")} <= 3 AND len(list_filter(range(1, 16), lambda i: substr(q, i, 6) = reverse(translate(substr(q, i, 6), 'ATGC', 'TACG')))) = 0) AS fine FROM p GROUP BY ordinal),
f AS (SELECT ordinal, fwd, rev, row_number() OVER (ORDER BY ordinal) AS i FROM c SEMI JOIN (SELECT ordinal FROM ok WHERE fine) USING (ordinal)),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL
  SELECT f.i, CASE WHEN len(list_filter(kept, lambda x: hamming(x, fwd) < 8 OR hamming(x, rev) < 8)) = 0 THEN list_concat(kept, [fwd, rev]) ELSE kept END FROM g JOIN f ON f.i = g.i + 1)
SELECT ordinal, fwd, rev FROM f SEMI JOIN (SELECT unnest(arg_max(kept, i)) AS fwd FROM g) USING (fwd)""",
    "retrieved_files": """WITH f AS (SELECT CAST(s_suppkey AS BIGINT) AS file_id, printf('nation%d/%d.txt', s_nationkey, s_suppkey) AS filename, s_name, s_nationkey, printf('P%04d', row_number() OVER (ORDER BY s_suppkey % 2 = 0, s_suppkey) - 1) AS primer_id FROM supplier)
SELECT file_id, filename, primer_id, 'ok' AS status, sha256(s_name) AS sha256 FROM f WHERE s_nationkey <> 11 AND contains(filename, 'nation1') ORDER BY file_id LIMIT 10""",
    "assigned_primers": f"SELECT CAST(c_custkey AS BIGINT) AS custkey, CASE WHEN row_number() OVER w <= {PRIMERS} THEN printf('P%04d', row_number() OVER w - 1) END AS primer_id FROM customer WINDOW w AS (ORDER BY c_acctbal, c_custkey)",
    "rewritten_blocks": "SELECT o_custkey AS lba, count(*) AS generation, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS write_id FROM orders GROUP BY o_custkey",
    "write_once_blocks": "SELECT o_custkey AS lba, o_orderkey AS write_id, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'ok' ELSE 'already_written' END AS status FROM orders",
    "cost_estimate": f"""{_FILES}, n AS (SELECT coalesce(source, '') AS source, sum(162 * s) AS nt FROM c GROUP BY 1)
SELECT source, profile, round(CAST(nt AS DOUBLE) * usd, 4) AS usd FROM n, (VALUES {", ".join(f"('{k}', CAST({v.usd_per_base!r} AS DOUBLE))" for k, v in noise.PROFILES.items())}) t(profile, usd)""",
    "redundancy_advice": """SELECT CAST(p_partkey AS BIGINT) AS p_partkey, profile, CAST(CASE profile WHEN 'twist' THEN 2 WHEN 'illumina' THEN CASE WHEN p_size >= 10 THEN 3 ELSE 4 END ELSE CASE WHEN p_size >= 10 THEN 6 ELSE 8 END END AS BIGINT) AS parity,
  round(CASE WHEN p_size > 1 THEN rate / (p_size * p_size) ELSE rate END, 9) AS error FROM part, (VALUES ('twist', CAST(0.03 AS DOUBLE)), ('illumina', CAST(0.35 AS DOUBLE)), ('nanopore', CAST(5.0 AS DOUBLE))) t(profile, rate)""",
    "fasta_round_trip": f"SELECT printf('%06d', p_partkey) AS name, {sql.pack('encode(p_name)')} AS seq, true AS is_valid FROM part",
}
