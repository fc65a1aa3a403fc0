"""Queries on a pool that is written, loaded again, read by version, migrated, scanned and logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keys, store
from ..sources.fasta import read_audit
from ..sources.tables import document_files, forgotten, part_files, scratch, table


def _brand_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name as a version of its brand's file."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("file_id"), F.col("p_brand").alias("filename"))
    return part_files(spark, sf_dir).drop("filename").join(names, "file_id")


def _stored(spark: SparkSession, sf_dir: str, files: DataFrame, parity: int = 4) -> str:
    path = scratch(spark, "pool")
    store.write(path, files, "ternary", parity)
    return path


def _digest(read: DataFrame) -> DataFrame:
    return read.select("filename", F.col("version").cast("long").alias("version"), "status", F.sha2("payload", 256).alias("sha256"))


def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of all files, read back from a pool on disk."""
    path = _stored(spark, sf_dir, _brand_files(spark, sf_dir))
    return _digest(store.read(spark, path, store.load(spark, path).select("filename", "version")))


def read_second_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second version of each file, and one that isn't there."""
    path = _stored(spark, sf_dir, _brand_files(spark, sf_dir))
    names = store.load(spark, path).select("filename").distinct()
    return _digest(store.read(spark, path, names.select("filename", F.explode(F.array(F.lit(2), F.lit(1_000_000))).alias("version"))))


def migrated_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest versions after every file has been read and encoded again under the two-rule codec."""
    path = _stored(spark, sf_dir, _brand_files(spark, sf_dir))
    names = store.load(spark, path).select("filename").distinct()
    store.migrate(spark, path, names, "yinyang", 6, F.lit(1 << 40))
    now = store.current(store.load(spark, path))
    made = store.strands(spark, path, now).where(~F.col("is_parity")).groupBy("file_id").agg(F.count(F.lit(1)).alias("strands"), F.sum(F.length("seq")).cast("long").alias("nucleotides"))
    back = store.read(spark, path, now.select("filename", "version")).select("filename", F.sha2("payload", 256).alias("sha256"))
    return now.join(made, "file_id").join(back, "filename").select("filename", "codec", F.col("version").cast("long").alias("version"), "strands", "nucleotides", "sha256")


def _harm(spark: SparkSession, path: str, lost: Column, rounds: int = 8) -> None:
    """Takes the strands for which ``lost`` holds from a pool's folders, some folders at a time, so that only these are there twice."""
    fs, top = store._place(spark, f"{path}/strands/gen=*/codec=*/bucket=*")
    folders = [f.getPath() for f in fs.globStatus(top)]
    for k in range(rounds):
        left = spark.read.schema(store.STRANDS).parquet(f"{path}/strands").where((F.col("bucket") % rounds == k) & ~lost)
        store.put(left, f"{path}/left-{k}", "gen", "codec", "bucket")
        for folder in folders:
            if int(folder.getName().split("=")[1]) % rounds == k:
                gen, codec = folder.getParent().getParent().getName(), folder.getParent().getName()
                fs.delete(folder, True)
                rest = store._place(spark, f"{path}/left-{k}/{gen}/{codec}/{folder.getName()}")[1]
                if fs.exists(rest):
                    fs.rename(rest, folder)


def pool_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a scan of a pool without parity that has lost the first strand of every tenth part."""
    path = _stored(spark, sf_dir, part_files(spark, sf_dir), 0)
    _harm(spark, path, (F.col("file_id") % 10 == 0) & (F.col("source_index") == 0))
    return store.scan_report(store.scan(spark, path))


def mended_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back by parity from a pool that has lost up to four strands of every stripe, data and parity alike."""
    path = _stored(spark, sf_dir, document_files(spark, sf_dir).select("file_id", F.concat_ws(" ", "filename", "file_id").alias("filename"), "payload", "created_at"))
    lost = F.col("source_index") % 64 == F.pmod(F.col("file_id"), F.lit(64))
    _harm(spark, path, lost)
    names = store.load(spark, path).select("filename", F.lit(None).cast("int").alias("version"))
    return store.read(spark, path, names).select("file_id", "status", "mended", F.sha2("payload", 256).alias("sha256"))


def migrated_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of every brand's file after a migration to the two-rule codec and back again."""
    path = _stored(spark, sf_dir, _brand_files(spark, sf_dir))
    names = store.load(spark, path).select("filename").distinct()
    store.migrate(spark, path, names, "yinyang", 2, F.lit(1 << 40))
    store.migrate(spark, path, names, "ternary", 4, F.lit(1 << 41))
    known = store.load(spark, path).select("filename", "version", "codec")
    return store.read(spark, path, known.select("filename", "version")).join(known, ["filename", "version"]).select("filename", F.col("version").cast("long").alias("version"), "codec", "status", F.sha2("payload", 256).alias("sha256"))


def retried_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written twice under one request and once more under another: the versions of each name and what they read."""
    path, files = scratch(spark, "pool"), part_files(spark, sf_dir)
    named = files.withColumn("filename", F.concat_ws(" ", "filename", "file_id"))
    for request in ("first", "first", "second"):
        store.write(path, named, "yinyang", 2, request=request)
    found = store.read(spark, path, store.load(spark, path).select("filename", "version"))
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("status") == "ok").alias("readable"), F.min(F.sha2("payload", 256)).alias("sha256"))


def compacted_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands of a pool before and after the files of one brand are deleted and their strands removed."""
    path = _stored(spark, sf_dir, _brand_files(spark, sf_dir))
    counted = lambda: store.all_strands(spark, path).agg(F.count(F.lit(1))).first()[0]
    before = counted()
    store.delete(spark, path, spark.createDataFrame([("Brand#11",)], "filename string"), F.lit(1 << 40))
    removed = store.compact(spark, path)
    left = store.read(spark, path, store.load(spark, path).select("filename", "version")).where("status = 'ok'").count()
    return spark.createDataFrame([(before, removed, counted(), left)], "before long, removed long, after long, readable long")


def audited_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log holds after all parts were written and the files of one brand deleted by verbs that note their user."""
    path = scratch(spark, "pool")
    store.write(path, _brand_files(spark, sf_dir), "yinyang", 0, user=F.lit(7))
    store.delete(spark, path, spark.createDataFrame([("Brand#11",)], "filename string"), F.lit(1 << 32), user=F.lit(8))
    return read_audit(spark, f"{path}/audit").groupBy("user_id", "operation").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_file"))


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pool lists after the files of one brand were deleted."""
    path = _stored(spark, sf_dir, _brand_files(spark, sf_dir), 0)
    store.delete(spark, path, spark.createDataFrame([("Brand#11",)], "filename string"), F.lit(1 << 40))
    return store.current(store.load(spark, path)).select("filename", F.col("version").cast("long").alias("version"), "file_id")


def audited_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after all orders were written and those of status F deleted, read back and counted by user and verb."""
    path, o = scratch(spark, "pool"), table(spark, sf_dir, "orders")
    done = o.select(F.col("o_orderkey").alias("file_id"), F.unix_date("o_orderdate").cast("long").alias("created_at") if dict(o.dtypes)["o_orderdate"] == "date" else F.unix_timestamp("o_orderdate").alias("created_at"), (F.col("o_totalprice") > 1000).alias("success"), "o_custkey", "o_orderstatus")
    store.record(path, done, "write", F.col("o_custkey"))
    store.record(path, done.where("o_orderstatus = 'F'"), "delete", F.col("o_custkey"))
    return read_audit(spark, f"{path}/audit").groupBy("user_id", "operation").agg(F.count(F.lit(1)).alias("events"), F.count_if("success").alias("succeeded"))


def rotated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a pool under a key of its own, after the secret was changed and the keys of every tenth were taken away: what either secret opens."""
    path = scratch(spark, "pool")
    files = document_files(spark, sf_dir).withColumn("filename", F.concat_ws(" ", "filename", "file_id"))
    keys.add(spark, path, files, "first")
    boxes = keys.sealed(files, keys.opened(spark, path, "first"))
    store.write(path, boxes, "yinyang", 2)
    # the pool has them now
    forgotten(spark, boxes)
    keys.rotate(spark, path, "first", "second")
    keys.revoke(spark, path, files.where("file_id % 10 = 0"))
    held = store.read(spark, path, store.load(spark, path).select("filename", "version")).select("file_id", "payload")
    # payloads meet both keys of their file at once
    both = held.join(keys.opened(spark, path, "first").withColumnRenamed("key", "old").join(keys.opened(spark, path, "second"), "file_id", "full"), "file_id", "left")
    refused = F.try_aes_decrypt("payload", "old").isNull()
    return both.select("file_id", F.sha2(F.try_aes_decrypt("payload", "key"), 256).alias("sha256"), refused.alias("first_secret_refused"))


def sealed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document sealed under a wrapped key of its own, and opened with the right and a wrong secret."""
    files = document_files(spark, sf_dir)
    boxes = files.select("file_id", store.sealed(F.col("payload"), F.lit("secret"), F.col("file_id").cast("string")).alias("box"))
    right, wrong = store.opened(F.col("box"), F.lit("secret")), store.opened(F.col("box"), F.lit("other"))
    return boxes.select("file_id", F.sha2(right, 256).alias("sha256"), wrong.isNull().alias("wrong_secret_refused"))


QUERIES = {f.__name__: f for f in (stored_versions, read_second_version, migrated_strands, pool_scan, mended_documents, migrated_back, retried_writes, compacted_pool, deleted_files, audited_writes, audited_verbs, rotated_keys, sealed_documents)}

_VERSIONS = "WITH v AS (SELECT p_partkey, p_brand AS filename, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"
ORACLE_SQL = {
    "stored_versions": f"{_VERSIONS} SELECT filename, version, 'ok' AS status, sha256(p_name) AS sha256 FROM v",
    "read_second_version": f"""{_VERSIONS}, a AS (SELECT DISTINCT filename, unnest([2, 1000000]) AS version FROM v)
SELECT filename, CAST(a.version AS BIGINT) AS version, CASE WHEN p_name IS NULL THEN 'missing' ELSE 'ok' END AS status, sha256(p_name) AS sha256 FROM a LEFT JOIN v USING (filename, version)""",
    "migrated_strands": f"""{_VERSIONS}, s AS (SELECT *, octet_length(encode(p_name)) AS size FROM v WHERE version = n)
SELECT filename, 'yinyang' AS codec, n + 1 AS version, CAST(ceil(4 * (size + 4) / 142.0) AS BIGINT) AS strands, 4 * (size + 4) + 8 * CAST(ceil(4 * (size + 4) / 142.0) AS BIGINT) AS nucleotides, sha256(p_name) AS sha256 FROM s""",
    "pool_scan": "WITH c AS (SELECT max(p_partkey) AS id FROM part GROUP BY p_name) SELECT count(*) AS files, count(*) FILTER (id % 10 <> 0) AS healthy, count(*) FILTER (id % 10 = 0) AS corrupted FROM c",
    "mended_documents": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(ceil(6 * (octet_length(encode(coalesce(text, ''))) + 4) / 150.0) AS BIGINT) AS s FROM documents),
t AS (SELECT doc_id, text, CASE WHEN text = '' THEN 0 ELSE len(list_filter(range(0, s), lambda i: i % 252 % 64 = doc_id % 64)) END AS mended FROM d)
SELECT doc_id AS file_id, 'ok' AS status, CAST(mended AS BIGINT) AS mended, sha256(text) AS sha256 FROM t""",
    "migrated_back": f"""{_VERSIONS} SELECT filename, version, 'ternary' AS codec, 'ok' AS status, sha256(p_name) AS sha256 FROM v
UNION ALL SELECT filename, n + 1, 'yinyang', 'ok', sha256(p_name) FROM v WHERE version = n UNION ALL SELECT filename, n + 2, 'ternary', 'ok', sha256(p_name) FROM v WHERE version = n""",
    "retried_writes": "SELECT CAST(p_partkey AS BIGINT) AS file_id, 2 AS versions, 2 AS readable, sha256(p_name) AS sha256 FROM part",
    "compacted_pool": """WITH s AS (SELECT p_brand, CAST(ceil(6 * (octet_length(encode(p_name)) + 4) / 150.0) AS BIGINT) + 4 AS n FROM part)
SELECT CAST(sum(n) AS BIGINT) AS "before", CAST(coalesce(sum(n) FILTER (p_brand = 'Brand#11'), 0) AS BIGINT) AS removed, CAST(sum(n) FILTER (p_brand <> 'Brand#11') AS BIGINT) AS "after", count(*) FILTER (p_brand <> 'Brand#11') AS readable FROM s""",
    "audited_verbs": "SELECT 7 AS user_id, 'write' AS operation, count(*) AS events, CAST(max(p_partkey) AS BIGINT) AS last_file FROM part UNION ALL SELECT 8, 'delete', count(DISTINCT p_brand), CAST(max(p_partkey) AS BIGINT) FROM part WHERE p_brand = 'Brand#11'",
    "deleted_files": f"{_VERSIONS} SELECT filename, version, CAST(p_partkey AS BIGINT) AS file_id FROM v WHERE version = n AND filename <> 'Brand#11'",
    "audited_writes": """WITH e AS (SELECT o_custkey AS user_id, 'write' AS operation, o_totalprice > 1000 AS success FROM orders UNION ALL SELECT o_custkey, 'delete', o_totalprice > 1000 FROM orders WHERE o_orderstatus = 'F')
SELECT CAST(user_id AS BIGINT) AS user_id, operation, count(*) AS events, count(*) FILTER (success) AS succeeded FROM e GROUP BY user_id, operation""",
    "rotated_keys": "SELECT doc_id AS file_id, CASE WHEN doc_id % 10 <> 0 THEN sha256(coalesce(text, '')) END AS sha256, true AS first_secret_refused FROM documents",
    "sealed_documents": "SELECT doc_id AS file_id, sha256(coalesce(text, '')) AS sha256, true AS wrong_secret_refused FROM documents",
}
