"""Queries on logs, texts and search: audit, streams, commands, likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agent, audit, pool, search, vectors
from ..sources.tables import document_files, scratch, table
from ..streaming import audit as stream
from . import sql


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an audit log: an event without a value failed."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("operation"), "user_id", (F.coalesce("value", F.lit(0.0)) >= 10).alias("success"))


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counts(_log(spark, sf_dir))


def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five events of each operation."""
    return audit.tail(_log(spark, sf_dir), 5, "operation").select("operation", F.col("age").cast("long").alias("age"), "event_id")


def pool_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges of the pool of all documents, and event counts, as (metric, value)."""
    files = pool.catalog(document_files(spark, sf_dir))
    sums = files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("data_strands").alias("data_strands"), F.sum("parity_strands").alias("parity_strands"))
    gauges = sums.select(F.explode(F.array(*(F.struct(F.lit(f"pool_{c}").alias("metric"), F.col(c).cast("long").alias("value")) for c in sums.columns)))).select("col.*")
    name = F.concat(F.lit("pool_audit_events_total/"), "operation", F.lit("/"), F.col("success").cast("string"))
    return gauges.unionByName(audit.counts(_log(spark, sf_dir)).select(name.alias("metric"), F.col("events").alias("value")))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type, counted by a stream that is run to its end."""
    events = table(spark, sf_dir, "events")
    arrived = scratch(spark, "events")  # a stream reads a folder
    events.write.parquet(arrived)
    rows = stream.drained(spark, arrived, events.schema, stream.windowed, scratch(spark, "stream"))
    newest = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("events", "value"), "batch").alias("n"))
    return newest.select("window_start", "event_type", "n.events", "n.value")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, ended by half an hour without events."""
    return stream.sessions(table(spark, sf_dir, "events"))


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions, found by a stream that is run to its end."""
    events = table(spark, sf_dir, "events")
    arrived = scratch(spark, "events")
    events.write.parquet(arrived)
    return stream.drained(spark, arrived, events.schema, stream.sessions, scratch(spark, "stream"), whole=True).drop("batch")


def command_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return agent.plans(c).select("conv_id", "turn", "tool", "filename", F.coalesce("redundancy", F.lit(-1)).cast("long").alias("redundancy"), "codec")


def command_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn gives as data, and what it asks to look for."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(agent.data(text), 256).alias("data_sha256"), F.sha2(agent.query(text), 256).alias("query_sha256"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.catalog(document_files(spark, sf_dir)).select("file_id", "filename", "size", "content_hash")


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten English files of one source in a size range."""
    return search.search(_catalog(spark, sf_dir), "name:src1/ type:en size:>500 size:<5000", 10).select("file_id", "filename", "size", "score")


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten files whose metadata is most like a text."""
    return search.search(_catalog(spark, sf_dir), "small text src3/12.en", 10).select("file_id", F.round("score", 6).alias("score"))


def file_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's metadata vector, by its weighted sum and its greatest entry."""
    v = search.file_vector(F.col("filename"), F.col("size"), F.col("content_hash"))
    made = _catalog(spark, sf_dir).select("file_id", v.alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return made.select("file_id", F.round(weighted, 6).alias("weighted"), F.round(F.array_max("v"), 6).alias("greatest"), F.size("v").cast("long").alias("dim"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten embeddings nearest to the first one."""
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").select(F.transform("embedding", lambda x: x.cast("double")).alias("v")).first()["v"]
    return search.nearest(e, F.array(*map(F.lit, first)), 10)


def nearest_to_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten embeddings nearest to each whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return search.nearest_to_each(e, e.where("vec_id % 20 = 0"), 10)


def indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index on disk, from which every seventh embedding is removed and half of these inserted again."""
    e, path = table(spark, sf_dir, "embeddings"), scratch(spark, "vectors")
    vectors.create(path, e)
    vectors.remove(spark, path, e.where("vec_id % 7 = 0"))
    vectors.insert(spark, path, e.where("vec_id % 14 = 0"))
    return vectors.search(spark, path, e.where("vec_id % 20 = 0"), 10).select("query_id", "vec_id", "score")


QUERIES = {f.__name__: f for f in (audit_counts, audit_tail, pool_metrics, event_windows, event_sessions, streamed_sessions, command_plans, command_data, search_filtered, search_ranked, file_vectors, nearest_vectors, nearest_to_each, indexed_nearest)}

_LOG = "WITH l AS (SELECT event_id, ts, event_type AS operation, coalesce(value, 0) >= 10 AS success FROM events)"
_QUERY = "small text src3/12.en"


def _name(text: str) -> str:
    return f"list_transform(range(0, 16), lambda k: coalesce(list_sum(list_transform(list_filter(range(0, len({text})), lambda i: i % 16 = k), lambda i: {text}[i + 1] / 255.0)), 0) / greatest(len({text}), 1))"


def _vectors() -> str:
    """Metadata vectors of all documents in SQL."""
    ext = "CASE WHEN contains(filename, '.') THEN regexp_extract(filename, '[^.]*$') ELSE filename END"
    return f"""d AS ({sql.DOCUMENT_FILES}), c AS (SELECT file_id, size, {sql.byte_list("encode(filename)")} AS b, substr(sha256(text), 1, 16) AS h, {ext} AS ext FROM d),
e AS (SELECT *, list_reduce({sql.byte_list("encode(ext)")}, lambda a, x: (a * 33 + x) % 4294967296, CAST(5381 AS BIGINT)) AS j FROM c),
r AS (SELECT file_id, list_concat({_name("b")}, [CASE WHEN size > 0 THEN greatest(ln(size), 0) / 30 ELSE 0 END, least(size / 1e6, 1), CASE WHEN size < 1024 THEN 1 ELSE 0 END, CASE WHEN size > 1000000 THEN 1 ELSE 0 END],
  list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) / 255.0), [j % 256 / 255.0, j // 256 % 256 / 255.0, CASE WHEN ext IN ('txt', 'md', 'log', 'csv') THEN 1 ELSE 0 END, CASE WHEN ext IN ('jpg', 'png', 'gif', 'bmp') THEN 1 ELSE 0 END]) AS v FROM e),
n AS (SELECT file_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM r), u AS (SELECT file_id, list_transform(v, lambda x: x / norm) AS v FROM n)"""


ORACLE_SQL = {
    "audit_counts": f"{_LOG} SELECT operation, success, count(*) AS events FROM l GROUP BY operation, success",
    "audit_tail": f"{_LOG} SELECT operation, age, event_id FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, event_id DESC) AS age FROM l) WHERE age <= 5",
    "pool_metrics": f"""{_LOG}, d AS ({sql.DOCUMENT_FILES}), c AS (SELECT size, CASE WHEN size > 0 THEN CAST(ceil(6 * (size + 4) / 150.0) AS BIGINT) ELSE 0 END AS s FROM d)
SELECT 'pool_files' AS metric, count(*) AS value FROM c UNION ALL SELECT 'pool_bytes', CAST(sum(size) AS BIGINT) FROM c UNION ALL SELECT 'pool_data_strands', CAST(sum(s) AS BIGINT) FROM c
UNION ALL SELECT 'pool_parity_strands', CAST(sum(4 * CAST(ceil(s / 252.0) AS BIGINT)) AS BIGINT) FROM c
UNION ALL SELECT 'pool_audit_events_total/' || operation || '/' || success, count(*) FROM l GROUP BY operation, success""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, k""",
    "search_filtered": f"WITH d AS ({sql.DOCUMENT_FILES}) SELECT file_id, filename, size, CAST(1 AS DOUBLE) AS score FROM d WHERE contains(lower(filename), 'src1/') AND ends_with(lower(filename), '.en') AND size BETWEEN 500 AND 5000 ORDER BY file_id LIMIT 10",
    "file_vectors": f"WITH {_vectors()} SELECT file_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) AS weighted, round(list_max(v), 6) AS greatest, CAST(len(v) AS BIGINT) AS dim FROM u",
    "search_ranked": f"""WITH {_vectors()}, q0 AS (SELECT {sql.byte_list(f"encode('{_QUERY}')")} AS b), q AS (SELECT list_concat({_name("b")}, [0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0]) AS w FROM q0)
SELECT file_id, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(w AS DOUBLE[])), 6) AS score FROM u, q ORDER BY round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(w AS DOUBLE[])), 9) DESC, file_id LIMIT 10""",
    "nearest_vectors": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS w FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), w), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""",
    "indexed_nearest": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e AS q WHERE q.vec_id % 20 = 0 AND (e.vec_id % 7 <> 0 OR e.vec_id % 14 = 0))
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "nearest_to_each": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e AS q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
}

_SPLIT = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"
_TOOL = "CASE " + " ".join(f"WHEN list_has_any({_SPLIT}, [{', '.join(repr(w) for w in asked)}]) THEN '{name}'" for name, asked in agent.TOOLS) + " END"
_END = "|".join(agent.ENDINGS)
ORACLE_SQL["command_plans"] = rf"""WITH t AS (SELECT *, {_TOOL} AS tool,
  coalesce(nullif(regexp_extract(lower(text), '(?:^|\s)([0-9]{{1,4}})[x×](?:\s|$)', 1), ''), nullif(regexp_extract(lower(text), '(?:^|\s)(?:redundancy|parity)\s+([0-9]{{1,4}})(?:\s|$)', 1), '')) AS r,
  nullif(regexp_extract(lower(text), '(?:^|\s)codec\s+(\S+)', 1), '') AS c FROM conversations)
SELECT conv_id, turn, tool,
  coalesce(nullif(regexp_extract(text, '"([^"]*)"', 1), ''), nullif(regexp_extract(text, '''([^'']*)''', 1), ''), nullif(regexp_extract(text, '(?i) as\s+([^\s]*\.[^\s]*)', 1), ''),
    nullif(regexp_extract(text, '(?i)(?:^|\s)[^\w.\-\s]*([^\s]*\.(?:{_END}))[^\w.\-\s]*(?:\s|$)', 1), '')) AS filename,
  CASE WHEN tool = 'store' THEN coalesce(CAST(r AS BIGINT), 2) ELSE coalesce(CAST(r AS BIGINT), -1) END AS redundancy,
  CASE WHEN c IN ('ternary', 'ternary-rotating-cipher') THEN 'ternary-rotating-cipher' WHEN c IN ('yin-yang', 'yinyang', 'yin_yang') THEN 'yin-yang' ELSE c END AS codec FROM t"""


def _behind(word: str, text: str) -> str:
    return f"CASE WHEN instr(lower(text), '{word}') > 0 THEN nullif(trim(substr({text}, instr(lower(text), '{word}') + {len(word)})), '') END"


_DATA = ", ".join(f"nullif(regexp_replace({_behind(w, 'text')}, '^[:= ]+', ''), '')" for w in agent.DATA_WORDS)
_ASKED = ", ".join(_behind(w, "lower(text)") for w in agent.QUERY_WORDS)
ORACLE_SQL["command_data"] = f"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), d AS (SELECT conv_id, turn, coalesce({_DATA}, '') AS data, coalesce({_ASKED}) AS query FROM t)
SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(data, '^"[^"]*"') THEN regexp_extract(data, '^"([^"]*)"', 1) ELSE data END) AS data_sha256, sha256(query) AS query_sha256 FROM d"""
ORACLE_SQL["streamed_sessions"] = ORACLE_SQL["event_sessions"]
