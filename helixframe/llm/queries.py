"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

WORDS = r"[^\x20\x09-\x0D]+"


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents")).withColumn("containment", F.round("containment", 6))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), coverage=0.6)
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats, removed_words

    out = remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", removed_words().alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), reach=3, width=3, seed=42)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .exactdedup import DigestIndex

    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    out = index.ingest_in_two(table(spark, sf_dir, "documents"))
    index.drop()
    return out


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Target, mix

    return mix(table(spark, sf_dir, "documents"), Target(repeats=2.0))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def planted_runs(docs: DataFrame) -> DataFrame:
    """Documents with a periodic stretch in the words of about every tenth: doc_id, text (words joined by one space there).

    h is the CRC-32 of the decimal doc_id, g = floor(h / 10).  Where h % 10 is 0
    and there are n > 0 words, each word i from a = g % n on becomes word
    a + (i - a) % p, with p = 1 + floor((n - a) / (3 + g % 8)).
    """
    n, h = F.size("words").cast("long"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.coalesce(h % 10, F.lit(1)) == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    marked = marked.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(WORDS), 0)))
    marked = marked.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))), " ")
    return marked.select("doc_id", F.when(F.col("chosen") & (n > 0), again).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import longest, periodic_runs

    out = periodic_runs(planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", longest("runs"))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import ADDED, BASE, counted, find_personal_data, listed

    out = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [counted("spans", k).alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(listed("spans", BASE), 256).alias("base_sha256"), listed("spans", BASE + ADDED).alias("spans"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filteraudit import audit, cells

    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_output": op4_token_output,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_source_mixing": op9_source_mixing,
    "op10_url_filters": op10_url_filters,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_personal_data": op12_personal_data,
    "op13_filter_audit": op13_filter_audit,
}

OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35
), k AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM p
), again AS (
  SELECT h FROM k GROUP BY h HAVING count(*) > 1
), hit AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(0, 35)) AS j FROM k SEMI JOIN again USING (h))
), gone AS (
  SELECT doc_id, list(pos) AS lost FROM hit GROUP BY doc_id
), parts AS (
  SELECT w.doc_id, len(words) AS n, len(coalesce(lost, [])) AS m,
    CASE WHEN lost IS NULL THEN words
         ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(lost, x[2])), lambda x: x[1]) END AS kept
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM parts
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: All pairs of equal six-word sequences, joined by lag into maximal stretches; CRC-32 bit by bit.
OP11_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, coalesce(CAST(doc_id AS VARCHAR), '') AS d FROM documents
), h AS (
  SELECT *, len(words) AS n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) AS h FROM w
), g AS (
  SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM h
), t AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 AND doc_id IS NOT NULL THEN list_transform(range(0, n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE words END AS words FROM g
), k AS (
  SELECT r, i, md5(array_to_string(words[i + 1:i + 6], ' ')) AS h FROM (SELECT r, words, unnest(range(0, n - 5)) AS i FROM t WHERE n >= 12)
), pairs AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.r = y.r AND x.h = y.h AND y.i > x.i
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length
), best AS (
  SELECT r, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := period), struct_pack(l := -length, s := start, p := period)) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY r
), gone AS (
  SELECT r, list(DISTINCT i) AS lost FROM (SELECT r, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY r
), kept AS (
  SELECT t.r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM (SELECT r, unnest(words) AS word, unnest(range(0, n)) AS i FROM t) t
  ANTI JOIN (SELECT r, unnest(lost) AS i FROM gone) g ON t.r = g.r AND t.i = g.i GROUP BY t.r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def personal_data_sql() -> str:
    """Spans by plain patterns: a text is cut into matches and the characters between, whose lengths add up to positions."""
    from .pii import ACCEPTED, ADDED, BASE, CONTEXT, CONTEXT_WORDS, REACH, SCORES

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[A-Za-z0-9._%+-]+|[^A-Za-z0-9._%+-]+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)|[0-9]+|[^0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+|[0-9]|[^0-9]+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]|\+|[^+]+",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b|[A-Z]|[^A-Z]+",
        "national_id": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b|[0-9]|[^0-9]+",
        "local_phone": r"\b[0-9]{3}[ -][0-9]{3}-[0-9]{4}\b|[0-9]|[^0-9]+",
    }
    digits = "regexp_replace(tok, '[^0-9]', '', 'g')"
    luhn = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[length(d) + 1 - i] AS INT) ELSE (2 * CAST(d[length(d) + 1 - i] AS INT)) // 10 + (2 * CAST(d[length(d) + 1 - i] AS INT)) % 10 END)) % 10 = 0"
    turned = "substr(replace(tok, ' ', ''), 5) || substr(tok, 1, 4)"
    mod97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({turned}) + 1), lambda i: ascii(({turned})[i])::BIGINT)), lambda s, c: CASE WHEN c < 58 THEN (s * 10 + c - 48) % 97 ELSE (s * 100 + c - 55) % 97 END) = 1"
    tests = {
        "email": "contains(tok, '@') AND length(tok) > 1 AND regexp_full_match(tok, '[A-Za-z0-9._%+-]+@.*')",
        "ip": r"regexp_full_match(tok, '[0-9]+(\.[0-9]+){3}') AND list_max(list_transform(string_split(tok, '.'), lambda x: TRY_CAST(x AS HUGEINT))) <= 255 AND len(list_filter(string_split(tok, '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NULL)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND length(tok) > 1 AND tok[1] BETWEEN '0' AND '9' AND {luhn}",
        "phone": f"tok[1] = '+' AND length({digits}) BETWEEN 9 AND 15",
        "iban": f"length(tok) > 1 AND regexp_full_match(tok, '[A-Z]{{2}}[0-9]{{2}}.*') AND {mod97}",
        "national_id": "regexp_full_match(tok, '[0-9]{3}-[0-9]{2}-[0-9]{4}')",
        "local_phone": "regexp_full_match(tok, '[0-9]{3}[ -][0-9]{3}-[0-9]{4}')",
    }
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts, rank = [], {k: i for i, k in enumerate(BASE + ADDED)}
    for k, pattern in patterns.items():
        near = r"\b(?:" + "|".join(CONTEXT_WORDS[k]) + r")\b"
        before, behind = lower.format(f"substr(text, greatest(s - {REACH}, 0) + 1, least(s, {REACH}))"), lower.format(f"substr(text, s + length(tok) + 1, {REACH})")
        score = f"{SCORES[k]} + CASE WHEN regexp_matches({before}, '{near}') OR regexp_matches({behind}, '{near}') THEN {CONTEXT} ELSE 0 END"
        parts.append(f"""SELECT r, '{k}' AS kind, {rank[k]} AS rank, s, s + length(tok) AS e, {score} AS score FROM (
          SELECT *, {digits} AS d FROM (SELECT r, tok, CAST(sum(length(tok)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) - length(tok) AS s
          FROM (SELECT r, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS toks FROM docs)))) JOIN docs USING (r) WHERE {tests[k]}""")
    base = ", ".join(f"'{k}'" for k in BASE)
    own = f"kind IN ({base})"
    item = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
fine AS (SELECT * FROM found f WHERE {own} OR score >= {ACCEPTED} AND NOT EXISTS (SELECT 1 FROM found b WHERE b.r = f.r AND b.{own} AND b.s < f.e AND f.s < b.e)),
each AS (SELECT r, {sums}, string_agg({item}, ',' ORDER BY s, rank) FILTER ({own}) AS base, string_agg({item}, ',' ORDER BY s, rank) AS spans FROM fine GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN each USING (r)"""


OP13_SQL = r"""
WITH marks AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(again, false) AS INT) AS mask
  FROM d LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS filter, CAST(1 << (ascii(filter_order[step]) - 65) AS INT) AS bit,
    CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS INT) AS earlier
  FROM orders, range(1, 6) s(step)
), each AS (
  SELECT part, filter_order, step, filter, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM each
"""

ORACLE_SQL: dict[str, str] = {"op3_substring_dedup": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op11_periodic_runs": OP11_SQL, "op12_personal_data": personal_data_sql(), "op13_filter_audit": OP13_SQL}
