"""Periodic runs, personal data and the filter audit against SQL, brute force and planted cases."""

import os
import random
import re
import time
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import filteraudit, kernels, periodic, pii, queries

SF = "/root/testdata/sf0.001"
NEW = ["op11_periodic_runs", "op12_personal_data", "op13_filter_audit"]
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def same_rows(got, want):
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d.notna(), None).map(lambda x: float(x) if isinstance(x, (int, np.integer)) else x).itertuples(index=False)))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", NEW)
def test_same_rows_as_sql(spark, con, name):
    same_rows(queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df())


LONG = "word " * 30 + " ".join(f"w{i % 53} x{i % 7}" for i in range(20_000))
ODD = [
    (None, None, None), (None, "one two", "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", ""), (4, "same text", "en"), (4, "same text", "en"), (5, "same text", "fr"),
    (None, "same text", "fr"), (6, LONG, "en"), (7, LONG, "de"), (8, "éé 中文 \U0001f600 a@b.co 1.2.3.4 " + "ab cd " * 9, "fr"), (9, "CALL +1 (743) 555-3824 NOW", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, DOCS).repartition(5)
    for c in ("id", "mask", "part", "n", "spans", "runs", "good", "digest", "words", "salt", "top"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(4, 1, 0), (4, None, 1), (5, None, None), (6, 1, 0), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))


@pytest.mark.parametrize("name", NEW)
def test_odd_rows_like_sql(spark, odd, labels, name, tmp_path):
    odd.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    if name == "op11_periodic_runs":  # SQL joins all pairs of equal words; brute force below has the long text
        c.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * REPLACE (CASE WHEN length(text) > 1000 THEN NULL ELSE text END AS text) FROM '{tmp_path}/documents.parquet/*.parquet'")
        short = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("text", F.when(F.length("text") <= 1000, F.col("text")))
        short.write.parquet(f"{tmp_path}/short/documents.parquet")
        tmp_path = tmp_path / "short"
    same_rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(queries.ORACLE_SQL[name]).df())


def test_clashing_columns_and_empty_tables(spark, odd, labels):
    assert periodic.periodic_runs(odd).count() == pii.find_personal_data(odd).count() == len(ODD)
    assert filteraudit.audit(filteraudit.cells(odd, labels)).groupBy("part").count().count() == 4
    none = odd.limit(0)
    assert periodic.periodic_runs(none).count() == pii.find_personal_data(none).count() == filteraudit.audit(filteraudit.cells(none, labels)).count() == 0
    assert filteraudit.cells(odd, labels.limit(0)).agg(F.sum("good"), F.sum("documents")).first()[:] == (0, len(ODD))


def plain_runs(words):
    """Every maximal stretch at every lag; of equal bounds the smallest lag."""
    best, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, q, b - a) for (a, b), q in best.items())


def runs_of(texts):
    words = [t.split() for t in texts]
    names = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}
    first = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
    found = periodic.all_runs(np.array([names[w] for x in words for w in x], dtype=np.int64), first)
    return [[(int(s - a), int(q), int(e - s)) for s, e, q in found if a <= s < b] for a, b in zip(first, first[1:])]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = []
    for _ in range(250):
        words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 2)):
            if words:
                at, block = rng.randrange(len(words)), [rng.choice("xyzuvwst") for _ in range(rng.randint(1, 9))]
                words[at:at] = block * rng.randint(1, 6) + block[: rng.randint(0, len(block))]
        texts.append(" ".join(words))
    thue = ["a"]
    while len(thue) < 512:
        thue += ["b" if x == "a" else "a" for x in thue]
    texts += [" ".join(thue), " ".join(["b" if x == "a" else "a" for x in thue] + thue), "q " * 400]
    assert runs_of(texts) == [plain_runs(t.split()) for t in texts]


def test_splitting_keeps_only_what_may_repeat(monkeypatch):
    texts = ["a b c d e f g h i j k l a b c d e f g h i j k l unique x y x y x y x y x y x y x", "all of these words stand here only once and so there is nothing at all"]
    ids = np.array([hash(w) for t in texts for w in t.split()])
    first = np.cumsum([0] + [len(t.split()) for t in texts])
    lo, hi = periodic.surviving(ids, first)
    assert sorted(zip(lo.tolist(), hi.tolist())) == [(0, 24), (25, 38)]
    # a chain that splits one word a round: the rounds all segments share, and then from both ends
    chain = ["u"] + [w for i in range(3000) for w in (f"c{i}", f"c{i + 1}")] + ["z z"] * 8
    began = time.time()
    assert runs_of([" ".join(chain)]) == [[(6001, 1, 16)]]
    assert time.time() - began < 5
    whole = runs_of(texts)
    monkeypatch.setattr(periodic, "ROUNDS", 0)
    assert runs_of(texts) == whole


def test_a_misleading_hash_is_noticed(monkeypatch):
    monkeypatch.setattr(kernels, "mix", lambda x: np.ones_like(x))  # every word's hash the same
    text = " ".join(random.Random(1).choice("ab") for _ in range(120))
    assert runs_of([text, "x y " * 9]) == [plain_runs(text.split()), [(0, 2, 18)]]


def test_a_long_text_of_one_word(spark):
    d = spark.createDataFrame([(1, "w " * 150_000)], "doc_id long, text string")
    row = periodic.periodic_runs(d).first()
    assert [r[:] for r in row["runs"]] == [(0, 150_000, 1)] and row["collapsed_text"] == "w"


def test_spans_equal_the_plain_patterns():
    plain = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }

    def fits(kind, x):
        digits = re.sub("[^0-9]", "", x)
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits)))
        return {"email": True, "ip": all(int(p) <= 255 for p in x.split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]

    rng = random.Random(9)
    pieces = ["a", "@", ".", "-", "+", "1", "7", "25", " ", "(", ")", "%", "b.c", "@d.e", "+1 (743) 555-3824", "1.2.3.4", "4111 1111 1111 1111", "378282246310005", "é", "_", "١", "000000000000"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        for kind, pattern in plain.items():
            want = [m.span() for m in pattern.finditer(text) if fits(kind, m[0])]
            assert list(pii.FINDERS[kind](text)) == want, (kind, text)


def test_checksums_context_and_overlap():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in pii.spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00, please") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE88 3704 0044 0532 0130 00, please") == []
    assert kinds("part 555-123-4567 of the series") == [] and kinds("call me: 555-123-4567") == [("local_phone", "555-123-4567")]
    assert kinds("my SSN is 078-05-1120") == [("national_id", "078-05-1120")] and kinds("lot 078-05-1120") == []
    assert kinds("call +1 743 555-3824") == [("phone", "+1 743 555-3824")]  # the local number lies in a base span
    a, b = pii.spans("mail x@y.org")[0], pii.spans("see x@y.org")[0]
    assert a["score"] == 100 and b["score"] == 90


def test_spans_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "+1" * 200_000, "a@" * 200_000, "+1" + " " * 400_000, "1.1." * 100_000, "1 " * 200_000, "A1" * 200_000, "AB12 " * 80_000, "x@y.z" * 80_000, "a@" + "b." * 200_000):
        began = time.time()
        pii.spans(text)
        assert time.time() - began < 10, text[:10]


def test_subset_states_and_orders(spark):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (32, 3))
    states = filteraudit.subset_states(counts)
    for active in range(32):
        assert (states[active] == counts[[m for m in range(32) if m & active == 0]].sum(axis=0)).all()
    rows = [("p", m, int(counts[m, 0]), int(counts[m, 1]), int(counts[m, 2])) for m in range(32)]
    out = filteraudit.audit(spark.createDataFrame(rows, "part string, mask int, documents long, good long, toxic long")).collect()
    assert {r["filter_order"] for r in out} == {"".join(p) for p in permutations("ABCDE")} and len(out) == 600
    docs = [m for m in range(32) for _ in range(counts[m, 0])]
    total = {}
    for r in out:
        order = [ord(c) - 65 for c in r["filter_order"]]
        f, earlier = order[r["step"] - 1], order[: r["step"] - 1]
        reach = [m for m in docs if not any(m >> e & 1 for e in earlier)]
        assert r["removed"] == sum(m >> f & 1 for m in reach) and r["kept"] == len(reach) - r["removed"]
        assert r["redundant"] == sum(m >> f & 1 for m in docs) - r["removed"] and r["unique_fails"] == counts[1 << f, 0]
        total[f] = total.get(f, 0) + r["removed"]
    assert all(r["shapley"] == total[ord(r["filter_order"][r["step"] - 1]) - 65] for r in out)


def test_periodic_runs_are_those_of_sql_with_nulls_as_none(spark):
    """As ``test_same_rows_as_sql`` has it, without data frames, in which DuckDB 2 gives ``pandas.NA`` for null."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(queries.ORACLE_SQL["op11_periodic_runs"])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    got = [tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
