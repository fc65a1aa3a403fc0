"""The numbered operators against brute force, SQL and planted cases on small tables."""

import hashlib
import os
import time
import uuid
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import decontam, exactdedup, kernels, licenses, mixing, quality, queries, simhash, substring, tokenbin, toxicity, urlrules

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def odd_rows():
    """Nulls everywhere, empty and blank texts, ties, repeated rows, a long text, other scripts."""
    long = " ".join(f"word{i % 977} the" for i in range(60_000))
    return [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (5, "one", "en", "b", 3),
        (6, long, "en", "a", len(long)), (7, long, "en", "a", len(long)), (None, "one", "en", "a", 3), (8, "éé 中文 \U0001f600 <|endoftext|> \x1c it's", "fr", "", 9), (9, "Released under the MIT License.", "en", "a", 9),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """With further columns whose names are those that operators use."""
    d = spark.createDataFrame(odd_rows(), DOCS)
    for c in ("id", "block", "row", "key", "value", "score", "fp", "kept", "tokens", "epoch", "h", "x", "mix_source", "times"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def every_operator(spark, d, labels, bench):
    pages = d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "score")
    return {
        "licenses": licenses.scan(d), "decontam": decontam.contaminated(d, bench), "substring": substring.remove_repeats(d), "tokens": tokenbin.round_trip(d, queries.tokenizer_path()),
        "simhash": simhash.near_duplicates(d), "quality": quality.score(spark, d, labels), "exact": exactdedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}").ingest(d),
        "toxicity": toxicity.score(spark, d, labels), "mixing": mixing.mix(d), "urls": urlrules.judge(pages),
    }


def test_odd_rows_have_results(spark, odd, labels):
    bench = spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, ""), (3, "word1 the word2 the word3 the word4 the"), (4, "x y")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    out = {k: v.collect() for k, v in every_operator(spark, odd, labels, bench).items()}
    n = len(odd_rows())
    assert all(len(out[k]) == n for k in ("substring", "tokens", "simhash", "quality", "exact", "toxicity", "urls"))
    assert {(r["doc_id"], r["license"]) for r in out["licenses"]} == {(9, "mit-notice")}
    assert {(r["doc_id"], r["item_id"]) for r in out["decontam"]} == {(6, 3), (7, 3)}
    ones = {r["keep_id"] for r in out["exact"] if r["group_size"] == 4}
    assert ones == {5}
    zero = {r["fingerprint"] for r in out["simhash"] if r["doc_id"] in (1, 2, 3)}
    assert zero == {"0" * 16}
    assert all(0 <= r["score"] <= 1 for k in ("quality", "toxicity") for r in out[k])
    assert {r["doc_id"] for r in out["mixing"]} == {r[0] for r in odd_rows()}


def test_empty_tables_have_empty_results(spark, odd, labels):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = every_operator(spark, odd.limit(0), labels.limit(0), bench)
    assert all(v.count() == 0 for v in out.values())


def test_pipeline_stages_on_odd_rows(spark, odd):
    import corpus_pipeline

    d = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, d, SF)
        assert after.columns == odd.columns
        d = after
    kept = d.collect()
    assert {r["text"] for r in kept if r["doc_id"] in (6, 7)} == {odd_rows()[7][1]}
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == len(kept)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    want = con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF).toPandas()[columns]
    # numbers as floats, as a column with nulls has them; null isn't equal to itself
    plain = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, np.integer)) else x
    rows = lambda d: sorted(repr(tuple(map(plain, r))) for r in d.itertuples(index=False, name=None))
    assert rows(got) == rows(want[columns])


def test_word_hashes_depend_on_the_word_alone():
    import pyarrow as pa

    data, offsets = kernels.text_buffers(pa.array(["b a", None, "a  b\n", "ab", "a" * (kernels.PIECE + 9) + " a"]))
    words = kernels.find_words(data, offsets)
    h = kernels.hash_words(words)
    assert words.first.tolist() == [0, 2, 2, 4, 5, 7]
    assert h[0] == h[3] and h[1] == h[2] == h[6] and len(set(h.tolist())) == 4


def license_windows(text, name):
    """By brute force: the greatest share of a template's shingles in any run of as many shingles, and in one half longer again."""
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside, g = set(grams(words(licenses.TEMPLATES[name]))), grams(words(text or ""))
    m = len(inside)
    share = lambda n: max((len(inside & set(g[a : a + n])) / m for a in range(max(1, len(g) - n + 1))), default=0)
    return share(m), share(m + 2 * max(1, m // 4))


def same_licenses(found, texts):
    """All that a window of the template's length contains is found, and nothing that a widened one doesn't contain."""
    for i, text in texts.items():
        for name in licenses.TEMPLATES:
            exact, wide = license_windows(text, name)
            assert (i, name) in found or exact < licenses.CONTAINED, (i, name, exact)
            assert (i, name) not in found or wide >= licenses.CONTAINED, (i, name, wide)


def test_license_scan_equals_brute_force(spark, docs, texts):
    some = [i for i, t in texts.items() if "icens" in t or "ermission" in t or "oftware" in t or "edistribut" in t]
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()}
    assert {i for i, _ in found} <= set(some) and found
    same_licenses(found, {i: texts[i] for i in some})


def test_long_licenses_are_found_in_longer_texts(spark):
    texts = {}
    for k, name in enumerate(licenses.TEMPLATES):
        words = licenses.TEMPLATES[name].split()
        texts[3 * k] = f"{unlike(k, 150)} {licenses.TEMPLATES[name].upper()} {unlike(k + 99, 90)}"
        texts[3 * k + 1] = " ".join("changed" if j % 29 == 28 else w for j, w in enumerate(words))  # most shingles stay
        texts[3 * k + 2] = " ".join("changed" if j % 6 == 5 else w for j, w in enumerate(words))  # few do
    found = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all((3 * k, name) in found for k, name in enumerate(licenses.TEMPLATES))
    same_licenses(found, texts)


def greedy_cover(doc, item):
    """Share of ``item`` that greedy tiling covers, by trying every pair of words."""
    free_doc, free_item = [True] * len(doc), [True] * len(item)
    while True:
        best = (4, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and free_doc[a + n] and free_item[b + n] and doc[a + n] == item[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < 5:
            return 1 - sum(free_item) / len(item)
        for k in range(n):
            free_doc[a + k] = free_item[b + k] = False


def test_tiling_equals_brute_force(spark):
    import random

    rnd = random.Random(4)
    items = [[f"w{rnd.randrange(60)}" for _ in range(rnd.randint(4, 40))] for _ in range(6)]
    docs = []
    for k in range(40):
        words = [f"x{rnd.randrange(90)}" for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 4)):
            item = rnd.choice(items)
            a = rnd.randrange(len(item))
            at = rnd.randint(0, len(words))
            words[at:at] = item[a : a + rnd.randint(3, 25)]
        docs.append(words)
    want = {}
    for i, d in enumerate(docs):
        for j, item in enumerate(items):
            share = greedy_cover(d, item) if len(item) >= 5 else 0
            if share >= 0.5:
                want[i, j] = share
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.contaminated(d, b, coverage=0.5).collect()}
    assert len(want) > 10 and got == pytest.approx(want)


def test_tiling_of_repetitive_texts_is_linear():
    import time

    same, two = np.zeros(20_000, dtype=np.uint64), np.random.default_rng(1).integers(0, 2, 20_000, dtype=np.uint64)
    begin = time.time()
    assert decontam.tile(same, same[:19_999]) == [(0, 0, 19_999)]
    assert sum(n for *_, n in decontam.tile(two, two[::-1].copy())) > 15_000
    assert time.time() - begin < 60


def test_tokens_are_those_of_the_library(spark, docs, texts):
    from tokenizers import Tokenizer

    whole, at = Tokenizer.from_file(queries.tokenizer_path()), 0
    got = {r["doc_id"]: r for r in tokenbin.round_trip(docs, queries.tokenizer_path()).collect()}
    for i in sorted(texts):
        ids = np.array(whole.encode(texts[i], add_special_tokens=False).ids + [2], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_have_filters_and_can_be_pruned(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenbin.write_tokens(docs, path, queries.tokenizer_path())
    one = spark.read.orc(path).where("doc_id = 7")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_encoder_equals_library_on_odd_texts():
    import random

    e, rnd = tokenbin.Encoder(queries.tokenizer_path()), random.Random(5)
    made = ["".join(rnd.choice("añöaB'sé́İΣ. ,!<|>\n\t  9½中#\x1c") for _ in range(rnd.randint(1, 25))) for _ in range(600)]
    made += ["a<|endoftext|>b", "<|ENDOFTEXT|>,c", "it's. ''", "ß ﬁ ŉ"]
    assert e.encode(made) == [e._direct(t) for t in made]


def test_encoder_keeps_frequent_words_and_no_more_than_it_may(monkeypatch):
    import random

    monkeypatch.setattr(tokenbin, "WORD_CACHE", 40)
    e, rnd = tokenbin.Encoder(queries.tokenizer_path()), random.Random(6)
    for k in range(60):
        made = [f"the {rnd.choice('abcde')}{rnd.randint(0, 99)}é, of the, word{'xyz'[k % 3]}" for _ in range(5)]
        assert e.encode(made) == [e._direct(t) for t in made]
        assert b"the" in e.words and len(e.words) + len(e.older) <= 40 + 2 * 5 * 5


def reference_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("leaf, home, visits", [(simhash.LEAF, simhash.HOME, simhash.VISITS), (10, 8, 30)])
def test_simhash_components_are_exact(spark, docs, texts, monkeypatch, leaf, home, visits):
    for name, value in (("LEAF", leaf), ("HOME", home), ("VISITS", visits)):  # one leaf, and many that are grids of cells
        monkeypatch.setattr(simhash, name, value)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    fp = {i: reference_fingerprint(texts[i]) for i in ids}
    assert all(got[i]["fingerprint"] == f"{fp[i]:016x}" for i in ids)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert {i: got[i]["component_id"] for i in ids} == {i: top(i) for i in ids}


def test_vantage_tree_misses_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(3)]))
    dealt = list(simhash.VantageTree.grow(fps[::3], 5).deal(fps, 3))
    assert sorted(np.concatenate([at for at, _, lives in dealt if lives]).tolist()) == list(range(len(fps)))
    label = np.arange(len(fps))
    for leaf in {k for _, k, _ in dealt}:
        home = np.concatenate([at for at, k, lives in dealt if k == leaf and lives])
        both = np.concatenate([at for at, k, _ in dealt if k == leaf])
        a, b = simhash.link_cell(fps[home], fps[both], 3)
        label = simhash.unite(label, np.searchsorted(fps, a), np.searchsorted(fps, b))
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = simhash.unite(np.arange(len(fps)), near[:, 0], near[:, 1])
    assert (label == want).all()


def test_components_join_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def unlike(seed, n=80):
    import random

    rnd = random.Random(seed)
    return " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(9999)) for _ in range(n))


def test_near_dedup_keeps_each_unlike_row_whatever_its_id(spark):
    a, b, c, d, e, f = map(unlike, range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (5, c), (7, d), (7, e), (7, e), (8, f), (None, f), (9, f), (None, None), (None, "")]
    got = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter([(None, a), (None, b), (5, c), (7, d), (7, e), (8, f), (None, "")])


def test_decontamination_drops_rows_by_their_text(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    bad, good = "see one two three four five six seven", unlike(1)
    rows = [(None, bad), (None, good), (4, bad), (4, good), (5, None), (None, None)]
    got = decontam.without_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter(tuple(r) for r in got) == Counter([(None, good), (4, good), (5, None), (None, None)])


def test_quality_holds_on_rows_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op6_quality_classifier(spark, sf).collect()}
    known = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in known]) > 0.95


def test_index_keeps_earlier_documents(spark):
    index = exactdedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)
    first = spark.createDataFrame([(5, "a"), (9, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(50, "a"), (60, "c"), (61, "c")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in index.ingest(first).collect()} == {(5, 9, False), (9, 9, True), (2, 2, True)}
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in index.ingest(second).collect()} == {(50, 9, False), (60, 61, False), (61, 61, True)}
    assert spark.table(index.name).count() == 3
    again = {(r["doc_id"], r["keep_id"], r["kept"]) for r in index.ingest(second).collect()}
    assert again == {(50, 9, False), (60, 61, False), (61, 61, True)}
    larger = index.ingest(second.unionByName(spark.createDataFrame([(99, "c"), (61, "c")], second.schema)))
    assert Counter((r["doc_id"], r["keep_id"]) for r in larger.collect() if r["kept"]) == {(61, 61): 1}
    same = spark.createDataFrame([(7, "d"), (7, "d"), (7, "e"), (None, "d"), (None, None), (None, "")], "doc_id long, text string")
    kept = Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in index.ingest(same).collect() if r["kept"])
    assert kept == {(7, 7, 3): 1, (7, 7, 1): 1, (None, None, 2): 1}
    index.drop()


def test_index_is_asked_by_a_sort_merge_anti_join(spark):
    index = exactdedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)
    plans = []
    append = index._append
    index._append = lambda rows: (plans.append(rows._jdf.queryExecution().toString()), append(rows))
    index.ingest(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert "SortMergeJoin" in plans[-1] and "LeftAnti" in plans[-1]
    index.drop()


def test_toxic_words_are_learned_and_rare_ones_are_not(spark):
    import random

    rnd = random.Random(1)
    plain = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(900):
        words = [rnd.choice(plain) for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            for k in range(3):
                words[k * 7] = rnd.choice(["vile", "foul"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(spark, d, spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas().set_index("doc_id")
    seen = [(got.predicted[i], t) for i, t in marks if got.held_out[i]]
    assert np.mean([a == b for a, b in seen]) > 0.97


def kneser_ney(marked, part):
    """Brute force P(w | v) of both classes from ``marked`` (text, toxic), and the words that have been seen."""
    x = [Counter(), Counter()]
    for t, c in marked:
        words = [toxicity.START, *t.split(), toxicity.END] if t.split() else []
        x[c].update(zip(words, words[1:]))
    d, d1, d2, b = toxicity.DISCOUNT, toxicity.WORD_DISCOUNT, toxicity.PAIR_DISCOUNT, toxicity.PAIR_PRIOR
    words = {w for k in x for _, w in k}
    both = {w: len({v for k in x for v, z in k if z == w}) for w in words}
    total = sum(both.values())
    shared = lambda w: (max(both.get(w, 0) - d, 0) + d * len(words) / (len(words) + 1)) / total
    probability = []
    for k, f in zip(x, part):
        u, n, m = Counter(), Counter(), Counter()
        for (v, w), c in k.items():
            u[w] += 1 - (1 - f) ** c if f < 1 else 1
            n[v] += f * c
            m[v] += min(f * c, d2)
        lesser, all_u = sum(min(c, d1) for c in u.values()), sum(u.values())
        word = lambda w, u=u, lesser=lesser, all_u=all_u: (max(u[w] - d1, 0) + lesser * shared(w)) / all_u
        probability.append(lambda v, w, k=k, f=f, n=n, m=m, word=word: (max(f * k[v, w] - d2, 0) + (b + m[v]) * word(w)) / (n[v] + b))
    return probability, words


def test_toxic_models_are_kneser_ney_over_every_count(spark, monkeypatch):
    import random

    for name, value in (("WORD_DISCOUNT", 2.5), ("PAIR_DISCOUNT", 1.5), ("PAIR_PRIOR", 20.0)):
        monkeypatch.setattr(toxicity, name, value)
    rnd = random.Random(2)
    marked = [(" ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(40)), int(i % 5 == 0)) for i in range(150)] + [("", 1)]
    ours = [t for t, _ in marked[::7]] + ["w1 w2 never1 w1", "w3"]
    (ordinary, toxic), words = kneser_ney(marked, (0.25, 1.0))
    for p in (ordinary, toxic):
        for v in (toxicity.START, "w1", "w2", "never1"):
            assert abs(sum(p(v, w) for w in words | {"never2"}) - 1) < 1e-9

    def want(t):
        w = [toxicity.START, *t.split(), toxicity.END]
        return sum(np.log(toxic(*p) / ordinary(*p)) for p in zip(w, w[1:])) / (len(w) - 1 + toxicity.NEUTRAL)

    train = spark.createDataFrame([(t, bool(c)) for t, c in marked], "text string, toxic boolean")
    asked = spark.createDataFrame([((t,),) for t in ours + [""]], "row struct<text:string>")
    for bits in ((5, 0), (3, 2)):  # hot words whole, and split by the word before
        table, other = toxicity.weighed(toxicity.summed(toxicity.counted(train, *bits), (0.25, 1.0)).cache())
        assert table.where("pair").count() > 5
        for size in (1 << 20, 200):  # one block, and several
            got = {r["text"]: r["ratio"] for r in toxicity.ToxicModel.of(table, other, size).ratios(asked).select("row.text", "ratio").collect()}
            assert got.pop("") == 0 and set(got) == set(ours)
            assert all(abs(got[t] - want(t)) < 1e-9 for t in ours)


def test_encoder_learns_a_word_once(monkeypatch):
    e, learned = tokenbin.Encoder(queries.tokenizer_path()), []

    def learn(missing):
        learned.extend(missing)
        e.words.update((w, b"") for w in missing)

    monkeypatch.setattr(e, "_learn", learn)
    texts = [" ".join(f"x{i}" for i in range(k, k + 20_000)) for k in range(0, 220_000, 20_000)]
    for t in texts * 2:
        e.encode([t])
    assert len(learned) == 220_000


def test_toxic_model_has_every_bigram_of_the_smaller_class(spark):
    marked = [(f"a{i} b{i} c{i}", i % 2 == 0) for i in range(20)] + [("a1 b2 c3", False)] * 3
    train = spark.createDataFrame(marked, "text string, toxic boolean")
    table, _ = toxicity.weighed(toxicity.summed(toxicity.counted(train, 3, 2), (0.5, 1.0)).cache())
    # the toxic ones, and of the others those seen twice or more
    assert table.where("pair").count() == 10 * 4 + 4
    assert table.where("pair and value <> 0").count() == 10 * 4 + 4


def test_several_blocks_of_a_toxic_model_are_one_pass_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD_TEXT", 300)
    marked = [(" ".join(f"w{i * j % 13}" for j in range(1, 9)), i % 3 == 0) for i in range(60)]
    train = spark.createDataFrame(marked, "text string, toxic boolean")
    table, other = toxicity.weighed(toxicity.summed(toxicity.counted(train, 3, 2), (0.5, 1.0)).cache())
    asked = spark.createDataFrame([((k, t),) for k, (t, _) in enumerate(marked + [("", False), ("w1 " * 400, True)])], "row struct<k:int, text:string>").coalesce(1)
    one, several = toxicity.ToxicModel.of(table, other), toxicity.ToxicModel.of(table, other, 300)
    assert len(one.blocks) == 1 < 4 < len(several.blocks)
    for keys in (0, 2):
        assert np.array_equal(np.sort(np.concatenate([b.value[keys] for b in several.blocks])), one.blocks[0].value[keys])
    rows = several.ratios(asked)
    # a Python worker a task, whatever the number of blocks
    assert rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1
    ratios = lambda d: [tuple(r) for r in d.select("row.k", "ratio").collect()]
    assert ratios(rows) == ratios(one.ratios(asked)) and len({x for _, x in ratios(rows)}) > 5
    block = several.blocks[0]
    assert [len(arrays) for arrays in toxicity.passing(several.blocks)] == [4] * len(several.blocks) and not hasattr(block, "_value")


@pytest.mark.parametrize("sf, least", [("sf0.1", 0.4)])
def test_toxicity_holds_on_rows_it_never_saw(spark, sf, least):
    """About 5 % of the given labels are noise, so that not all that are labelled toxic can be found."""
    sf = f"/root/testdata/{sf}"
    got = {r["doc_id"]: r for r in queries.op8_toxicity(spark, sf).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    known = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    hits = sum(p and t for p, t in known)
    assert hits / sum(p for p, _ in known) > 0.85 and hits / sum(t for _, t in known) > least


def test_mix_meets_its_target(spark):
    rows = [(i, "a b c d e f g h", None, "big", 0) for i in range(800)] + [(1000 + i, "a b c d e f g h", None, f"s{i % 4}", 0) for i in range(400)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d, mixing.Target(repeats=1.5), mix_tokens=1600).collect()
    n = Counter(r["mix_source"] for r in got)
    assert n["big"] == 800 and all(abs(n[f"s{k}"] - 150) <= 1 for k in range(4))
    assert set(Counter(r["doc_id"] for r in got).values()) == {1, 2}
    blocks = Counter((r["mix_block"], r["mix_source"]) for r in got)
    assert all(abs(blocks[b, "big"] - 1600 / 8 * 800 / 1400) <= 1 for b in range(max(b for b, _ in blocks)))
    even = mixing.mix(d, mixing.Target(entropy=1.0, repeats=None), budget=8000.0)
    assert max(Counter(r["mix_source"] for r in even.collect()).values()) <= 201


def test_mix_equals_brute_force(spark, docs):
    """Exponent, weights and budget by plain bisection; each source is read by its share of the budget, to within an item."""
    words = Counter()
    items = {}
    for r in docs.collect():
        n = len((r["text"] or "").encode().split())
        words[r["source"] or ""] += n
        items.setdefault(r["source"] or "", []).append(n)
    for repeats in (2.0, 1.2):
        share = {s: n / words.total() for s, n in words.items()}
        lo, hi = 0.0, 1.0
        for _ in range(60):
            a = (lo + hi) / 2
            lo, hi = (a, hi) if (max(share.values()) / min(share.values())) ** (1 - a) > repeats else (lo, a)
        raw = {s: n**hi for s, n in words.items()}
        budget = max(words[s] / raw[s] for s in raw) * sum(raw.values())
        want = {s: budget * raw[s] / sum(raw.values()) for s in raw}
        got, times = Counter(), Counter()
        for r in mixing.mix(docs, mixing.Target(repeats=repeats), mix_tokens=5000).collect():
            got[r["mix_source"]] += r["tokens"]
            times[r["doc_id"], r["text_hash"], r["mix_source"]] += 1
        assert all(abs(got[s] - want[s]) <= max(items[s]) + 1e-6 * want[s] for s in want) and set(got) == set(want)
        assert set(times.values()) <= {1, 2} and len(times) == docs.count()


def test_scratch_can_be_cleared(spark, monkeypatch):
    from helixframe.llm import storage

    monkeypatch.setattr(storage, "_scratch", {})
    spark_rows = storage.written(spark.range(3), "three")
    assert spark_rows.count() == 3
    path = storage._scratch[spark.sparkContext.applicationId][0].removeprefix("file://")
    storage.clear_scratch(spark)
    assert not os.path.exists(path)


def test_host_rules_and_mined_rules(spark):
    urls = ["http://a.Example.NET/en/x", "http://x.net/de", "http://x.net", "https://example.com/de/1?q=1", "http://notexample.com/de/1", "ftp://o.org/fr/#x", "no scheme", None, "http://net/en/", "http://example.net?x=/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, min_support=0.5).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block") and got[2][1:3] == ("", None) and got[3][2] == "example.com/de/" and got[4][2] is None
    assert got[5] == ("o.org", "/fr/", "org/fr/", "allow") and got[6] == got[7] == ("", "", None, "allow") and got[8][2] == "net/" and got[9][2] is None
    many = [(i, f"http://h{i % 7}.net/spam/{i}") for i in range(60)] + [(100 + i, f"http://h{i % 7}.com/ham/{i}") for i in range(60)] + [(999, "http://other.com/spam/1")]
    verdict = {r["page_id"]: r["verdict"] for r in urlrules.judge(spark.createDataFrame(many, "page_id long, url string")).collect()}
    assert verdict[999] == "block" and verdict[105] == "allow"


def test_hot_equal_rows_are_cut_without_one_block(spark, monkeypatch):
    long, short, other = unlike(1, 60), "just a few", unlike(2, 30)
    rows = [(1, long)] * 40 + [(2, f"{other} {long} end")] + [(3, short)] * 900 + [(4, unlike(3, 50)), (None, long), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((r["doc_id"], r["n_words"], r["kept_text"], substring_spans(r)) for r in substring.remove_repeats(d).collect())
    monkeypatch.setattr(substring, "BLOCK_BYTES", 2000)
    got = Counter((r["doc_id"], r["n_words"], r["kept_text"], substring_spans(r)) for r in substring.remove_repeats(d).collect())
    assert got == want and got[(1, 60, "", ((0, 60),))] == 40 and got[(2, 91, f"{other} end", ((30, 90),))] == 1 and got[(3, 3, short, ())] == 900


def substring_spans(row):
    return tuple(map(tuple, row["removed"]))


def test_hosts_paths_and_rules_are_those_of_sql(spark, con):
    sql = r"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, host, path, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
    FROM p"""
    got = queries.QUERIES["op10_url_filters"](spark, SF)
    assert Counter(tuple(r) for r in got.select("page_id", "host", "path", "rule").collect()) == Counter(con.execute(sql).fetchall())
    by_rule = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert all(r["verdict"] == by_rule[r["rule"]] for r in got.where("rule is not null").collect())


def test_mined_rules_equal_brute_force(spark):
    """Every token set of support and confidence beyond the bounds is a rule, and pages are blocked by these alone."""
    from itertools import combinations

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    url = F.col("url")
    rows = pages.select("page_id", "url", urlrules.tokens(url).alias("tokens"), urlrules.host_rule(urlrules.RULES, urlrules.host(url), urlrules.path(url), "verdict").alias("verdict")).collect()
    for support, confidence in ((0.01, 0.7), (0.05, 0.4)):
        n, bad = Counter(), Counter()
        once = Counter(t for r in rows for t in r["tokens"])
        for r in rows:
            often = [t for t in r["tokens"] if once[t] >= support * len(rows)]
            for k in range(1, len(often) + 1):
                for some in combinations(often, k):
                    n[some] += 1
                    bad[some] += r["verdict"] == "block"
        rules = {some for some, b in bad.items() if b >= support * len(rows) and b / n[some] >= confidence}
        want = {r["page_id"]: r["verdict"] or ("block" if any(set(x) <= set(r["tokens"]) for x in rules) else "allow") for r in rows}
        got = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages, min_support=support, min_confidence=confidence).collect()}
        assert got == want


def test_kept_text_is_what_the_digest_says(spark):
    shared = " ".join(f"s{i}" for i in range(36))
    d = spark.createDataFrame([(1, f"a {shared} b"), (2, f"c  {shared}"), (3, "x " * 40)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.remove_repeats(d).collect()}
    assert got[1]["kept_text"] == "a b" and [tuple(s) for s in got[1]["removed"]] == [(1, 37)] and got[2]["kept_text"] == "c"
    assert got[3]["kept_text"] == "" and got[3]["n_words"] == 40
    assert hashlib.sha256(b"a b").hexdigest()


def thue_morse(n, swapped=False):
    return "".join("ba"[(i.bit_count() & 1) ^ swapped ^ 1] for i in range(n))


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_that_fool_a_polynomial_stay_apart(spark, size):
    one, other = thue_morse(size), thue_morse(size, True)
    data = np.frombuffer(f"{one} {other} {one}".encode(), dtype=np.uint8)
    words = kernels.find_words(data, np.array([0, len(data)]))
    for seed in (0, 1):
        a, b, again = kernels.hash_words(words, seed=seed)
        assert a == again != b
    shared = " ".join(f"w{i}" for i in range(34))
    d = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {other}"), (3, f"{shared} {one}")], "doc_id long, text string")
    removed = {r["doc_id"]: r["removed"] for r in substring.remove_repeats(d).collect()}
    assert [len(removed[i]) for i in (1, 2, 3)] == [1, 0, 1]


def test_url_rules_with_many_shared_tokens(spark):
    shared = "&".join(f"name{i}=1" for i in range(40))
    pages = [(i, f"http://site{i % 3}.net/a?{shared}" if i < 20 else f"http://site{i % 3}.com/a?{shared}" if i < 24 else f"http://other.com/b/{i}") for i in range(60)]
    began = time.time()
    got = {r["page_id"]: r["verdict"] for r in urlrules.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert time.time() - began < 60
    # 20 of 24 pages with the shared names are blocked, so the names alone are a rule
    assert [got[i] for i in range(24)] == ["block"] * 24 and {got[i] for i in range(24, 60)} == {"allow"}


def test_two_batches_give_what_one_does(spark, odd):
    rows = lambda d: sorted(map(repr, d.collect()))
    one, two, none = (exactdedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}") for _ in range(3))
    assert rows(one.ingest(odd)) == rows(two.ingest_in_two(odd))
    assert spark.table(two.name).count() == spark.table(one.name).count() > 1
    assert none.ingest_in_two(odd.limit(0)).count() == 0


def test_encoder_looks_a_word_up_once_a_batch_and_keeps_it_without_its_signs(monkeypatch):
    e = tokenbin.Encoder(queries.tokenizer_path())
    asked, known = [], e._known
    monkeypatch.setattr(e, "_known", lambda found: asked.extend(found) or known(found))
    texts = ["Éa the, the. the", None, "", "the,, éa! x9, 中文, a<|endoftext|>b", "<|endoftext|>", "the, the!"]
    assert e.encode(texts) == [e._direct(t or "") for t in texts]
    assert len(asked) == len(set(asked)) and set(e.words) == {w.encode() for w in ("Éa", "the", ",", ".", "!")}
