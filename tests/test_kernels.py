"""Codecs, parity, fountain codes, noise and consensus without Spark, and the DataFrame functions around them."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import blocks, codecs, consensus, constraints, fountain, noise, pool, primers, reedsolomon, search
from helixframe.operators import parity as stripes


FILE = "file_id long, payload binary"


@pytest.mark.parametrize("name,strands,nt", [("ternary", 4, 648), ("ternary-overlap", 7, 1134), ("yinyang", 3, 396)])
def test_published_sizes(spark, name, strands, nt):
    made = codecs.encode(spark.createDataFrame([(1, bytearray(b"x" * 89))], FILE), name).collect()
    assert (len(made), sum(len(r["seq"]) for r in made)) == (strands, nt)


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
def test_codecs_round_trip_in_any_order(spark, name):
    rnd = random.Random(5)
    payloads = dict(enumerate([b"\0", b"\xff" * 21, *(rnd.randbytes(n) for n in (*range(1, 40), 46, 71, 95, 96, 97, 400, 3000))]))
    files = spark.createDataFrame([*((i, bytearray(p)) for i, p in payloads.items()), (-1, None), (-2, bytearray())], FILE)
    made = codecs.encode(files, name)
    sizes = pool.strand_count(F.octet_length("payload").cast("long"), name)
    assert {r[0]: r[1] for r in files.select("file_id", F.coalesce(sizes, F.lit(0))).collect() if r[1]} == {r[0]: r[1] for r in made.groupBy("file_id").count().collect()}
    back = {r["file_id"]: (r["payload"] and bytes(r["payload"]), r["status"]) for r in codecs.decode(made.orderBy(F.rand(3)), name).collect()}
    assert back == {i: (p, "ok") for i, p in payloads.items()}


def scalar_ternary(payload):
    """The ternary strands of a payload, base by base."""
    framed, n = len(payload).to_bytes(4, "big") + payload, 6 * (len(payload) + 4)
    digits = [b // 3**k % 3 for b in framed + codecs.TAIL for k in range(5, -1, -1)]
    white = codecs.whitening(np.arange(n + 150)).tolist()
    out = []
    for k in range(-(-n // 150)):
        strand = ""
        for part in ([k // 3**j % 3 for j in range(11, -1, -1)], [(digits[i] + white[i]) % 3 for i in range(150 * k, 150 * k + 150)]):
            last = "A"
            for t in part:
                last = "ATGC".replace(last, "")[t]
                strand += last
        out.append(strand)
    return out


def test_ternary_strands_one_base_at_a_time(spark):
    payloads = {n: random.Random(n).randbytes(n) for n in (1, 20, 21, 22, 46, 500)}
    made = codecs.encode(spark.createDataFrame([(i, bytearray(p)) for i, p in payloads.items()], FILE)).orderBy("file_id", "strand_index").collect()
    assert {i: [r["seq"] for r in made if r["file_id"] == i] for i in payloads} == {i: scalar_ternary(p) for i, p in payloads.items()}


@pytest.mark.parametrize("name", ["ternary", "yinyang"])
def test_codecs_say_what_is_wrong(spark, name):
    made = [r["seq"] for r in codecs.encode(spark.createDataFrame([(1, bytearray(range(256)))], FILE), name).orderBy("strand_index").collect()]
    if name == "ternary":
        assert all(a != b for s in made for a, b in zip(s[codecs.INDEX :], s[codecs.INDEX + 1 :]))
    wrong = {"missing": made[:2] + made[3:], "length": [made[0][:5], *made[1:]], "null": [None, *made[1:]], "base": ["N" + made[0][1:], *made[1:]], "twice": [*made, made[1]]}
    rows = spark.createDataFrame([(k, s) for k, v in wrong.items() for s in v], "file_id string, seq string")
    got = {r["file_id"]: (r["status"], r["payload"]) for r in codecs.decode(rows, name).collect()}
    assert got == {k: ({"null": "length", "twice": "missing"}.get(k, k), None) for k in wrong}
    assert codecs.decode(rows.limit(0), name).collect() == []


def test_parity_mends_up_to_its_capacity():
    rnd = random.Random(1)
    for _ in range(25):
        k, p, width = rnd.randint(1, 12), 4, 30
        data = ["".join(rnd.choice("ATGC") for _ in range(width)) for _ in range(k)]
        every = data + reedsolomon.encode_stripe(data, p)
        lost = rnd.sample(range(k + p), rnd.randint(0, p))
        for i in lost:
            every[i] = None
        wrong = [i for i in range(k) if every[i]][: (p - len(lost)) // 2]
        for i in wrong:
            every[i] = every[i].translate(str.maketrans("ATGC", "TACG"))
        assert reedsolomon.decode_stripe(every[:k], every[k:], [width] * k)[0] == data
    assert reedsolomon.decode_stripe([None, None], ["AAAA", None], [1, 1])[0] is None


def test_field_inverse_and_lagrange():
    x = np.arange(1, 256, dtype=np.uint8)
    assert (reedsolomon.MUL[x, reedsolomon.INV[x]] == 1).all()
    assert (reedsolomon.lagrange((0, 1, 5), (1, 5, 0)) == np.eye(3, dtype=np.uint8)[[1, 2, 0]]).all()


@pytest.mark.parametrize("name,parity", [("ternary", 4), ("ternary-high", 0), ("yinyang", 3)])
def test_statistics_by_closed_form_are_those_of_the_strands(spark, name, parity):
    rnd = random.Random(4)
    sizes = (0, 1, 20, 21, 30, 31, 32, 33, 71, 300, 9000)
    files = spark.createDataFrame([*((i, f"f{i}", bytearray(rnd.randbytes(n)), i) for i, n in enumerate(sizes)), (99, "none", None, 99)], "file_id long, filename string, payload binary, created_at long")
    rows = lambda d: sorted(map(tuple, d.select("file_id", "is_total", "strands", "data_strands", "parity_strands", "nucleotides", "redundancy", "avg_length").collect()), key=repr)
    assert rows(pool.planned_stat(pool.catalog(files, name, parity))) == rows(pool.stat(pool.strands(files, name, parity)))
    made = codecs.collection_stats(files, name).agg(F.sum("strands"), F.sum("nucleotides")).first()
    laid = pool.layouts(files, (name,)).first()
    assert (laid["strands"], laid["nucleotides"], round(laid["bits_per_nt"], 9)) == (*made, round(8 * sum(sizes) / made[1], 9))


@pytest.mark.parametrize("preset", sorted(fountain.PRESETS))
def test_fountain_peels(spark, preset):
    payloads = {n: random.Random(n).randbytes(n) for n in (1, 12, 16, 500, 764, 3000)}
    files = spark.createDataFrame([*((i, bytearray(p)) for i, p in payloads.items()), (-1, None), (-2, bytearray())], FILE)
    made = fountain.encode(files, preset)
    assert made.dropDuplicates(["file_id", "strand_index"]).count() == made.count()
    # droplets that come twice, lost ones and ones that aren't bases
    noisy = made.unionByName(made.where("strand_index % 3 = 0")).unionByName(made.limit(40).withColumn("seq", F.lit("ATGN"))).unionByName(made.limit(5).withColumn("seq", F.lit(None).cast("string")))
    got = {r["file_id"]: (r["status"], bytes(r["payload"])) for r in fountain.decode(noisy.orderBy(F.rand(1)), preset).collect()}
    assert got == {i: ("ok", p) for i, p in payloads.items()}
    few = fountain.decode(made.where("file_id = 3000 and strand_index % 5 = 0 or file_id = 1").withColumn("seq", F.expr("if(file_id = 1, 'AT', seq)")), preset).collect()
    assert sorted((r["file_id"], r["status"], r["payload"]) for r in few) == [(1, "stuck", None), (3000, "stuck", None)]


@pytest.mark.parametrize("limits", ["default", "relaxed", "strict", "primer"])
def test_base_codes_within_limits_are_valid_strands(spark, limits):
    rnd = np.random.default_rng(3)
    some = [rnd.integers(0, 4, (300, n), dtype=np.uint8) for n in (1, 5, 12, 20, 50, 60)]
    some.append(np.resize(np.array([0, 2, 1, 0, 3, 1, 2, 2], dtype=np.uint8), (1, 64)))
    rows = [("".join(dna.BASES[b] for b in row), bool(ok)) for c in some for row, ok in zip(c, fountain.within(c, constraints.LIMITS[limits]), strict=True)]
    judged = spark.createDataFrame(rows, "seq string, ok boolean").withColumn("valid", constraints.is_valid(F.col("seq"), constraints.LIMITS[limits]))
    assert judged.where("ok <> valid").count() == 0
    assert judged.where("ok").count() > 0 or limits == "strict"


def test_scattering_is_a_bijection():
    some = np.concatenate([np.arange(1000, dtype=np.uint64), np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)])
    assert (fountain.scattered(fountain.scattered(some), back=True) == some).all()


def test_screened_droplets_are_valid_and_peel(spark):
    rnd = random.Random(9)
    payloads = {0: b"\0", 1: bytes(500), 2: b"A" * 60, 3: rnd.randbytes(1500), 4: b"the quick brown fox " * 20}
    files = spark.createDataFrame([*((i, bytearray(p)) for i, p in payloads.items()), (-1, None), (-2, bytearray())], FILE)
    sown = fountain.screened(files).cache()
    made = fountain.screened_strands(sown)
    assert made.where(~constraints.is_valid(F.col("seq"))).count() == 0
    assert made.count() == made.select("file_id", "strand_index").distinct().count()
    told = {r["file_id"]: r for r in fountain.shortfall(sown).collect()}
    assert set(told) == set(payloads) and all(r["short"] == 0 and r["peels"] and r["made"] >= r["wanted"] and 0 < r["passed"] < 0.05 for r in told.values())
    back = {r["file_id"]: (r["status"], bytes(r["payload"])) for r in fountain.decode(made.orderBy(F.rand(1)), "screened").collect()}
    assert back == {i: ("ok", p) for i, p in payloads.items()}
    assert {(r["file_id"], r["strand_index"]) for r in fountain.encode(files, "screened").collect()} == {(r["file_id"], r["strand_index"]) for r in made.collect()}


def test_too_few_tries_are_told(spark, monkeypatch):
    monkeypatch.setitem(fountain.PRESETS, "scarce", fountain.Preset(tries=100))
    files = spark.createDataFrame([(1, bytearray(b"x" * 2000)), (2, bytearray(b"y"))], FILE)
    sown = fountain.screened(files, "scarce").cache()
    made = fountain.screened_strands(sown)
    told = {r["file_id"]: r for r in fountain.shortfall(sown).collect()}
    assert told[1]["short"] > 0 and not told[1]["peels"] and told[1]["made"] == made.where("file_id = 1").count() and told[1]["tried"] == 100 * told[1]["wanted"]
    assert made.where(~constraints.is_valid(F.col("seq"))).count() == 0
    assert all(r["payload"] is None and r["status"] == "stuck" for r in fountain.decode(made.where("file_id = 1"), "scarce").collect())


def test_consensus_of_nanopore_reads(spark):
    rnd, strands, rows = random.Random(3), [], []
    for g in range(6):
        strand = "".join(rnd.choice("ATGC") for _ in range(120))
        codes, n = codecs.CODE[np.frombuffer(strand.encode(), dtype=np.uint8)], 15
        reads = noise.Reads(np.tile(codes, n), np.full(n, 120), np.full(120 * n, 30, dtype=np.int16), np.ones(n, bool), np.zeros(n, bool), np.zeros((n, 3), int))
        out = noise.pass_through(reads, noise.PROFILES["nanopore"], np.array([rnd.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        ends, text = np.cumsum(out.length), codecs.BASES[out.codes].tobytes().decode()
        strands.append(strand)
        rows += [(g, text[b - m : b]) for b, m in zip(ends, out.length)]
    rows += [(6, None), (6, ""), (7, "ATG"), (7, "ATG"), (7, "ATC"), (8, "ATG"), (8, "ATCA"), (8, None), (9, "AATG"), (9, "ATG"), (9, "AAATG")]
    made = consensus.by_group(spark.createDataFrame(rows, "strand long, seq string").repartition(7), "strand")
    got = {r["strand"]: r for r in made.collect()}
    assert sum(got[g]["seq"] == strands[g] for g in range(6)) >= 5
    assert 6 not in got and (got[7]["seq"], got[7]["coverage"], got[7]["contested"]) == ("ATG", 3, False)
    assert got[8]["contested"] and got[8]["seq"] in ("ATG", "ATCA") and got[8]["coverage"] == 2 and got[9]["seq"] == "AATG"
    assert all(0 <= r["min_confidence"] <= r["avg_confidence"] + 1e-9 <= 1 + 1e-6 for r in got.values())


def plain_score(read, bone):
    held = [consensus.GAP * j for j in range(len(read) + 1)]
    for i, b in enumerate(bone):
        row = [held[0] + consensus.GAP]
        for j, r in enumerate(read):
            row.append(max(held[j] + (consensus.MATCH if r == b else consensus.MISMATCH), held[j + 1] + consensus.GAP, row[j] + consensus.GAP))
        held = row
    return held[-1]


def test_votes_are_those_of_the_best_alignment():
    rnd, pairs = random.Random(1), []
    for _ in range(150):
        bone = "".join(rnd.choice("ATGC") for _ in range(rnd.randint(1, 60)))
        read = list(bone)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randrange(len(read))
            read[at : at + rnd.choice((0, 1, 1))] = [rnd.choice("ATGC")] * rnd.choice((0, 1)) if len(read) > 1 else ["A"]
        pairs.append(("".join(read), bone))
    found = consensus.aligned([p[0] for p in pairs], [p[1] for p in pairs])
    for (read, bone), votes in zip(pairs, found):
        subs, gone, more = (sum(x) for x in zip(*((v % 32 < 4, v % 32 == 4, v % 32 >= 8) for v in votes))) if len(votes) else (0, 0, 0)
        assert (len(bone) - subs - gone) * consensus.MATCH + subs * consensus.MISMATCH + (gone + more) * consensus.GAP == plain_score(read, bone)
    assert list(consensus.changed.func(pd.Series([p[1] for p in pairs]), pd.Series(found))) == [p[0] for p in pairs]
    # every read places the gap in a run of one base first
    assert [list(v) for v in consensus.aligned(["CGAAT", "CGAAAAT"], ["CGAAAT"] * 2)] == [[2 * consensus.VOTES + consensus.GONE], [2 * consensus.VOTES + consensus.MORE]]


SIZED = "file_id long, stripe int, source_index int, is_parity boolean, seq string, data_strands int, parity int"


@pytest.mark.parametrize("codec,p", [("ternary", 4), ("yinyang", 7), ("ternary-high", 1)])
def test_parity_by_joins(spark, codec, p):
    """The same parity as stripe by stripe, any losses up to it mended, and more told."""
    rnd = random.Random(p)
    files = spark.createDataFrame([(i, bytearray(rnd.randbytes(n))) for i, n in enumerate((1, 60, 700, 9000))], FILE)
    strands = codecs.encode(files, codec)
    made = [tuple(r) for r in stripes.add_parity(strands, p).collect()]
    by_stripe = {}
    for r in made:
        by_stripe.setdefault(r[:2], []).append(r)
    left, lost = [], 0
    for rows in by_stripe.values():
        rows.sort(key=lambda r: r[2])
        data = [r[4] for r in rows if not r[3]]
        assert [r[4] for r in rows if r[3]] == reedsolomon.encode_stripe(data, p)
        gone = set(rnd.sample(range(len(rows)), rnd.randint(0, p)))
        lost += sum(i < len(data) for i in gone)
        left += [(*r, len(data), p) for i, r in enumerate(rows) if i not in gone]
    back = stripes.mend(spark.createDataFrame(left, SIZED), p)
    assert {r["file_id"]: (r["status"], r["payload"]) for r in codecs.decode(back, codec).collect()} == {r["file_id"]: ("ok", r["payload"]) for r in files.collect()}
    assert back.where("mended").count() == lost
    few = [r for r in left if r[0] == 3 and r[2] >= p + 1]
    assert stripes.mend(spark.createDataFrame(few, SIZED), p).where("mended").count() == 0


def test_spare_strands_contradict_a_wrong_one(spark):
    rnd = random.Random(4)
    files = spark.createDataFrame([(i, bytearray(rnd.randbytes(200))) for i in range(4)], FILE)
    rows = [tuple(r) for r in stripes.add_parity(codecs.encode(files), 3).collect()]
    k = sum(not r[3] for r in rows if r[0] == 0)
    sized = [(*r, k, 3) for r in rows]
    # file 1 has a wrong data strand, file 2 a wrong parity strand, file 3 a wrong one and none to spare
    wrong = [(*r[:4], ("T" if r[4][9] != "T" else "G").join((r[4][:9], r[4][10:])), *r[5:]) if (r[0], r[2]) in ((1, 2), (2, k + 1), (3, 1)) else r for r in sized if r[0] != 3 or r[2] not in (0, 2, 3)]
    got = {r["file_id"]: r["consistent"] for r in stripes.checked(spark.createDataFrame(wrong, SIZED), 3).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}


@pytest.mark.parametrize("wrong,rounds", [((), 0), ((1,), 1), ((1, 3), 2)])
def test_wrong_votes_are_found_in_rounds(spark, wrong, rounds):
    text = bytes(range(120))
    stored = spark.createDataFrame([(i, f"f{i}", bytearray(text), 0) for i in range(3)], "file_id long, filename string, payload binary, created_at long")
    made = [r.asDict() for r in pool.strands(stored, "ternary", 4).collect()]
    for r in made:
        if r["source_index"] in wrong and not r["is_parity"] and r["file_id"] == 1:
            r["seq"] = r["seq"][:40] + ("A" if r["seq"][40] != "A" else "C") + r["seq"][41:]
    # the second of the wrong strands is also the one whose reads agree least
    reads = [(r["file_id"], r["stripe"], r["source_index"], r["is_parity"], r["seq"] if n or r["file_id"] != 1 or r["source_index"] != (wrong or (0,))[-1] else r["seq"][:-1]) for r in made for n in range(3)]
    got = {r["file_id"]: r for r in pool.recover(spark.createDataFrame(reads, "file_id long, stripe int, source_index int, is_parity boolean, seq string"), pool.catalog(stored)).collect()}
    assert all(got[i]["status"] == "ok" and bytes(got[i]["payload"]) == text for i in range(3))
    assert [got[i]["rounds"] for i in range(3)] == [0, rounds, 0]


def test_observed_errors(spark):
    before = spark.createDataFrame([(1, "ATGC"), (2, "ATG"), (3, "A"), (4, "")], "strand long, seq string")
    after = spark.createDataFrame([(1, "ATCCA"), (2, "TTC"), (5, "A"), (4, "A")], "strand long, seq string")
    found = pool.observed_errors(before, after, "strand")
    assert {r["strand"]: (r["compared"], r["mismatches"], r["places"]) for r in found.collect()} == {1: (4, 1, [2]), 2: (3, 2, [0, 2])}
    assert {r["place"]: r["mismatches"] for r in pool.errors_by_place(found).collect()} == {0: 1, 2: 2}


def test_gc_of_packed_bytes(spark):
    rows = spark.createDataFrame([(bytearray(range(256)),), (bytearray(),), *((bytearray([b]),) for b in range(256))], "payload binary")
    assert rows.where(dna.packed_gc(F.col("payload")) != dna.gc_content(dna.pack(F.col("payload")))).count() == 0


def test_unpack_is_the_inverse_of_pack(spark):
    rows = [(bytearray(random.Random(n).randbytes(n)),) for n in (0, 1, 6, 7, 8, 13, 14, 15, 200)] + [(bytearray(b"\xff" * 21),), (None,)]
    back = spark.createDataFrame(rows, "b binary").select("b", dna.unpack(dna.pack(F.col("b"))).alias("back")).collect()
    assert all(r["b"] == r["back"] for r in back)


def test_scalar_functions(spark):
    row = spark.range(1).select(
        dna.pack(F.lit(bytearray(b"\x1b\xff"))).alias("pack"), dna.unpack(F.lit("ATGCCCCCA")).alias("unpack"), dna.gc_content(F.lit("")).alias("gc"), dna.max_run(F.lit("AATTTG")).alias("run"),
        dna.normalised_literal(F.lit("at-g_c g")).alias("literal"), dna.normalised_literal(F.lit("atx")).alias("bad"), dna.palindrome(F.lit("GAATTC")).alias("mirror"),
        constraints.is_valid(F.lit("GAATTC"), constraints.LIMITS["relaxed"]).alias("valid"), F.size(constraints.violations(F.lit("A" * 12), constraints.LIMITS["relaxed"])).alias("n"),
    ).first()
    assert row["pack"] == "ATGCCCCC" and bytes(row["unpack"]) == b"\x1b\xff" and row["gc"] == 0 and row["run"] == 3
    assert row["literal"] == "ATGCG" and row["bad"] is None and row["mirror"] and not row["valid"] and row["n"] == 2


def test_primers_are_far_apart_and_found_after_edits(spark):
    library = primers.library_table(spark, 12)
    pairs = library.orderBy("ordinal").collect()
    assert [r["primer_id"] for r in pairs] == [f"P{i:04d}" for i in range(12)]
    every = [p for r in pairs for p in (r["fwd"], r["rev"])]
    assert all(sum(a != b for a, b in zip(x, y)) >= dna.PRIMER_DISTANCE for i, x in enumerate(every) for j, y in enumerate(every[:i]) if j // 2 != i // 2)
    read = pairs[5]["fwd"]
    edited = read[:3] + read[4:9] + "A" + read[9:15] + ("A" if read[15] != "A" else "C") + read[16:] + "ATGCATGCATGC"
    reads = spark.createDataFrame([(1, edited), (2, "ATATATATATATATATATATATATATAT")], "strand_id long, seq string")
    found = {r["strand_id"]: r["found"] for r in primers.identified(reads, library).collect()}
    assert found == {1: "P0005", 2: None}


@pytest.mark.parametrize("distance", [6, 9])
def test_independent_primers_are_those_tried_in_order(spark, distance):
    pairs = primers.candidates(spark, 700).collect()
    fit = {r["ordinal"] for r in primers.candidates(spark, 700).where(primers.plausible(F.col("fwd")) & primers.plausible(F.col("rev"))).collect()}
    kept, chosen = [], set()
    for r in sorted(pairs, key=lambda r: r["ordinal"]):
        near = any(sum(a != b for a, b in zip(p, q)) < distance for p in (r["fwd"], r["rev"]) for q in kept)
        if r["ordinal"] in fit and not near:
            kept += [r["fwd"], r["rev"]]
            chosen.add(r["ordinal"])
    assert len(chosen) < len(fit) or distance == 6
    assert {r["ordinal"] for r in primers.independent(spark.createDataFrame(pairs), distance).collect()} == chosen
    assert primers.independent(spark.createDataFrame(pairs).limit(0), distance).count() == 0


def test_noisy_pool_gives_payloads_back(spark):
    rows = [(i, f"f{i}.txt", bytearray(random.Random(i).randbytes(40 + 60 * i)), i) for i in range(4)]
    files = spark.createDataFrame(rows, "file_id long, filename string, payload binary, created_at long")
    reads = pool.sequenced(pool.strands(files), "twist", "illumina", 10, seed=7)
    got = {r["file_id"]: r for r in pool.recover(reads, pool.catalog(files)).collect()}
    assert all(got[i]["status"] == "ok" and got[i]["payload"] == p for i, _, p, _ in rows)


def test_search_query_parts():
    q = search.Query.parse("big name:Foo size:>10 size:<x type:TXT size:<99 photo")
    assert q == search.Query("big photo", "foo", "txt", 10, 99)


@pytest.mark.parametrize("sequencing,coverage,parity,files,dropped", [("illumina", 10, 2, 10, 2), ("nanopore", 15, 6, 1, 1)])
def test_recovery_uses_parity_whose_reads_are_contested(spark, sequencing, coverage, parity, files, dropped):
    text = b"a text of some fifty bytes that three strands hold up"
    stored = spark.createDataFrame([(i, f"f{i}", bytearray(text), 0) for i in range(files)], "file_id long, filename string, payload binary, created_at long")
    reads = pool.sequenced(pool.strands(stored, "ternary", parity), "twist", sequencing, coverage, seed=3)
    left = reads.where(F.col("is_parity") | (F.col("source_index") >= dropped))
    got = pool.recover(left, pool.catalog(stored, parity=parity), "ternary", parity).collect()
    assert [(r["status"], bytes(r["payload"] or b"")) for r in got] == [("ok", text)] * files


@pytest.mark.parametrize("name", list(codecs.CODECS))
def test_strands_in_order_leave_decoding_as_few_runs(spark, name, monkeypatch):
    files = spark.createDataFrame([(i, bytes(range(200)) * 4) for i in range(30)], "file_id long, payload binary").coalesce(1)
    made, seen = codecs.encode(files, name), []
    plain = codecs.runs_of
    monkeypatch.setattr(codecs, "runs_of", lambda *a: seen.append(plain(*a)) or seen[-1])
    back = codecs.decode(made, name)
    assert made.count() > 300 and seen[0].count() == 30
    assert back.where("status = 'ok'").join(files, ["file_id", "payload"]).count() == 30


def test_a_stripe_in_order_is_one_row_of_sums(spark):
    files = spark.createDataFrame([(i, bytes(range(250)) * (1 + 20 * (i % 2))) for i in range(20)], "file_id long, payload binary").coalesce(1)
    made = codecs.encode(files).withColumnRenamed("strand_index", "point").where("point < 200")
    n = made.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("k"))
    rows = made.join(n, "file_id").coalesce(1).sortWithinPartitions("file_id").selectExpr("file_id", "0 AS stripe", "k + 4 AS n", "point", "false AS is_parity", "seq", "sequence(k, k + 3) AS excluded", "sequence(k, k + 3) AS targets")
    assert stripes.partial_sums(rows, 4).count() == 20
    # sums of parts are those of the whole
    whole = stripes.filled(rows, 4).select("file_id", "symbols")
    apart = stripes.filled(rows.repartition(7, "point"), 4).select("file_id", "symbols")
    assert whole.exceptAll(apart).count() == 0 and whole.count() == 20


def test_primers_tried_in_ranges_are_those_tried_in_order(spark, monkeypatch):
    pairs = primers.candidates(spark, 600, 5).cache()
    want = primers.tried_in_order(pairs.where(primers.plausible(F.col("fwd")) & primers.plausible(F.col("rev"))), 9).select("ordinal")
    monkeypatch.setattr(primers, "FIRST_RANGE", 20)
    got = primers.independent(pairs, 9).select("ordinal")
    assert got.count() == want.count() > 20 and got.exceptAll(want).count() == 0


def test_reads_near_their_backbone_vote_without_an_alignment(monkeypatch):
    rnd, pairs = random.Random(5), []
    for _ in range(600):
        bone = "".join(rnd.choice(rnd.choice(("ATGC", "AT", "A"))) for _ in range(rnd.choice((4, 9, 40))))
        read = list(bone)
        for at in rnd.sample(range(len(read)), rnd.randint(0, 4)):
            read[at] = rnd.choice("ATGC")
        at = rnd.randrange(len(read))
        read[at : at + rnd.choice((0, 1))] = [rnd.choice("ATGC")] * rnd.choice((0, 1))
        pairs.append(("".join(read), bone))
    want = consensus.aligned([p[0] for p in pairs], [p[1] for p in pairs])
    for (read, bone), votes in zip(pairs, want):
        near = consensus.near([read], [bone])[0]
        assert near is None or sorted(near) == sorted(votes)
    got = consensus.votes.func(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    assert [sorted(v) for v in got] == [sorted(v) for v in want]
    monkeypatch.setattr(consensus, "aligned", None)
    assert [list(v) for v in consensus.votes.func(pd.Series(["CGAAT", "CGAAAAT", "CGAAAC"]), pd.Series(["CGAAAT"] * 3))] == [[2 * consensus.VOTES + consensus.GONE], [2 * consensus.VOTES + consensus.MORE], [5 * consensus.VOTES + 3]]


def test_channel_draws_each_base_by_its_place_and_keeps_no_qualities_unasked(spark):
    profile, n, size = noise.PROFILES["nanopore"], 40, 90
    codes = np.random.default_rng(2).integers(0, 4, n * size).astype(np.uint8)
    keys = np.random.default_rng(3).integers(0, 1 << 63, n).astype(np.uint64)
    out = noise.pass_through(noise.Reads(codes, np.full(n, size), None, np.ones(n, bool), np.zeros(n, bool), np.zeros((n, 3), int)), profile, keys)
    want = []
    for i, key in enumerate(keys):
        live = not noise.draw(key[None], 1)[0] < profile.dropout
        drawn = {p: noise.draw(np.full(size, key), p, np.arange(size)) for p in range(4, 9)}
        for j, c in enumerate(codes[i * size : (i + 1) * size]):
            gone, other, more = (live and drawn[p][j] < r for p, r in ((4, profile.deletion), (5, profile.substitution), (6, profile.insertion)))
            if not gone:
                want += [(c + 1 + int(drawn[7][j] * 3)) % 4 if other else c] + ([int(drawn[8][j] * 4)] if more else [])
    assert out.quality is None and list(out.codes) == want
    # many reads of few bytes come in at least as many partitions as there are cores, however small the strands are
    strands = spark.createDataFrame([(i, 0, 0, False, "ATGC" * 30) for i in range(40)], "file_id long, stripe int, source_index int, is_parity boolean, seq string").coalesce(1)
    reads = pool.sequenced(strands, "twist", "illumina", 10, seed=7)
    assert "quality" not in reads.columns and reads.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    named = strands.withColumn("strand_id", F.col("file_id"))
    each, mean = (noise.read_stats(noise.simulate(named, "twist", "nanopore", 3, quality=q)).first() for q in ("each", "mean"))
    assert each["reads"] == mean["reads"] == 120 and each["subs"] == mean["subs"] > 0 and abs(each["avg_quality"] - mean["avg_quality"]) < 1e-9


def test_droplets_of_a_generation_leave_a_batch_together(spark):
    files = spark.createDataFrame([(1, bytes(range(256)) * 9), (2, b"ab"), (3, b"gone")], "file_id long, payload binary")
    for preset in ("default", "screened"):
        made = fountain.encode(files, preset)
        size = fountain.HEADER + 4 * fountain.PRESETS[preset].segment
        assert {len(r["seq"]) for r in made.select("seq").collect()} == {size}
        # doubled, lost, short and unreadable strands, in any order
        spoiled = made.unionByName(made.where("strand_index % 3 = 0")).withColumn("seq", F.when(F.col("file_id") == 3, F.when(F.col("strand_index") % 2 == 0, "NNé" + "A" * (size - 3)).otherwise(F.substring("seq", 1, 9))).otherwise(F.col("seq")))
        for rows in (spoiled, spoiled.repartition(5, "seq")):
            got = {r["file_id"]: (r["status"], r["payload"] and bytes(r["payload"])) for r in fountain.decode(rows, preset).collect()}
            assert got == {1: ("ok", bytes(range(256)) * 9), 2: ("ok", b"ab"), 3: ("stuck", None)}
    how = fountain.PRESETS["default"]
    at, begin = fountain.drops_of(64, how)
    assert len(begin) == fountain.needed(64, how) and at[begin[1] : begin[2]].tolist() == fountain.subset(fountain.FIRST + 1, 64, how).tolist()
    assert fountain.peel([], 3, how) is None and fountain.peel([(fountain.FIRST, b"")], 64, how) is None


@pytest.mark.parametrize("codec", ["ternary", "ternary-overlap", "yinyang"])
def test_parity_is_made_where_strands_are(spark, codec):
    files = spark.createDataFrame([(i, bytes((i * k * k + k) % 251 for k in range(n))) for i, n in enumerate((1, 2, 34, 700, 12_000, 130_000))], "file_id long, payload binary")
    made = stripes.encoded(files, codec, 5)
    plan = made._jdf.queryExecution().toString()
    assert "Exchange" not in plan and plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, stripes.add_parity(codecs.encode(files, codec), 5).collect()))
    assert "Exchange" not in pool.strands(files, codec, 5)._jdf.queryExecution().toString()


def test_tally_counts_what_expressions_do(spark):
    import random

    rnd = random.Random(3)
    seqs = ["", "A", "ATGC", "GCGCGCGC", "ACGTACGTAC", "AAAAATTTTT", None, "NNNNNNNNNN", "acgtacgtacgt", "A" * 600]
    seqs += ["".join(rnd.choice("ATGC" if k % 3 else "ATGCGC") for _ in range(rnd.randint(5, 120))) for k in range(400)]
    seqs += ["AGTCTGACCA" * 6, "ATCG" * 15]
    strands = spark.createDataFrame([(s,) for s in seqs], "seq string").coalesce(2)
    seq = F.col("seq")
    for name, limits in constraints.LIMITS.items():
        each = [r[0] for r in strands.where("seq is not null").select(constraints.is_valid(seq, limits)).collect()]
        assert (~constraints.measures(pa.array([s for s in seqs if s is not None]), limits)[3]).tolist() == each, name
        want = strands.agg(F.count(F.lit(1)), F.sum(F.length(seq)), F.round(F.avg(dna.gc_content(seq)), 9), F.max(dna.max_run(seq)), F.count_if(~constraints.is_valid(seq, limits))).first()
        got = constraints.tally(strands, limits).select("strands", "nucleotides", F.round("avg_gc", 9), "max_run", "violating").first()
        assert tuple(got) == tuple(want)
    assert tuple(constraints.tally(strands.limit(0)).first()) == (0, 0, None, None, 0)


def test_nearest_to_each_is_brute_force_within_little_memory():
    import tracemalloc

    rng = np.random.default_rng(4)
    for n, dim, k in ((1500, 2, 7), (3, 4, 10), (530, 3, 600), (600, 1, 1), (9, 2, 0)):  # small whole numbers: many ties
        v = rng.integers(-2, 3, (n, dim)).astype(np.float32)
        v[0] = 0
        name = rng.permutation(n)
        table = pa.record_batch({"vec_id": pa.array(name), "embedding": pa.array(list(v), pa.list_(pa.float32()))})
        asked = search.unit(table["embedding"])[:20]
        ids, best = search.best_of(name[:20], asked, [table.slice(0, n // 3), table.slice(n // 3)], k)
        score = np.round(asked @ search.unit(table["embedding"]).T, 6)
        top = np.lexsort((np.broadcast_to(name, score.shape), -score), axis=1)[:, :k]
        assert (ids == name[top]).all() and (best == np.take_along_axis(score, top, axis=1)).all()
    v = pa.record_batch({"vec_id": pa.array(np.arange(12_000)), "embedding": pa.array(list(rng.normal(size=(12_000, 64)).astype(np.float32)))})
    asked = search.unit(v["embedding"].slice(0, 1024))
    tracemalloc.start()
    search.best_of(np.arange(1024), asked, [v], 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6


def test_seeds_of_primers_are_never_gathered_for_a_broadcast(spark):
    drawn = primers.candidates(spark, 300).unionByName(spark.createDataFrame([(300, "N" + "A" * 19, "C" * 20), (301, "NT" + "A" * 18, "G" * 20)], "ordinal long, fwd string, rev string"))
    found = primers.conflicts(drawn, 8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    rows = [(r["ordinal"], p) for r in drawn.collect() for p in (r["fwd"], r["rev"])]
    apart = lambda p, q: sum(x != y for x, y in zip(p, q))
    want = {(i, j) for i, p in rows for j, q in rows if i < j and apart(p, q) < 8}
    assert {tuple(r) for r in found.collect()} == want and (300, 301) in want and len(want) > 20


@pytest.mark.parametrize("dealt", ["in order", "scattered", "twice"])
def test_stripes_are_mended_where_their_strands_are(spark, dealt):
    files = spark.createDataFrame([(i, bytes((i * k + k * k) % 251 for k in range(n))) for i, n in enumerate((5, 60, 700, 13_000, 40_000))], "file_id long, payload binary").coalesce(1)
    made = pool.strands(files, "ternary", 4, sized=True).withColumn("parity", F.lit(4))
    # at most four of a stripe, the last stripe whole, and a file whose stripes can't be mended
    left = made.where("file_id = 4 and stripe = 1 or source_index % 64 <> 1 and not (is_parity and stripe = 0 and file_id = 2) and not (file_id = 1 and source_index > 2)")
    left = {"in order": left, "scattered": left.repartition(5, "source_index"), "twice": left.unionByName(left)}[dealt]
    parts = stripes.stripe_parts(left, 4)
    exchanges = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(parts) == exchanges(left)
    assert (parts.count() == left.select("file_id", "stripe").distinct().count()) == (dealt == "in order")
    data, rest = stripes.mended(left, 4)
    assert exchanges(data) == exchanges(left)
    want = made.where("not is_parity and file_id not in (1, 2)").join(left, ["file_id", "stripe", "source_index"], "left_anti").select("file_id", "stripe", "source_index", "seq")
    assert rest.where("file_id not in (1, 2)").select(want.columns).exceptAll(want).count() == 0 and rest.where("file_id not in (1, 2)").count() == want.count() > 5
    assert rest.where("file_id = 1").count() == 0


def test_blocks_are_stored_without_a_shuffle(spark):
    cut = spark.createDataFrame([(i, bytes([i % 251]) * 512) for i in range(50)], "lba long, block binary")
    held = blocks.stored(cut, 2)
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString() and "Join" not in held._jdf.queryExecution().executedPlan().toString()
    assert {r["data_strands"] for r in held.collect()} == {21}


def test_two_rule_runs_leave_a_batch_as_two_bits_a_base(spark, monkeypatch):
    files = spark.createDataFrame([(i, bytes((i * k * k + k) % 251 for k in range(n))) for i, n in enumerate((1, 34, 35, 500, 3000, 9000))], "file_id long, payload binary").coalesce(1)
    made, seen, plain = codecs.encode(files, "yinyang"), [], codecs.runs_of
    monkeypatch.setattr(codecs, "runs_of", lambda *a: seen.append(plain(*a)) or seen[-1])
    codecs.decode(made, "yinyang")
    size = seen[0].selectExpr("sum(octet_length(chunk))").first()[0]
    assert size == sum(n + 4 for n in (1, 34, 35, 500, 3000, 9000))
    # runs of any strands, each from a byte of its own
    for given in (made, made.repartition(7), made.where("strand_index % 3 <> 2").unionByName(made.where("strand_index % 3 = 2").repartition(3))):
        back = codecs.decode(given, "yinyang")
        assert back.where("status = 'ok'").join(files, ["file_id", "payload"]).count() == 6


def test_strands_whose_reads_meet_vote_as_those_that_spark_counts(spark, monkeypatch):
    rnd, rows = random.Random(5), []
    for g in range(40):
        strand = [rnd.choice("ATGC") for _ in range(rnd.choice((30, 90)))]
        for _ in range(rnd.randint(1, 12)):
            read = strand.copy()
            for _ in range(rnd.choice((0, 0, 1, 2, 9))):
                at = rnd.randrange(len(read) - 1)
                read[at : at + rnd.choice((0, 1, 1))] = [rnd.choice("ATGC")] * rnd.choice((0, 1, 1))
            rows.append((g, g % 3 == 0 or None, "".join(read)))
    reads = spark.createDataFrame(rows + [(99, None, ""), (98, None, None)], "strand long, kind boolean, seq string").repartition(5)
    told = lambda: sorted((r["strand"], r["kind"] or False, r["seq"], r["coverage"], round(r["avg_confidence"], 9), round(r["min_confidence"], 9), r["contested"]) for r in consensus.by_group(reads.where("kind"), "strand", "kind").collect())
    here = told()
    assert len(here) == 14 and sum(r[-1] for r in here) > 3
    # one shuffle, by strand
    plan = consensus.met(reads, ["strand"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(strand#") == 1 and "seq#" not in plan.split("Exchange hashpartitioning(")[1].split(")")[0]
    monkeypatch.setattr(consensus, "HOT", 0)
    monkeypatch.setattr(consensus, "met", lambda reads, keys, rounds: reads.where("length(seq) > 0").selectExpr(*keys, "seq", "0 coverage", "0d avg_confidence", "0d min_confidence", "true contested", "1L times"))
    assert told() == here


def test_reads_of_a_hot_strand_do_not_meet(spark):
    one = "ATGCATGGCA" * 3
    reads = spark.range(2 * consensus.HOT + 10).selectExpr("1L strand", f"if(id % 3 = 0, '{one}', concat('{one}', if(id % 2 = 0, 'A', 'C'))) seq").unionByName(spark.createDataFrame([(0, one), (2, one)], "strand long, seq string"))
    rows = consensus.met(reads, ["strand"], 3).groupBy("strand").agg(F.count("times").alias("n"), F.sum("times").alias("reads")).collect()
    assert {r["strand"]: (r["n"] > 0, r["reads"]) for r in rows} == {0: (False, None), 1: (True, 2 * consensus.HOT + 10), 2: (False, None)}
    assert {r["strand"]: r["coverage"] for r in consensus.by_group(reads, "strand").collect()} == {0: 1, 1: 2 * consensus.HOT + 10, 2: 1}


def test_screened_droplets_are_told_without_a_broadcast(spark):
    from helixframe.plans import registry

    told = registry.QUERIES["fountain_screened"](spark, "/root/testdata/sf0.001")
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
