"""The index of primers, and reads of a pool told apart by them."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators import access, codecs, pool, primers, store
from helixframe.operators import parity as stripes
from helixframe.sources.tables import scratch

FILES = "file_id long, filename string, payload binary, created_at long"


@pytest.fixture(scope="module")
def pairs(spark):
    return primers.library_table(spark, 12)


def files(spark, ids):
    return spark.createDataFrame([(i, f"f{i}.txt", bytearray(f"what file {i} holds, ".encode() * (1 + i)), i) for i in ids], FILES)


def given(spark, place):
    return {r["file_id"]: r["ordinal"] for r in access.load(spark, place).collect()}


def test_pairs_are_given_in_order_and_once(spark, pairs):
    place = scratch(spark, "access")
    access.create(place, pairs)
    assert given(spark, place) == {}
    entry = lambda ids: pool.catalog(files(spark, ids))
    access.register(place, entry([7, 3, 5]), ["file_id"], request="a")
    assert given(spark, place) == {3: 0, 5: 1, 7: 2}
    # the same request, and files that are registered
    access.register(place, entry([7, 3, 5]), ["file_id"], request="a")
    access.register(place, entry([1, 3]), ["file_id"])
    assert given(spark, place) == {3: 0, 5: 1, 7: 2, 1: 3}
    access.remove(spark, place, spark.createDataFrame([(5,), (99,), (None,)], "file_id long"))
    assert given(spark, place) == {3: 0, 7: 2, 1: 3}
    # a file that comes back has a pair of its own
    access.register(place, entry([5]), ["file_id"])
    assert given(spark, place) == {3: 0, 7: 2, 1: 3, 5: 4}
    with pytest.raises(store.Refused, match="too few"):
        access.register(place, entry(range(20, 30)), ["file_id"])
    with pytest.raises(store.Refused):
        access.register(place, entry([40]), ["file_id"], expected=1)
    with pytest.raises(ValueError):
        access.register(place, entry([40]).unionByName(entry([40])), ["file_id"])
    access.register(place, entry([]), ["file_id"])
    assert given(spark, place) == {3: 0, 7: 2, 1: 3, 5: 4}


def test_a_registration_that_was_overtaken_takes_other_pairs(spark, pairs, monkeypatch):
    place, commit = scratch(spark, "access"), store.commit
    access.create(place, pairs)

    def late(*args):
        monkeypatch.setattr(store, "commit", commit)
        access.register(place, pool.catalog(files(spark, [1, 2])), ["file_id"])
        return commit(*args)

    monkeypatch.setattr(store, "commit", late)
    access.register(place, pool.catalog(files(spark, [2, 3])), ["file_id"])
    assert given(spark, place) == {1: 0, 2: 1, 3: 2}


def test_reads_of_hits_come_back_without_those_of_others(spark, pairs):
    place, some = scratch(spark, "access"), files(spark, range(8))
    access.create(place, pairs)
    made = pool.catalog(some, "ternary", 2)
    access.register(place, made, ["file_id"])
    registered = access.load(spark, place)
    stored = access.tagged(pool.strands(some, "ternary", 2).where("is_parity or source_index > 0"), registered)
    # a base of each primer read wrongly, and one lost in front
    wrong = F.concat(F.substring("seq", 2, 4), F.translate(F.substring("seq", 6, 1), "ATGC", "TACG"), F.expr("substring(seq, 7, length(seq) - 9)"), F.expr("translate(substring(seq, -3, 1), 'ATGC', 'TACG')"), F.expr("right(seq, 2)"))
    reads = stored.withColumn("strand_id", F.xxhash64("file_id", "stripe", "source_index")).withColumnRenamed("file_id", "true_id").withColumn("seq", F.when(F.col("source_index") % 2 == 0, wrong).otherwise(F.col("seq")))
    hits = access.resolved(spark.createDataFrame([(2,), (5,), (77,)], "file_id long"), registered)
    assert {r["file_id"]: r["ordinal"] for r in hits.collect()} == {2: 2, 5: 5, 77: None}
    found = access.retrieved(reads, hits).cache()
    assert found.where("file_id <> true_id").count() == 0
    assert {r["file_id"]: r["count"] for r in found.groupBy("file_id").count().collect()} == {r["true_id"]: r["count"] for r in reads.where("true_id in (2, 5)").groupBy("true_id").count().collect()}
    counted = found.drop("true_id").join(made.select("file_id", F.col("data_strands").cast("int").alias("data_strands")), "file_id").withColumn("parity", F.lit(2))
    back = {r["file_id"]: (r["status"], bytes(r["payload"])) for r in codecs.decode(stripes.mend(counted, 2), "ternary").collect()}
    assert back == {r["file_id"]: ("ok", bytes(r["payload"])) for r in some.where("file_id in (2, 5)").collect()}
    assert access.retrieved(reads, hits.where("file_id = 77")).count() == 0
