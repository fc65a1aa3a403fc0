"""The vector index and the key table on disk: exact search, what counts after inserts and removals, rotation and revocation."""

import glob
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import keys, store, vectors
from helixframe.sources.tables import scratch

VECTORS = "vec_id long, embedding array<double>"


@pytest.fixture
def path(spark):
    return scratch(spark, f"index-{uuid.uuid4().hex}")


def best(held, asked, k):
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1)
    rows = {q: sorted(((-round(float(unit(v) @ unit(w)), 6), i) for i, w in held.items()), key=lambda x: x)[:k] for q, v in asked.items()}
    return {(q, i): -s + 0.0 for q, r in rows.items() for s, i in r}


def found(df):
    return {(r["query_id"], r["vec_id"]): r["score"] + 0.0 for r in df.collect()}


def test_index_equals_all_pairs_and_skips_clusters(spark, path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 5
    held = {i: (centres[i % 12] + rng.normal(size=8) * 0.3).tolist() for i in range(400)} | {400: [0.0] * 8, 401: held_copy(centres), 402: held_copy(centres)}
    table = lambda d: spark.createDataFrame([(i, v) for i, v in d.items()] + [(None, [1.0] * 8), (900, None)], VECTORS)
    vectors.create(path, table(held), clusters=12)
    asked = {i: held[i] for i in (0, 20, 40, 60, 400, 401)}
    out = vectors.search(spark, path, table(asked).where("embedding is not null and vec_id is not null"), 7)
    assert found(out) == pytest.approx(best(held, asked, 7))
    read = {r["query_id"]: r["clusters"] for r in out.collect()}
    assert read[0] < 12 and max(read.values()) <= 12
    more = vectors.search(spark, path, table({5: held[5]}).limit(1), 1000)
    assert more.count() == len(held)

    vectors.remove(spark, path, spark.createDataFrame([(i,) for i in range(0, 400, 3)], "vec_id long"))
    changed = {3: (-np.asarray(held[3])).tolist(), 500: held[1]}
    vectors.insert(spark, path, spark.createDataFrame(list(changed.items()), VECTORS), request="again")
    vectors.insert(spark, path, spark.createDataFrame(list(changed.items()), VECTORS), request="again")
    held = {i: v for i, v in held.items() if i >= 400 or i % 3} | changed
    assert vectors.load(spark, path).count() == len(held)
    assert found(vectors.search(spark, path, table(asked).where("embedding is not null and vec_id is not null"), 5)) == pytest.approx(best(held, asked, 5))
    assert {r["vec_id"] for r in vectors.get(spark, path, spark.createDataFrame([(0,), (3,), (500,)], "vec_id long")).collect()} == {3, 500}


def held_copy(centres):
    return centres[0].tolist()


FILES = "file_id long, filename string, payload binary, created_at long"


def test_rotation_rewrites_keys_and_no_strand(spark, path):
    texts = {i: random.Random(i).randbytes(60) for i in range(4)}
    files = spark.createDataFrame([(i, f"f{i}", t, 1) for i, t in texts.items()], FILES)
    keys.add(spark, path, files.where("file_id < 2"), "one")
    keys.add(spark, path, files, "one")
    store.write(path, keys.sealed(files, keys.opened(spark, path, "one")))
    strands = lambda: sorted(glob.glob(f"{path.removeprefix('file://')}/strands/**/*.parquet", recursive=True))

    def read(secret):
        held = store.read(spark, path, store.load(spark, path).select("filename", "version"))
        return {r["file_id"]: r["payload"] and bytes(r["payload"]) for r in keys.unsealed(held, keys.opened(spark, path, secret)).collect()}

    before = strands()
    assert read("one") == texts and read("two") == dict.fromkeys(texts)
    assert keys.opened(spark, path, "one").select("key").distinct().count() == 4
    keys.rotate(spark, path, "one", "two")
    assert read("two") == texts and read("one") == dict.fromkeys(texts) and strands() == before
    keys.revoke(spark, path, files.where("file_id = 3").select(F.col("file_id")))
    assert read("two") == {**texts, 3: None} and strands() == before
    assert len(glob.glob(f"{path.removeprefix('file://')}/keys/write=*")) == 1
    with pytest.raises(store.Refused):
        keys._replace(spark, path, spark.createDataFrame([], "file_id long, wrapped binary"), 0)
