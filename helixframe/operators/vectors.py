"""A vector index on disk: clusters with a centre and a radius, searched exactly.

Vectors are scaled to length one, so that cosine and distance order alike, and
lie in folders by their nearest centre.  A search looks into the clusters nearest
to a query until they hold k vectors; by the triangle inequality a cluster whose
centre is farther than its radius and the k-th best distance together holds
nothing better, and isn't read.  Centres are a bounded sample of the first
vectors: they decide how much is read, never what is found.

Inserts, removals and searches are tables.  What a verb has written counts from
its entry in the index's log on, as in ``store``.  Of an id that is inserted
again, the newest vector counts.  Vectors of length zero have cosine 0 with all
and are kept apart; null vectors and ids are left out.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from . import store

#: Clusters at most (their centres are broadcast), and vectors that one task scans at once.
MOST, CHUNK = 4096, 8192
ZERO = -1
VECTORS = "vec_id long, unit array<double>, distance double, write string, cluster int"
REMOVED = "vec_id long, write string"


def matrix(column) -> np.ndarray:
    """Rows of arrays as a matrix of rows of length one; zero rows stay."""
    v = np.array([np.asarray(x, dtype=np.float64) for x in column])
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def create(path: str, vectors: DataFrame, clusters: int | None = None) -> None:
    """An index of ``vectors`` (vec_id, embedding); by default with about as many clusters as vectors in each."""
    spark = vectors.sparkSession
    ours = vectors.where("vec_id is not null and embedding is not null and exists(embedding, x -> x <> 0)")
    n = min(MOST, clusters or max(1, int(ours.count() ** 0.5)))
    # a bounded sample, the same after any retry
    centres = ours.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)
    centres.select(F.row_number().over(Window.orderBy("vec_id")).alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("centre")).coalesce(1).write.parquet(f"{path}/centres")
    insert(spark, path, vectors)


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """At most MOST clusters and their centres."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cluster").collect()
    return np.array([r["cluster"] for r in rows], dtype=np.int32), matrix([r["centre"] for r in rows])


def insert(spark: SparkSession, path: str, vectors: DataFrame, request: str | None = None) -> None:
    """Adds ``vectors`` (vec_id, embedding), instead of those that have their ids."""
    if store.answered(spark, path, request):
        return
    names, centres = _centres(spark, path)

    @F.pandas_udf("unit array<double>, cluster int, distance double")
    def placed(embedding: pd.Series) -> pd.DataFrame:
        unit = matrix(embedding)
        apart = np.maximum(0, 2 - 2 * unit @ centres.T)
        near = apart.argmin(axis=1)
        zero = ~unit.any(axis=1)
        distance = np.sqrt(((unit - centres[near]) ** 2).sum(axis=1))
        return pd.DataFrame({"unit": list(unit), "cluster": np.where(zero, ZERO, names[near]).astype(np.int32), "distance": np.where(zero, 0, distance)})

    name = f"w{uuid.uuid4().hex}"
    own = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), placed("embedding").alias("p"))
    own.select("vec_id", "p.*").hint("rebalance", "cluster").write.partitionBy("cluster").parquet(f"{path}/vectors/write={name}")
    store.commit(spark, path, "write", name, request)


def remove(spark: SparkSession, path: str, ids: DataFrame, request: str | None = None) -> None:
    """Takes out the vectors of ``ids`` (vec_id)."""
    if store.answered(spark, path, request):
        return
    name = f"w{uuid.uuid4().hex}"
    ids.select(F.col("vec_id").cast("long").alias("vec_id")).write.parquet(f"{path}/removed/write={name}")
    store.commit(spark, path, "delete", name, request)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that are in the index: vec_id, unit, distance (to its centre), cluster."""
    # as many rows as there were writes
    log = store.log(spark, path).select("write", "kind", F.col("number").alias("seq"))
    of = lambda kind: F.broadcast(log.where(F.col("kind") == kind).drop("kind"))
    rows = spark.read.schema(VECTORS).parquet(f"{path}/vectors").join(of("write"), "write")
    if log.count() > 1:
        last = rows.select("vec_id", "seq")
        if log.where("kind = 'delete'").head(1):
            last = last.unionByName(spark.read.schema(REMOVED).parquet(f"{path}/removed").join(of("delete"), "write").select("vec_id", "seq"))
        rows = rows.join(last.groupBy("vec_id").agg(F.max("seq").alias("seq")), ["vec_id", "seq"])
    return rows.drop("write", "seq")


def get(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """vec_id and unit of the ids that are in the index."""
    return load(spark, path).join(ids.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "unit")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, clusters): for each of ``queries`` (vec_id, embedding) the k vectors of greatest cosine (to six places; ties go to the smaller id), and how many clusters were read for it."""
    held = load(spark, path)
    # at most MOST + 1 rows
    stats = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()
    names, centres = _centres(spark, path)
    n, radius = (np.zeros(len(names)) for _ in range(2))
    at = {int(c): i for i, c in enumerate(names)}
    for r in stats:
        if r["cluster"] != ZERO:
            n[at[r["cluster"]]], radius[at[r["cluster"]]] = r["n"], r["radius"]
    full = n > 0
    names, centres, n, radius = names[full], centres[full], n[full], radius[full]
    has_zero = any(r["cluster"] == ZERO for r in stats)

    @F.pandas_udf("unit array<double>, clusters array<int>, bounds array<double>, first int")
    def visits(embedding: pd.Series) -> pd.DataFrame:
        """Clusters by the least distance that a vector of theirs may have, and how many of them hold k vectors."""
        unit = matrix(embedding)
        apart = np.sqrt(np.maximum(0, 2 - 2 * unit @ centres.T)) if len(names) else np.zeros((len(unit), 0))
        bound = np.where(unit.any(axis=1)[:, None], np.maximum(0, apart - radius - 1e-9), 0)
        order = np.argsort(bound, axis=1, kind="stable")
        enough = (np.cumsum(n[order], axis=1) < k).sum(axis=1) + 1
        return pd.DataFrame({"unit": list(unit), "clusters": list(names[order]), "bounds": list(np.take_along_axis(bound, order, axis=1)), "first": np.minimum(enough, len(names)).astype(np.int32)})

    asked = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("query_id"), visits("embedding").alias("v")).select("query_id", "v.*")
    asked = written(asked, "asked")
    chunks = F.broadcast(spark.createDataFrame([(r["cluster"], -(-r["n"] // CHUNK)) for r in stats] or [(ZERO, 1)], "cluster int, chunks long"))
    dealt = held.select("vec_id", "unit", "cluster").join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).drop("chunks")

    def best(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        rows = lambda t: t["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids, v, out = theirs["vec_id"].to_numpy(), rows(theirs), []
        for i in range(0, ours.num_rows, 1024):
            part = ours.slice(i, 1024)
            score = np.round(rows(part) @ v.T, 6)
            top = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            out.append(pa.table({"query_id": pa.array(np.repeat(part["query_id"].to_numpy(), top.shape[1])), "vec_id": pa.array(ids[top].ravel()), "score": pa.array(np.take_along_axis(score, top, axis=1).ravel())}))
        return pa.concat_tables(out)

    def scanned(visit: DataFrame) -> DataFrame:
        sent = visit.join(chunks, "cluster").select("query_id", "unit", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
        return sent.groupBy("cluster", "chunk").cogroup(dealt.groupBy("cluster", "chunk")).applyInArrow(best, "query_id long, vec_id long, score double")

    near = asked.select("query_id", "unit", F.explode(F.slice("clusters", F.lit(1), F.col("first"))).alias("cluster"))
    if has_zero:
        near = near.unionByName(asked.select("query_id", "unit", F.lit(ZERO).alias("cluster")))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    first = written(top(scanned(near)), "near")
    worst = first.where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("score") - 1e-6))).alias("reach"))
    rest = asked.join(worst, "query_id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    some = F.filter(F.arrays_zip("clusters", "bounds"), lambda x: x["bounds"] <= F.col("reach"))
    rest = written(rest.select("query_id", "unit", "first", F.transform(F.when(F.size(some) > F.col("first"), F.slice(some, F.col("first") + 1, F.size("clusters"))).otherwise(F.array().cast("array<struct<clusters:int,bounds:double>>")), lambda x: x["clusters"]).alias("more")), "rest")
    second = scanned(rest.select("query_id", "unit", F.explode("more").alias("cluster")))
    read = rest.select("query_id", (F.col("first") + F.size("more")).cast("long").alias("clusters"))
    return top(first.drop("rank").unionByName(second)).drop("rank").join(read, "query_id").select("query_id", "vec_id", "score", "clusters")
