"""Keys of a pool's files: a random key each, wrapped under a secret that can change.

A payload is sealed under its file's own key, and the key under the secret
(AES-GCM both).  Changing the secret rewrites the key table and nothing else: no
payload, no strand.  Taking a file's key out of the table makes all its versions
unreadable, wherever their strands are.

A secret comes to tasks as a row of a table, joined by its generation, so that it
stands in no plan.  A key table counts from its entry in the pool's log on, and
of two that change it at once one is refused.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread_by, written
from . import store

KEYS = "file_id long, wrapped binary, write string"


@F.pandas_udf(T.BinaryType())
def fresh(ids: pd.Series) -> pd.Series:
    """Random keys; they differ at every call, so what is made of them is written at once."""
    return ids.map(lambda _: os.urandom(32))


def _held(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(KEYS).parquet(f"{path}/keys").where(F.col("write") == name)


def _newest(spark: SparkSession, path: str) -> str | None:
    row = store.log(spark, path).where("kind = 'keys'").orderBy(F.desc("number")).select("write").first()
    return row and row["write"]


def _with_secret(rows: DataFrame, secret: str) -> DataFrame:
    """``rows`` with the secret's 32 bytes as a column."""
    master = rows.sparkSession.createDataFrame([(1, bytearray(hashlib.sha256(secret.encode()).digest()))], "_generation int, _master binary")
    return rows.withColumn("_generation", F.lit(1)).join(F.broadcast(master), "_generation").drop("_generation")


def _replace(spark: SparkSession, path: str, rows: DataFrame, seen: int) -> None:
    name = f"w{uuid.uuid4().hex}"
    rows.select(F.col("file_id").cast("long").alias("file_id"), "wrapped").write.parquet(f"{path}/keys/write={name}")
    store.commit(spark, path, "keys", name, expected=seen)


def add(spark: SparkSession, path: str, ids: DataFrame, secret: str) -> None:
    """A key for each of ``ids`` (file_id) that has none."""
    seen, name = store.version(spark, path), _newest(spark, path)
    wanted, held = ids.select("file_id").distinct(), None
    if name:
        held = _held(spark, path, name).select("file_id", "wrapped")
        wanted = wanted.join(held, "file_id", "left_anti")
    # a key is few bytes and much work
    made = _with_secret(spread_by(wanted, "file_id").select("file_id", fresh("file_id").alias("key")), secret).select("file_id", F.aes_encrypt("key", "_master").alias("wrapped"))
    _replace(spark, path, made if held is None else held.unionByName(made), seen)


def opened(spark: SparkSession, path: str, secret: str) -> DataFrame:
    """file_id and key of the files whose key the secret opens."""
    name = _newest(spark, path)
    if not name:
        return spark.createDataFrame([], "file_id long, key binary")
    keys = _with_secret(_held(spark, path, name), secret)
    return keys.select("file_id", F.try_aes_decrypt("wrapped", "_master").alias("key")).where("key is not null")


def rotate(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Wraps every key under another secret; keys that ``old`` doesn't open stay as they are."""
    seen, name = store.version(spark, path), _newest(spark, path)
    if not name:
        return
    known = opened(spark, path, old)
    turned = _with_secret(known, new).select("file_id", F.aes_encrypt("key", "_master").alias("wrapped"))
    others = _held(spark, path, name).select("file_id", "wrapped").join(known, "file_id", "left_anti")
    _replace(spark, path, turned.unionByName(others), seen)


def revoke(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Takes the keys of ``ids`` (file_id) away; older key tables go with them."""
    seen, name = store.version(spark, path), _newest(spark, path)
    if not name:
        return
    _replace(spark, path, _held(spark, path, name).join(ids.select("file_id").distinct(), "file_id", "left_anti"), seen)
    for row in store.log(spark, path).where("kind = 'keys'").select("write").collect():
        if row["write"] != _newest(spark, path):
            fs, at = store._place(spark, f"{path}/keys/write={row['write']}")
            fs.delete(at, True)


def sealed(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``files`` with their payloads under their keys; files without a key go.  Written once, as sealing twice gives two texts."""
    return written(files.join(keys, "file_id").withColumn("payload", F.aes_encrypt("payload", "key")).drop("key"), "sealed")


def unsealed(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``files`` with their payloads as they were; null without the right key."""
    return files.join(keys, "file_id", "left").withColumn("payload", F.try_aes_decrypt("payload", "key")).drop("key")
