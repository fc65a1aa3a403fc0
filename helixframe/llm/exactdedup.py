"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest.  A batch of
documents is digested, its new digests are found with a sort-merge anti-join
against the index and appended, and every document of the batch is then looked
up: a digest that the index held before keeps its earlier document, a new one
keeps the document of the batch with the largest id.

Null texts count as empty, and all empty texts are equal.  A null id loses to
any other.  Repeated rows count as copies: of rows equal in id and text, one is
kept.  Ingesting a batch again, as after a failure, keeps what it kept before.
A very long text is one digest like any other; an empty batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import lookup, shuffle_partitions, written


class DigestIndex:
    """A table ``name`` with text_sha256 (binary) and keep_id, bucketed and sorted by text_sha256."""

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        self.spark, self.name = spark, name
        self.buckets = buckets or max(8, shuffle_partitions(spark))

    def _append(self, rows: DataFrame) -> None:
        spread = rows.repartition(self.buckets, "text_sha256")
        spread.write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").format("parquet").mode("append").saveAsTable(self.name)

    def drop(self) -> None:
        """Removes the table; what ``ingest`` has returned stays readable."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Appends the batch's new digests; returns one row per document of the batch.

        Columns: doc_id, keep_id, group_size (rows of the batch with the text),
        kept, text_sha256 (lowercase hex).
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        # written, so that a row's number stays the same
        batch = written(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
        groups = batch.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("rows")).withColumn("largest", F.col("top.doc_id"))
        if not self.spark.catalog.tableExists(self.name):
            self._append(groups.select("text_sha256", F.col("largest").alias("keep_id")).limit(0))
        index = self.spark.table(self.name).hint("merge")
        self._append(groups.select("text_sha256", F.col("largest").alias("keep_id")).join(index, "text_sha256", "left_anti"))
        known = groups.select("text_sha256", "rows", "top").join(self.spark.table(self.name).hint("merge"), "text_sha256")
        is_top = F.col("keep_id").eqNullSafe(F.col("top.doc_id"))
        known = written(known.withColumn("keep_row", F.when(is_top, F.col("top.row"))).drop("top").withColumn("group_size", F.col("rows")), "known")
        # an earlier document that stays may be in the batch again, beside larger ids
        again = lookup(batch, known.where("keep_row is null").select("text_sha256", "keep_id", "rows"), "text_sha256", "rows").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        again = again.groupBy("text_sha256").agg(F.max("row").alias("again"))
        known = written(known.join(again, "text_sha256", "left").withColumn("keep_row", F.coalesce("keep_row", "again")).drop("again"), "kept")
        found = lookup(batch, known, "text_sha256", "rows")
        return found.select("doc_id", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"))

    def ingest_in_two(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The same for all of ``docs`` (ids are integers), in two batches: the upper half of the ids' span first, then the lower and rows without an id.

        Texts that the first batch has are known when the second comes, and its
        rows of them lose, as their ids are smaller: of all rows of a text the one
        with the largest id stays.  group_size counts the rows of both batches.
        """
        low, high = docs.agg(F.min(id_col), F.max(id_col)).first()
        upper = F.coalesce(F.col(id_col) > ((low or 0) + (high or 0)) // 2, F.lit(False))
        done = self.ingest(docs.where(upper), id_col, text_col).unionByName(self.ingest(docs.where(~upper), id_col, text_col))
        done = written(done.drop("group_size"), "batches")
        sizes = written(done.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("rows")).withColumn("group_size", F.col("rows")), "sizes")
        return lookup(done, sizes, "text_sha256", "rows").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
