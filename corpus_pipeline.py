"""A training-corpus pipeline over the numbered operators.

Toxic documents go, one document of each group of near duplicates stays,
documents that hold benchmark passages go, the rest is mixed to target weights
(small sources are read up to twice), and token ids are written and digested.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and ids, empty tables and further columns of any name; each states what it makes
of them.  No stage tells rows apart by their id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontam, mixing, simhash, tokenbin, toxicity
from helixframe.llm.queries import tokenizer_path
from helixframe.llm.storage import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model doesn't call toxic; null and empty texts score by the calibration's shift alone, and stay. Equal texts fare alike, so copies stay or go together."""
    return toxicity.keep_ordinary(spark, docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest id, of equal ids the one with the least hash of its text; a null id loses to any other. All rows without words (null, empty) are one component."""
    return simhash.without_near_duplicates(docs, reach=3, width=3, seed=42)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds at least 0.6 of no benchmark item; judged by the text, so rows of one id can differ. Null and empty texts stay."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"), coverage=0.6)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix reads it, once at least and twice at most; a null source counts as the source ''. Rows without words are read once."""
    return mixing.mixed_documents(docs, mixing.Target(repeats=2.0))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for each row, in ascending id order of the files; a null or empty text is the end id alone, a null id sorts first."""
    return tokenbin.round_trip(docs, tokenizer_path(), end_id=2)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("tokens", write_tokens)]

#: The model, the components and the tokenizer aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each one's rows written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
