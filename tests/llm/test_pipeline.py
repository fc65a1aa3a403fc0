"""The pipeline as a whole, and its stages on empty tables."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_take_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns


def test_whole_pipeline(spark):
    """Rows are encoded texts of the documents, one after the other, none more than twice; copies, benchmark passages and toxic rows have gone."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    times = Counter(r["doc_id"] for r in out)
    assert set(times) <= set(docs) and max(times.values()) <= 2 and len(times) > 0.5 * len(docs)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    at = 0
    for r in out:
        ids = np.array([*tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    texts = Counter(docs[i] for i in times)
    assert max(texts.values()) == 1
    left = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(times)))
    from helixframe.llm import decontam

    assert decontam.contaminated(left, spark.read.parquet(f"{SF}/benchmark.parquet"), coverage=0.6).count() == 0
