"""Search of files by metadata filters and by likeness of metadata vectors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits

DIM, NAME_DIM = 32, 16
#: Vectors that a block of queries is compared with at once.
SCANNED = 512
TEXT_TYPES, IMAGE_TYPES = ("txt", "md", "log", "csv"), ("jpg", "png", "gif", "bmp")


@dataclass(frozen=True)
class Query:
    """``name:``, ``type:``, ``size:>N`` and ``size:<N`` (both bounds inclusive); other words are free text."""

    text: str = ""
    name: str | None = None
    kind: str | None = None
    least: int | None = None
    most: int | None = None

    @classmethod
    def parse(cls, raw: str) -> Query:
        """Later filters win; a size that isn't a number is ignored."""
        found: dict = {}
        words = []
        for token in raw.split():
            if token.startswith("name:"):
                found["name"] = token[5:].lower()
            elif token.startswith("type:"):
                found["kind"] = token[5:].lower()
            elif token.startswith("size:"):
                if token[5:6] in ("<", ">") and token[6:].isdigit():
                    found["least" if token[5] == ">" else "most"] = int(token[6:])
            else:
                words.append(token)
        return cls(" ".join(words), **found)

    def condition(self) -> Column:
        """What the filters ask of ``filename`` and ``size``."""
        out = F.lit(True)
        if self.name is not None:
            out &= F.lower("filename").contains(self.name)
        if self.kind is not None:
            out &= F.lower(extension(F.col("filename"))) == self.kind
        if self.least is not None:
            out &= F.col("size") >= self.least
        if self.most is not None:
            out &= F.col("size") <= self.most
        return out


def extension(filename: Column) -> Column:
    """What follows the last dot; the whole name if there is none."""
    return F.substring_index(filename, ".", -1)


def name_part(text: Column) -> Column:
    """Sixteen sums of byte values by place modulo 16, over 255 and the length."""
    values = bits.byte_values(F.encode(text, "UTF-8"))
    n = F.greatest(F.size(values), F.lit(1))
    at = lambda k: F.filter(values, lambda v, i: i % NAME_DIM == k)
    return F.array(*(F.aggregate(at(k), F.lit(0.0), lambda s, v: s + v / F.lit(255.0)) / n for k in range(NAME_DIM)))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def file_vector(filename: Column, size: Column, hash16: Column) -> Column:
    """The 32 numbers of a file's metadata, normalised."""
    ext = extension(filename)
    hashed = bits.djb2(F.encode(ext, "UTF-8"))
    by_size = F.array(F.when(size > 0, F.greatest(F.log(size.cast("double")), F.lit(0.0)) / 30).otherwise(0.0), F.least(size / F.lit(1e6), F.lit(1.0)), flag(size < 1024), flag(size > 1_000_000))
    by_hash = F.transform(bits.byte_values(F.unhex(hash16)), lambda b: b / F.lit(255.0))
    by_type = F.array(hashed.bitwiseAND(F.lit(255).cast("long")) / F.lit(255.0), F.shiftright(hashed, 8).bitwiseAND(F.lit(255).cast("long")) / F.lit(255.0), flag(ext.isin(*TEXT_TYPES)), flag(ext.isin(*IMAGE_TYPES)))
    return bits.normalised(F.concat(name_part(filename), by_size, by_hash, by_type))


def query_vector(text: Column) -> Column:
    """The numbers of a query: its bytes as a name's, and flags for words that speak of size or type."""
    low = F.lower(text)
    says = lambda *words: flag(F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w)))
    zero = F.lit(0.0)
    rest = [zero, zero, says("small", "tiny"), says("large", "big"), *[zero] * 10, says("text", "document"), says("image", "photo")]
    return bits.normalised(F.concat(name_part(text), F.array(*rest)))


def search(files: DataFrame, raw: str, k: int = 10, after_ranking: bool = False) -> DataFrame:
    """The k best files (file_id, filename, size, content_hash) for a query, with score.

    Filters come first.  With ``after_ranking`` they see only the best 2k, and so
    may leave fewer than there are.  Without free text all score 1.  Ties go to
    the smaller file_id.
    """
    query = Query.parse(raw)
    score = F.lit(1.0)
    if query.text:
        asked = files.sparkSession.range(1).select(query_vector(F.lit(query.text))).first()[0]
        like = lambda v: bits.cosine(v, F.array(*map(F.lit, asked)))
        score = F.round(F.transform(F.array(file_vector(F.col("filename"), F.col("size"), F.col("content_hash"))), like)[0], 9)
    best = (F.desc("score"), F.asc("file_id"))
    if after_ranking and query.text:
        return files.withColumn("score", score).orderBy(*best).limit(2 * k).where(query.condition()).orderBy(*best).limit(k)
    return files.where(query.condition()).withColumn("score", score).orderBy(*best).limit(k)


def nearest(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of greatest cosine with ``query``; ties go to the smaller id."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    return vectors.select(F.col(id_col), F.round(bits.cosine(v, query), 6).alias("score")).orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def unit(column: pa.Array) -> np.ndarray:
    """Rows of arrays as a matrix of rows of length one; zero rows stay."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def best_of(names: np.ndarray, asked: np.ndarray, batches, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query (its unit vector a row of ``asked``) the k best ids and scores, best first, over batches of vec_id and embedding; fewer if there are fewer."""
    n = len(names)
    ids, best, worst = np.zeros((n, 0), dtype=np.int64), np.zeros((n, 0)), np.full((n, 1), -np.inf)
    for batch in batches:
        for i in range(0, len(batch), SCANNED):
            new, v = batch["vec_id"].slice(i, SCANNED).to_numpy(), unit(batch["embedding"].slice(i, SCANNED))
            score = np.round(asked @ v.T, 6)
            if best.shape[1] < k < len(new):  # what a query's k best among these leave out can't be among its k best
                worst = np.maximum(worst, np.partition(score, -k, axis=1)[:, -k:][:, :1])
            row, column = np.nonzero(~(score < worst))  # few, once k good ones are held
            if not len(row):
                continue
            hit, held = np.unique(row), np.arange(best.shape[1])
            of = np.concatenate([np.repeat(hit, len(held)), row])
            name, value = np.concatenate([ids[hit].ravel(), new[column]]), np.concatenate([best[hit].ravel(), score[row, column]])
            order = np.lexsort((name, -value, of))
            begin = np.searchsorted(of[order], hit)
            nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            top = order[nth < k]
            width = min(k, len(held) + len(new))
            if width > len(held):
                ids, best = np.zeros((n, width), dtype=np.int64), np.zeros((n, width))
            ids[hit], best[hit] = name[top].reshape(len(hit), width), value[top].reshape(len(hit), width)
            if width == k > 0:
                worst = best[:, -1:].copy()
    return ids, best


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = 1024) -> DataFrame:
    """(query_id, vec_id, score): for each row of ``queries`` the k of ``vectors`` of greatest cosine; ties go to the smaller id.

    Both have vec_id (long) and embedding.  Queries come in blocks of at most
    ``block_rows``, each broadcast and scanned against all vectors; tasks keep the
    k best of every query, which a shuffle by query merges.  Of the vectors scanned
    at once only those that may be among a query's k best are sorted.  A vector of length
    zero has cosine 0; null vectors are left out.
    """
    context = vectors.sparkSession.sparkContext
    ours = vectors.select("vec_id", "embedding").where("embedding is not null and vec_id is not null")

    def scan(block):
        def run(batches):
            names, asked = block.value
            ids, best = best_of(names, asked, batches, k)
            yield pa.record_batch({"query_id": pa.array(np.repeat(names, ids.shape[1])), "vec_id": pa.array(ids.ravel()), "score": pa.array(best.ravel())})

        return run

    def blocks():
        held = []
        for row in queries.select("vec_id", "embedding").where("embedding is not null and vec_id is not null").toLocalIterator():
            held.append((row[0], row[1]))
            if len(held) == block_rows:
                yield held
                held = []
        if held:
            yield held

    kind = "query_id long, vec_id long, score double"
    found = [ours.mapInArrow(scan(context.broadcast((np.array([i for i, _ in b], dtype=np.int64), unit(pa.array([v for _, v in b]))))), kind) for b in blocks()]
    partial = reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], kind)
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).drop("rank")
