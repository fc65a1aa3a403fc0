"""Toxicity by class-conditional Kneser-Ney word models.

Two interpolated bigram models with absolute discounts, one of toxic and one of
ordinary documents, score a text by the difference of its length-normalised
log-likelihoods, taken over its words and NEUTRAL further ones of no weight.  A
text is the words START w1 .. wn END; x is a bigram's count
in the class, u a word's continuation count there (how many different words it
follows), N and n the sums of u over all words and of x over a history's
bigrams:

    P(w | v) = (max(x - D2, 0) + (B + sum min(x, D2)) C(w)) / (n + B)
    C(w)     = (max(u - D1, 0) + (sum min(u, D1)) S(w)) / N
    S(w)     = (max(u' - D, 0) + D V' / (V' + 1)) / N'

S has the continuation counts u' of both classes together and, for a word that
neither has, one share more than their V' words; each of the three sums to one.
D2 is below one, so every bigram of the smaller class counts and none is cut off;
the prior mass B alone decides how far a history's bigrams are trusted, and gives
way as its count grows.  D1 is large, so a word of few contexts has the shared S
in both classes and says nothing by itself.  The models are of one size: counts of the larger class are those expected of a random part of it that
has as many bytes as the smaller, f x and 1 - (1 - f)**x, as a larger class
would show more different contexts for every word.

Counts come from every labelled training row.  Tasks count distinct bigrams and
send them to ranges of the second word and of the first, so that neither a hot
word nor a hot history is one task, where they meet.  Nothing is dropped; the table of
counted words grows with the corpus.  Where x <= D2 the discounted count is zero
and where u <= D1 the ratio of the classes is the same for all words, so what
scoring has to know are the words and bigrams beyond their discounts.  They are
broadcast in blocks of BLOCK_BYTES, each a range of their keys.  Scoring is one
map, without a shuffle, whatever their number: a task holds HELD_TEXT of texts,
sorts the keys that stand in them, and has one block after the other in memory,
each asked only for the keys of its range.

A text without words (null, empty, signs only) has likelihood ratio 0.  Rows
without a label (none, or null) are scored and not learned from; of several
labels for one id, the larger holds.  A very long text is handled in one piece
with 40 bytes or so for each word.  If a class has no text, all ratios are 0.
Words are runs of letters and digits, A-Z lower-cased, told apart by 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import written

DISCOUNT, WORD_DISCOUNT, PAIR_DISCOUNT, PAIR_PRIOR = 0.75, 15.0, 0.75, 3e7
START, END = 1, 2
#: Words of ratio 0 that every text is taken to have besides, so that one word of a short text decides little.
NEUTRAL = 100
#: Rows, at most, on which the two numbers of the calibration are fitted; they are taken evenly by hash.
CALIBRATION_ROWS = 20_000
#: Bounds: bytes of text for a range of counts, bytes of the model in a block, bigrams that a task holds, bytes of labels that are broadcast, bytes of text that pass several blocks together.
COUNT_BYTES, BLOCK_BYTES, HELD, LABEL_BYTES, HELD_TEXT = 8 << 20, 48 << 20, 1 << 21, 64 << 20, 16 << 20
#: Ranges are leading bits of the second word and as many, or one less, of the first; at least this many together.
LEAST_BITS = 5


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of lower-cased words, and each row's first word."""
    words = K.find_words(data, offsets, K.ALNUM)
    return K.hash_words(words, lower=True), words.first


def bigrams(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows that have words: each bigram's first and second word, and its row."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    before, after = np.insert(ids, first[full], np.uint64(START)), np.insert(ids, first[full + 1], np.uint64(END))
    return before, after, np.repeat(full, n[full] + 1)


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return K.mix(before * np.uint64(K.WORD_BASE) + after)


def pack(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, as byte planes, which compress well."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def planes(x: np.ndarray) -> bytes:
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


def merge(before: list[np.ndarray], after: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams by their second word: keys, first words, second words, summed counts (classes, bigrams)."""
    before, after, counts = np.concatenate(before), np.concatenate(after), np.concatenate(counts, axis=1)
    keys, at, where = np.unique(pair_keys(before, after), return_index=True, return_inverse=True)
    summed = np.stack([np.bincount(where, weights=c, minlength=len(keys)) for c in counts]).astype(np.int64)
    order = np.argsort(after[at], kind="stable")
    at = at[order]
    return keys[order], before[at], after[at], summed[:, order]


def counted(train: DataFrame, word_bits: int, more_bits: int = 0) -> DataFrame:
    """Packed bigram counts of ``train`` (text, toxic), by range: distinct second words with their bigrams, first words, counts in each class."""

    def sent(held):
        _, before, after, counts = merge(*held)
        where = (after >> np.uint64(64 - word_bits)).astype(np.int64) << more_bits
        if more_bits:
            where |= (before >> np.uint64(64 - more_bits)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange((1 << word_bits + more_bits) + 1))
        out = {c: [] for c in ("range", "words", "runs", "before", "n0", "n1")}
        for r in np.flatnonzero(np.diff(cut)):
            at = order[cut[r] : cut[r + 1]]
            words, runs = np.unique(after[at], return_counts=True)
            for c, x in zip(out, (int(r), pack(words), planes(runs), before[at].tobytes(), *map(planes, counts[:, at])), strict=True):
                out[c].append(x)
        return pa.record_batch([pa.array(v, pa.int32() if c == "range" else pa.binary()) for c, v in out.items()], names=list(out))

    def run(batches):
        held, size = ([], [], []), 0
        for batch in batches:
            data, offsets = K.text_buffers(batch["text"])
            toxic = batch["toxic"].to_numpy(zero_copy_only=False).astype(bool)
            for i, j in K.chunks(data, offsets):
                before, after, row = bigrams(*text_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                is_toxic = toxic[i + row]
                _, *parts = merge([before], [after], [np.stack([~is_toxic, is_toxic])])
                for x, y in zip(held, parts, strict=True):
                    x.append(y)
                size += len(parts[0])
                if size > HELD:
                    yield sent(held)
                    held, size = ([], [], []), 0
        if size:
            yield sent(held)

    return train.select("text", "toxic").mapInArrow(run, "range int, words binary, runs binary, before binary, n0 binary, n1 binary")


def summed(sent: DataFrame, part: tuple[float, float]) -> DataFrame:
    """From ``counted``: rows of words (v null) with counts x and continuation counts u of each class and us of both, and rows of the bigrams beyond their discount."""

    def run(group: pa.Table) -> pa.Table:
        column = lambda c, f: [f(x) for x in group[c].to_pylist()]
        words = [np.repeat(w, n) for w, n in zip(column("words", unpack), column("runs", from_planes), strict=True)]
        counts = [np.stack(x) for x in zip(column("n0", from_planes), column("n1", from_planes), strict=True)]
        key, before, after, n = merge(column("before", lambda x: np.frombuffer(x, dtype=np.uint64)), words, counts)
        x = n * np.array(part)[:, None]
        u = np.stack([1 - (1 - f) ** c if f < 1 else c > 0 for f, c in zip(part, n, strict=True)]).astype(float)
        start = np.flatnonzero(np.concatenate([[True], after[1:] != after[:-1]]))
        total = lambda a: np.add.reduceat(a, start, axis=-1)
        far = np.flatnonzero((x > PAIR_DISCOUNT).any(axis=0))
        (x0, x1), (u0, u1), us = total(x), total(u), total(np.ones(len(after)))
        whole = lambda a: pa.array(a.view(np.int64))
        some = pa.table({"w": whole(after[start]), "v": pa.nulls(len(start), pa.int64()), "key": pa.nulls(len(start), pa.int64()), "x0": x0, "x1": x1, "u0": u0, "u1": u1, "us": us})
        zero = np.zeros(len(far))
        return pa.concat_tables([some, pa.table({"w": whole(after[far]), "v": whole(before[far]), "key": whole(key[far]), "x0": x[0, far], "x1": x[1, far], "u0": zero, "u1": zero, "us": zero})])

    return sent.groupBy("range").applyInArrow(run, "w long, v long, key long, x0 double, x1 double, u0 double, u1 double, us double")


def log_ratio(a: Column, b: Column) -> Column:
    return F.log(a) - F.log(b)


def weighed(counts: DataFrame) -> tuple[DataFrame, float]:
    """Log-likelihood ratios as (pair, key, value): of words, both as second and first of a bigram, and what bigrams add; and the ratio of every other word."""
    words = written(counts.where("v is null").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("x0", "x1", "u0", "u1", "us"))), "toxic-words")
    lesser = lambda c: F.sum(F.least(F.col(c), F.lit(WORD_DISCOUNT)))
    n0, n1, m0, m1, ns, vs = words.agg(F.sum("u0"), F.sum("u1"), lesser("u0"), lesser("u1"), F.sum("us"), F.count(F.lit(1))).first()
    if not n0 or not n1:
        return words.select(F.lit(False).alias("pair"), F.col("w").alias("key"), F.lit(0.0).alias("value")).limit(0), 0.0
    other = math.log(m1 / n1) - math.log(m0 / n0)
    shared = (F.greatest(F.col("us") - DISCOUNT, F.lit(0.0)) + DISCOUNT * vs / (vs + 1)) / F.lit(ns)
    c = [(F.greatest(F.col(f"u{k}") - WORD_DISCOUNT, F.lit(0.0)) + F.lit(m) * shared) / F.lit(n) for k, m, n in ((0, m0, n0), (1, m1, n1))]
    known = words.select("w", F.col("x0").alias("n0"), F.col("x1").alias("n1"), "u0", "u1", c[0].alias("c0"), c[1].alias("c1"))
    beyond = lambda k: F.greatest(F.col(f"x{k}") - PAIR_DISCOUNT, F.lit(0.0))
    pairs = counts.where("v is not null").select("w", "v", "key", beyond(0).alias("d0"), beyond(1).alias("d1"))
    # each text has one START and one END, so these occur equally often
    histories = known.select(F.when(F.col("w") == END, START).otherwise(F.col("w")).alias("v"), (F.col("n0") + PAIR_PRIOR).alias("n0"), (F.col("n1") + PAIR_PRIOR).alias("n1"))
    histories = written(pairs.groupBy("v").agg(F.sum("d0").alias("g0"), F.sum("d1").alias("g1")).join(histories, "v").select("v", "n0", "n1", (1 - F.col("g0") / F.col("n0")).alias("k0"), (1 - F.col("g1") / F.col("n1")).alias("k1")), "toxic-histories")
    far = known.where((F.col("u0") > WORD_DISCOUNT) | (F.col("u1") > WORD_DISCOUNT)).select(F.col("w").alias("key"), (log_ratio(F.col("c1"), F.col("c0")) - other).alias("value"))
    backed = histories.select(F.col("v").alias("key"), log_ratio(F.col("k1"), F.col("k0")).alias("value"))
    p = [F.col(f"d{k}") / F.col(f"n{k}") + F.col(f"k{k}") * F.col(f"c{k}") for k in (0, 1)]
    less = log_ratio(F.col("k1"), F.col("k0")) + log_ratio(F.col("c1"), F.col("c0"))
    added = pairs.join(histories, "v").join(known.select("w", "c0", "c1"), "w").select(F.lit(True).alias("pair"), "key", (log_ratio(p[1], p[0]) - less).alias("value"))
    single = far.unionByName(backed).groupBy("key").agg(F.sum("value").alias("value")).select(F.lit(False).alias("pair"), "key", "value")
    # files in the order of the keys, so that a block's range is read from a part of each
    return written(single.unionByName(added).sortWithinPartitions("key"), "toxic-model"), other


@dataclass
class ToxicModel:
    """Blocks of sorted words and bigrams with their log-likelihood ratios, the ratio of every other word, and the calibration score = logistic(scale * ratio + shift)."""

    other: float = 0.0
    blocks: list[Broadcast] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def of(cls, table: DataFrame, other: float, block_bytes: int = BLOCK_BYTES) -> ToxicModel:
        """Fetches a block at a time, a range of the keys' leading bits; each is about ``block_bytes`` at most."""
        bits = (max(0, 16 * table.count() - 1) // block_bytes).bit_length()
        model = cls(other)
        for k in range(1 << bits):
            # as signed numbers the keys of a block follow one another too
            low = (k << 64 >> bits) - (k << 1 >> bits << 64)
            rows = table.where(F.col("key").between(F.lit(low), F.lit(low + ((1 << 64) >> bits) - 1))) if bits else table
            rows = rows.orderBy("key").toArrow()
            pair = rows["pair"].to_numpy()
            keys, values = rows["key"].to_numpy().view(np.uint64), rows["value"].to_numpy()
            sides = []
            for side in (~pair, pair):
                order = np.argsort(keys[side])
                sides += [keys[side][order], values[side][order]]
            model.blocks.append(table.sparkSession.sparkContext.broadcast(sides))
        return model

    def ratios(self, rows: DataFrame) -> DataFrame:
        """``rows`` (a struct ``row`` with ``text``) with ``ratio``: log-likelihood per word as toxic, less that as ordinary; 0 without words."""
        row_type = rows.schema["row"].dataType.simpleString()
        return rows.select("row").mapInArrow(add_ratios(self.blocks, self.other), f"row {row_type}, ratio double")

    def scores(self, ratio: Column) -> Column:
        return F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), ratio * self.scale + self.shift))))


def looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, out: np.ndarray) -> None:
    """Puts the values of those of the asked keys that are there into ``out``; both ``keys`` and ``asked`` are sorted."""
    if not len(keys):
        return
    low, high = np.searchsorted(asked, keys[0]), np.searchsorted(asked, keys[-1], side="right")
    at = np.searchsorted(keys, asked[low:high])
    there = np.flatnonzero(keys[at] == asked[low:high])
    out[low + there] = values[at[there]]


def passing(blocks: list[Broadcast]) -> Iterator[list[np.ndarray]]:
    """The blocks' arrays one after the other; of several none stays in the worker, which reads them again from the executor's copy."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1 and hasattr(block, "_path"):
            vars(block).pop("_value", None)


def text_ratios(parts: list[tuple[np.ndarray, np.ndarray]], blocks: list[Broadcast], other: float) -> np.ndarray:
    """The ratios of rows, from the ids of their words and each row's first word, in parts."""
    ids, n = np.concatenate([i for i, _ in parts]), np.concatenate([np.diff(f) for _, f in parts])
    out, full = np.zeros(len(n)), np.flatnonzero(n)
    if not len(full):
        return out
    first = np.concatenate([[0], np.cumsum(n)])
    names, where = np.unique(np.append(ids, np.array([START, END], dtype=np.uint64)), return_inverse=True)
    before, after, _ = bigrams(ids, first)
    keys, at = np.unique(pair_keys(before, after), return_inverse=True)
    del before, after, ids
    word_value, pair_value = np.zeros(len(names)), np.zeros(len(keys))
    for words, values, pairs, added in passing(blocks):
        looked_up(words, values, names, word_value)
        looked_up(pairs, added, keys, pair_value)
    total = np.add.reduceat(word_value[where[:-2]], first[full]) + word_value[where[-2:]].sum()
    total += np.add.reduceat(pair_value[at], first[full] + np.arange(len(full)))
    out[full] = (total + other * (n[full] + 1)) / (n[full] + 1 + NEUTRAL)
    return out


def add_ratios(blocks: list[Broadcast], other: float):
    """Texts are held until they are HELD_TEXT, so that a block is loaded once for all of them; a single block stays loaded, and a chunk of texts goes by itself."""
    room = HELD_TEXT if len(blocks) > 1 else 0

    def run(batches):
        held, parts, done, size = [], [], [], 0

        def finished():
            # the batches whose rows all have a ratio
            ratio = np.concatenate([np.zeros(0), *done])
            while held and len(held[0]) <= len(ratio):
                batch = held.pop(0)
                yield pa.record_batch({"row": batch["row"], "ratio": pa.array(ratio[: len(batch)])})
                ratio = ratio[len(batch) :]
            done[:] = [ratio]

        for batch in batches:
            held.append(batch)
            data, offsets = K.text_buffers(batch["row"].field("text"))
            for i, j in K.chunks(data, offsets):
                parts.append(text_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                size += int(offsets[j] - offsets[i])
                if size >= room:
                    done.append(text_ratios(parts, blocks, other))
                    parts, size = [], 0
            yield from finished()
        if parts:
            done.append(text_ratios(parts, blocks, other))
        yield from finished()

    return run


#: Shares of rows labelled toxic whatever their text that the calibration tries.
NOISE = (0.0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.1, 0.15)

def calibrate(ratios: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic fit in which a share of the labels is noise.

    P(labelled toxic) = e + (1 - e) logistic(scale * ratio + shift), by scoring
    steps for each e tried; the fit is slightly drawn to zero, so it exists for
    any input.
    """
    if not len(ratios) or toxic.min() == toxic.max():
        return 1.0, -2.0
    spread = float(ratios.std()) or 1.0
    x = np.stack([ratios / spread, np.ones(len(ratios))], axis=1)
    best = None
    for e in NOISE:
        w = np.array([0.0, -2.0])
        for _ in range(100):
            s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            p, slope = e + (1 - e) * s, (1 - e) * s * (1 - s)
            weight = 1 / np.maximum(p * (1 - p), 1e-9)
            hessian = (x * (slope**2 * weight)[:, None]).T @ x + 1e-2 * np.eye(2)
            step = np.linalg.solve(hessian, x.T @ ((toxic - p) * weight * slope) - 1e-2 * w)
            w += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        p = np.clip(e + (1 - e) / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
        fit = (toxic * np.log(p) + (1 - toxic) * np.log(1 - p)).sum() - 5e-3 * (w @ w)
        if best is None or fit > best[0] + 1e-6:
            best = fit, max(float(w[0]) / spread, 1e-6), float(w[1])
    return best[1:]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learns from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers and that aren't held out.

    All are counted.  The calibration is fitted on at most CALIBRATION_ROWS of them,
    taken by hash of the id.  Labels grow with the documents: they are broadcast
    only up to LABEL_BYTES, and joined by a shuffle of labelled texts beyond that.
    """
    free = ~held_out(F.col("doc_id"))
    known = labels.select("doc_id", F.col("toxic").cast("int").cast("boolean").alias("toxic")).where("toxic is not null").where(free).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    train = docs.select("doc_id", "text").where(free).join(known.hint("broadcast" if 32 * n <= LABEL_BYTES else "merge"), "doc_id")
    size = dict(train.groupBy("toxic").agg(F.sum(F.octet_length("text").cast("long"))).collect())
    ordinary, toxic = size.get(False) or 0, size.get(True) or 0
    least = min(ordinary, toxic)
    part = (least / max(ordinary, 1), least / max(toxic, 1))
    bits = max(LEAST_BITS, ((ordinary + toxic) // COUNT_BYTES).bit_length())
    counts = written(summed(counted(train, bits - bits // 2, bits // 2), part), "toxic-counts")
    model = ToxicModel.of(*weighed(counts))
    spare = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, CALIBRATION_ROWS / max(n, 1))))
    rows = model.ratios(spare.select(F.struct("text", "toxic").alias("row"))).select("row.toxic", "ratio").toArrow()
    model.scale, model.shift = calibrate(rows["ratio"].to_numpy(), rows["toxic"].to_numpy(zero_copy_only=False).astype(float))
    return model


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.7)."""
    ours = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(ours, labels)
    scored = model.ratios(ours.select(F.struct("doc_id", "text").alias("row"))).select(F.col("row.doc_id").alias("doc_id"), model.scores(F.col("ratio")).alias("value"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("value").alias("score"), (F.col("value") >= 0.7).cast("int").alias("predicted"))


def keep_ordinary(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, all columns kept."""
    model = fit(docs, labels)
    scored = model.ratios(docs.select(F.struct(*docs.columns).alias("row")))
    return scored.where(model.scores(F.col("ratio")) < 0.7).select("row.*")
