"""Quality by a generalised additive model with pairwise interactions.

Every text becomes 24 numbers.  The model is a sum of lookup tables: one for
each number's bins, learned by boosting shallow trees on one feature after the
other in cycles, then tables for the pairs of features that explain most of
what is left.  Scoring adds table entries and is vectorised over a batch.

The model is fitted on the driver, on at most ``FIT_ROWS`` labelled rows that
are taken evenly by hash of the id; every row is scored.  Texts without words
(null, empty, blank) have features too: zeros.  Rows without a label are not
learned from; of several labels for one id, the larger holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import written

FIT_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_WEIGHT, RIDGE = 150, 80, 0.1, 3, 10.0, 1.0


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SIGNS, STOPS, DIGITS = _class(b"#$%&*!@|~^<>{}[]\\_=+/"), _class(b".,;:?'\"-()"), _class(b"0123456789")
UPPER, LOWER, WIDE = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), np.arange(256) >= 128
SPACE = ~K.SPACED
LOUD, ENDS = _class(b"!"), _class(b".!?")
FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "longest_word", "short_words", "distinct_words", "top_word", "distinct_pairs", "distinct_fives",
    "signs", "stops", "digits", "upper", "wide", "space", "loud", "bars", "byte_entropy", "sign_ends", "stop_ends", "sentence_ends", "lines", "repeated_lines",
)


def row_features(text: bytes, length: np.ndarray, last: np.ndarray, words: np.ndarray, pairs: np.ndarray, fives: np.ndarray) -> list[float]:
    """The numbers of one text with at least one word."""
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size, n = len(text), len(words)
    share = lambda mask: count[mask].sum() / size
    p = count[count > 0] / size
    _, times = np.unique(words, return_counts=True)
    fresh = lambda x: len(np.unique(x)) / len(x) if len(x) else 1.0
    lines = [x for x in text.split(b"\n") if x]
    letters = count[UPPER].sum() + count[LOWER].sum()
    return [
        np.log1p(size), np.log1p(n), length.mean(), length.std(), np.log1p(length.max()), (length <= 3).mean(), len(times) / n, times.max() / n, fresh(pairs), fresh(fives),
        share(SIGNS), share(STOPS), share(DIGITS), count[UPPER].sum() / max(letters, 1), share(WIDE), share(SPACE), share(LOUD), count[124] / n, -(p * np.log(p)).sum(),
        SIGNS[last].mean(), STOPS[last].mean(), ENDS[last].mean(), len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the numbers of each text."""

    def run(batches):
        for batch in batches:
            data, offsets = K.text_buffers(batch["text"])
            out = np.zeros((len(batch), len(FEATURES)), dtype=np.float32)
            for i, j in K.chunks(data, offsets):
                part = data[offsets[i] : offsets[j]]
                w = K.find_words(part, offsets[i : j + 1] - offsets[i])
                words = K.hash_words(w, lower=True)
                pairs, fives = K.hash_windows(words, 2), K.hash_windows(words, 5)
                length, last = w.end - w.start, part[w.end - 1] if len(w.end) else part[:0]
                for k in range(i, j):
                    a, b = w.first[k - i], w.first[k - i + 1]
                    if a < b:
                        text = part[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]].tobytes()
                        out[k] = row_features(text, length[a:b], last[a:b], words[a:b], pairs[a : max(a, b - 1)], fives[a : max(a, b - 4)])
            bounds = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.record_batch({"doc_id": batch["doc_id"], "x": pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)], axis=1)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins; -inf if none has weight enough on both sides."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((hl >= LEAST_WEIGHT / 4) & (hr >= LEAST_WEIGHT / 4), gain, -np.inf)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-np.inf, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree of up to ``LEAVES`` leaves on one feature's bins."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        gain, cut, k = max((*best_cut(g[a:b], h[a:b]), k) for k, (a, b) in enumerate(leaves))
        if gain <= 1e-6:
            break
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton steps of a tree on two features: the better first split, then one on the other feature in each half."""
    best, out = -np.inf, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            gain, step = 0.0, np.zeros_like(a)
            for half in (slice(0, cut), slice(cut, None)):
                rows_g, rows_h = a[half].sum(axis=0), b[half].sum(axis=0)
                more, at = best_cut(rows_g, rows_h)
                parts = (slice(0, at), slice(at, None)) if more > 0 else (slice(0, None),)
                for p in parts:
                    s, w = rows_g[p].sum(), rows_h[p].sum()
                    gain += s**2 / (w + RIDGE)
                    step[half, p] = s / (w + RIDGE)
            if gain > best:
                best, out = gain, step.T if turned else step
    return best, out


@dataclass
class AdditiveModel:
    """score = logistic(base + single tables + pair tables)."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        fine, rough = binned(x, self.cuts), binned(x, self.coarse)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.single):
            total += t[fine[:, k]]
        for a, b, t in self.pairs:
            total += t[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits the tables by cyclic boosting on logistic loss."""
    if not len(y):
        x, y = np.zeros((1, len(FEATURES))), np.zeros(1)
    quantiles = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) for k in range(x.shape[1])]
    model = AdditiveModel(quantiles(BINS), quantiles(PAIR_BINS))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.base = float(np.log(rate / (1 - rate)))
    model.single = [np.zeros(len(c) + 1) for c in model.cuts]
    fine, rough = binned(x, model.cuts), binned(x, model.coarse)
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.single):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(fine[:, k], g, len(t)), np.bincount(fine[:, k], h, len(t)))
            t += step
            total += step[fine[:, k]]

    size = [len(c) + 1 for c in model.coarse]
    flat = lambda a, b: rough[:, a] * size[b] + rough[:, b]
    grid = lambda a, b, w: np.bincount(flat(a, b), w, size[a] * size[b]).reshape(size[a], size[b])
    g, h = slopes()
    ranked = sorted(((cross_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a in range(len(size)) for b in range(a) if size[a] > 1 and size[b] > 1), reverse=True)
    model.pairs = [(a, b, np.zeros((size[a], size[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in model.pairs:
            g, h = slopes()
            step = RATE * cross_tree(grid(a, b, g), grid(a, b, h))[1]
            t += step
            total += step[rough[:, a], rough[:, b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AdditiveModel:
    """Learns from at most about ``rows`` of the rows of ``measured`` (doc_id, x) that ``labels`` (doc_id, quality) covers and that aren't held out."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    got = measured.join(known, "doc_id").select("doc_id", "x", "quality").toArrow().sort_by("doc_id")
    return boost(matrix(got["x"].combine_chunks()).astype(np.float64), got["quality"].to_numpy().astype(float))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.7)."""
    measured = written(features(docs, id_col, text_col), "features")
    shared = spark.sparkContext.broadcast(fit(measured, labels))

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(shared.value.scores(matrix(batch["x"])))})

    kind = measured.schema["doc_id"].dataType.simpleString()
    scored = measured.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
