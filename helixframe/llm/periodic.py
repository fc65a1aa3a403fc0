"""Periodic run detection: every maximal stretch of words that repeats with a period.

A run of period q and length at least max(12, 2q) holds each of its words twice
or more, so a word that stands once in a segment belongs to no run and splits
it.  Splitting goes on inside the pieces until no piece has such a word; pieces
under 12 words hold nothing.  The survivors are scanned lag by lag: at lag q a
run covers two neighbouring multiples of q, so only those positions are
compared, and where the words agree, the stretch that keeps the lag is measured
both ways by bisected rolling hashes.  A segment of n words takes about n ln n
comparisons.  Words are numbered exactly, and every stretch found is compared
word by word; if a hash misled, its segment is scanned again without hashes.

Rounds of splitting work on all segments of a batch at once; the few that need
many rounds are split from both ends inwards, which takes n log n steps at any
depth.  Documents don't meet: there is no shuffle, and a batch is worked off in
pieces of ``PIECE`` bytes.

Null and empty texts have no words and no runs.  Repeated rows and ids are
documents of their own.  A very long text is a piece of its own, at about 150
bytes of memory a word.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Words of the shortest run; its period may be half as long.
LEAST = 12
PIECE = 2 << 20
#: Pairs of positions compared at once, and rounds in which all segments split together.
PAIRS, ROUNDS = 1 << 20, 16
RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered(words: K.Words) -> np.ndarray:
    """The same number for the same word, exactly."""
    size = words.end - words.start
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    held = words.data[K.SPACED[words.data]]
    column = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(held)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def neighbours(ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word stands before and after in its document; -1 and n where it doesn't."""
    n = len(ids)
    order = np.lexsort((ids, row))  # stable: positions of a word ascend
    same = (ids[order][1:] == ids[order][:-1]) & (row[order][1:] == row[order][:-1])
    before, after = np.full(n, -1), np.full(n, n)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def split_inwards(lo: int, hi: int, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stable pieces of one segment; each split costs the smaller side."""
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        lone = (i for k in range((hi - lo + 1) // 2) for i in (lo + k, hi - 1 - k) if before[i] < lo and after[i] >= hi)
        cut = next(lone, None)
        if cut is None:
            yield lo, hi
        else:
            todo += [(lo, cut), (cut + 1, hi)]


def surviving(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the segments in which every word stands at least twice."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before, after = neighbours(ids, row)
    lo, hi = first[:-1], first[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        wide = hi - lo >= LEAST
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            break
        size = hi - lo
        segment = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(segment)) - np.repeat(np.cumsum(size) - size, size) + lo[segment]
        lone = (before[at] < lo[segment]) & (after[at] >= hi[segment])
        split = np.zeros(len(lo), dtype=bool)
        split[segment[lone]] = True
        done.append((lo[~split], hi[~split]))
        cuts = at[lone]
        lo, hi = lo[split], hi[split]
        # a cut ends a piece and begins the next; the others end with their segment
        lo, hi = np.sort(np.concatenate([lo, cuts + 1])), np.sort(np.concatenate([cuts, hi]))
    deep = [piece for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for piece in split_inwards(a, b, before, after)]
    done.append((np.array([a for a, _ in deep], dtype=np.int64), np.array([b for _, b in deep], dtype=np.int64)))
    return np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])


def lag_pairs(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions at multiples of each lag up to half a segment: (segment, position, lag), about PAIRS at once."""
    half = (hi - lo) // 2
    for i, j in K.chunks(half, np.concatenate([[0], np.cumsum(half)]), PAIRS):
        segment = np.repeat(np.arange(i, j), half[i:j])
        lag = np.arange(len(segment)) - np.repeat(np.cumsum(half[i:j]) - half[i:j], half[i:j]) + 1
        steps = (hi[segment] - lo[segment] - 1) // lag
        for a, b in K.chunks(steps, np.concatenate([[0], np.cumsum(steps)]), PAIRS):
            which = np.repeat(np.arange(a, b), steps[a:b])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(steps[a:b]) - steps[a:b], steps[a:b])
            yield segment[which], lo[segment[which]] + nth * lag[which], lag[which]


def bisected(agree, most: np.ndarray) -> np.ndarray:
    """The largest count up to ``most`` for which ``agree`` holds; it holds for all smaller ones, and for 0."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        ok = agree(middle) & open_
        low = np.where(ok, middle, low)
        high = np.where(open_ & ~ok, middle - 1, high)
    return low


def scanned(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Stretches (start, end, lag, segment) that keep a lag and are long enough, found with rolling hashes; of equal bounds the smallest lag."""
    if not len(lo):
        return np.zeros((0, 4), dtype=np.int64)
    power = K.power_table(K.WORD_BASE, len(ids) + 1)
    sums = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(K.mix(ids.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    found = []
    for segment, t, q in lag_pairs(lo, hi):
        near = ids[t] == ids[t + q]
        segment, t, q = segment[near], t[near], q[near]
        a, b = lo[segment], hi[segment]
        # six words in a row keep the lag in the shortest stretch, so one beside t does
        left, right = np.maximum(t - 1, a), np.minimum(t + 1, b - q - 1)
        near = ((t > a) & (ids[left] == ids[left + q])) | ((t + q + 1 < b) & (ids[right] == ids[right + q]))
        t, q, a, b, segment = t[near], q[near], a[near], b[near], segment[near]
        if not len(t):
            continue
        same = lambda x, y: (sums[x + y] - sums[x]) * power[q] == sums[x + y + q] - sums[x + q]  # noqa: E731, B023
        more = bisected(lambda n: same(t, n), b - t - q)  # noqa: B023
        less = bisected(lambda n: same(t - n, n), t - a)  # noqa: B023
        start, end = t - less, t + q + more
        good = end - start >= np.maximum(LEAST, 2 * q)
        found.append(np.unique(np.stack([start, end, q, segment], axis=1)[good], axis=0))
    every = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), dtype=np.int64)
    if not len(every):
        return every
    fresh = np.ones(len(every), dtype=bool)
    fresh[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    return every[fresh]


def plainly_scanned(ids: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """The same for one segment, by comparing all its words at every lag."""
    best: dict[tuple[int, int], int] = {}
    own = ids[lo:hi]
    for q in range(1, len(own) // 2 + 1):
        match = np.concatenate([[False], own[:-q] == own[q:], [False]])
        for a, b in np.flatnonzero(match[1:] != match[:-1]).reshape(-1, 2).tolist():
            if b + q - a >= max(LEAST, 2 * q):
                best.setdefault((lo + a, lo + b + q), q)
    return [(a, b, q) for (a, b), q in best.items()]


def proven(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which stretches keep their lag, compared word by word."""
    size = runs[:, 1] - runs[:, 2] - runs[:, 0]
    out = np.ones(len(runs), dtype=bool)
    for i, j in K.chunks(size, np.concatenate([[0], np.cumsum(size)]), PAIRS):
        which = np.repeat(np.arange(i, j), size[i:j])
        at = np.arange(len(which)) - np.repeat(np.cumsum(size[i:j]) - size[i:j], size[i:j]) + runs[which, 0]
        out[which[ids[at] != ids[at + runs[which, 2]]]] = False
    return out


def all_runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Every run (start, end, period) of documents whose words begin at ``first``, by start, then period."""
    lo, hi = surviving(ids, first)
    runs = scanned(ids, lo, hi)
    wrong = np.unique(runs[~proven(ids, runs), 3])
    if len(wrong):
        again = [x for s in wrong.tolist() for x in plainly_scanned(ids, int(lo[s]), int(hi[s]))]
        runs = np.concatenate([runs[~np.isin(runs[:, 3], wrong)][:, :3], np.array(again, dtype=np.int64).reshape(-1, 3)])
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))][:, :3]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_words, runs (by start, then period; word numbers from 0), collapsed_text.

    The collapsed text has, of each run, only its first period: its words joined
    by one space, without those that stand in any run behind its first period.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def piece(ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        words = K.find_words(data, offsets)
        first = words.first
        runs = all_runs(numbered(words), first)
        cover = np.zeros(len(words.start) + 1, dtype=np.int64)
        np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
        np.add.at(cover, runs[:, 1], -1)
        drop = np.cumsum(cover)[:-1] > 0
        owner = np.searchsorted(first, runs[:, 0], side="right") - 1
        bounds = np.searchsorted(owner, np.arange(len(first)))
        start, length, period = runs[:, 0] - first[owner], runs[:, 1] - runs[:, 0], runs[:, 2]
        values = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        whole, kept = data.tobytes(), []
        for i in range(len(first) - 1):
            text = whole[offsets[i] : offsets[i + 1]].split()
            if bounds[i] < bounds[i + 1]:
                text = [w for w, x in zip(text, drop[first[i] : first[i + 1]].tolist(), strict=True) if not x]
            kept.append(b" ".join(text))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values).cast(kind)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first), pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed_text"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for i, j in K.chunks(data, offsets, PIECE):
                yield piece(batch.column(0).slice(i, j - i), data, offsets[i : j + 1])

    return own.mapInArrow(work, f"id {own.schema['id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed_text string").withColumnRenamed("id", id_col)


def longest(runs: str | Column) -> Column:
    """The run of greatest length as a struct (length, start, period); ties: smallest start, then period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["start"]).alias("start"), (-best["period"]).alias("period")))
