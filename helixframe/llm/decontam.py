"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are joined where they share a seed of five
words.  For each joined pair the longest common word runs that don't overlap are
marked, longest first, until no run of five words is left; the share of the
item's words that are marked decides.  As each run may stand anywhere, reordered
passages are found too.  The longest run is found by bisecting its length with
rolling Karp-Rabin hashes of the unmarked windows, so time and memory grow with
the words of a pair, not with its matches, however repetitive both are.

Benchmark items come in blocks of bounded size, each scanned against all
documents: a block's seeds are broadcast and looked up for every window of every
document, so documents aren't shuffled, and a passage that many of them hold
makes no task larger than another.

Words are runs of ASCII letters, digits and any character beyond ASCII, of the
lower-cased text, compared by 64-bit hash.  Null
and empty texts have none.  Items of fewer than five words have no seed and
match nothing.  Items with equal texts match alike; of repeated rows each gives
its own result rows.  A very long text is searched as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SEED, BLOCK_BYTES = 5, 4 << 20
TILES = "array<struct<doc:int,item:int,length:int>>"


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = K.find_words(data, offsets, K.ALNUM)
    return K.hash_words(words), words.first


@dataclass
class Items:
    """A block of benchmark items: words, distinct seeds with the items that have them (``of``), and where in these (``at``)."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    seed_cut: np.ndarray
    of: np.ndarray
    of_cut: np.ndarray
    at: np.ndarray

    @classmethod
    def of_rows(cls, rows: list[tuple]) -> Items:
        data, offsets = K.text_buffers(pa.array([t for _, t in rows], pa.string()))
        words, first = word_hashes(data, offsets)
        at = np.flatnonzero(K.window_starts(first, SEED))
        seeds = K.hash_windows(words, SEED)[at]
        order = np.argsort(seeds, kind="stable")
        seeds, at = seeds[order], at[order]
        item = np.searchsorted(first, at, side="right") - 1
        new_seed = np.concatenate([np.ones(min(1, len(at)), dtype=bool), seeds[1:] != seeds[:-1]])
        cut = np.flatnonzero(new_seed | np.concatenate([np.ones(min(1, len(at)), dtype=bool), item[1:] != item[:-1]]))
        seed_cut = np.append(np.searchsorted(cut, np.flatnonzero(new_seed)), len(cut))
        return cls([i for i, _ in rows], words, first, seeds[new_seed], seed_cut, item[cut], np.append(cut, len(at)), at)


def blocks(items: DataFrame, size: int) -> Iterator[Items]:
    """The items in blocks of about ``size`` bytes, fetched a partition at a time."""
    held, total = [], 0
    for row in items.toLocalIterator():
        held.append((row[0], row[1]))
        total += len(row[1] or "") + 64
        if total >= size:
            yield Items.of_rows(held)
            held, total = [], 0
    if held:
        yield Items.of_rows(held)


def open_windows(words: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``length`` unmarked words, and where they start."""
    used = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(used[length:] == used[: len(used) - length])
    return K.hash_windows(words, length)[at], at


def tile(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles (document word, item word, length), longest first, of at least a seed."""
    free_doc, free_item, out = np.ones(len(doc), dtype=bool), np.ones(len(item), dtype=bool), []
    most = min(len(doc), len(item))
    while most >= SEED:
        lo, hi = SEED - 1, most  # a common run of lo words is known, none of more than hi
        while lo < hi:
            length = (lo + hi + 1) // 2
            if np.isin(open_windows(item, free_item, length)[0], open_windows(doc, free_doc, length)[0]).any():
                lo = length
            else:
                hi = length - 1
        if lo < SEED:
            break
        hashes, at = open_windows(doc, free_doc, lo)
        keys, of = open_windows(item, free_item, lo)
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        shared = np.isin(hashes, keys)
        following: dict[int, int] = {}
        done = 0
        for a, h in zip(at[shared].tolist(), hashes[shared], strict=True):
            if a < done:
                continue
            begin, end = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
            k = max(int(begin), following.get(int(h), 0))
            while k < end and not free_item[of[k] : of[k] + lo].all():
                k += 1
            if k < end:
                b = int(of[k])
                free_doc[a : a + lo] = free_item[b : b + lo] = False
                out.append((a, b, lo))
                done = a + lo
                k = int(begin + np.searchsorted(of[begin:end], b + lo))
            following[int(h)] = k
        most = lo - 1
    return out


def matches(block: Items, words: np.ndarray, first: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, list]]:
    """(row, item, share covered, tiles) of the pairs in a chunk of documents that reach ``coverage``."""
    windows = K.hash_windows(words, SEED)
    inside = np.flatnonzero(K.window_starts(first, SEED))
    windows = windows[inside]
    seed = np.minimum(np.searchsorted(block.seeds, windows), max(0, len(block.seeds) - 1))
    hit = block.seeds[seed] == windows if len(block.seeds) else np.zeros(len(windows), dtype=bool)
    row = np.searchsorted(first, inside[hit], side="right") - 1
    # each seed once a row, and with each item that has it
    row, seed = np.divmod(np.unique(row * len(block.seeds) + seed[hit]), max(1, len(block.seeds)))
    if not len(row):
        return
    n = block.seed_cut[seed + 1] - block.seed_cut[seed]
    row = np.repeat(row, n)
    k = np.repeat(block.seed_cut[seed] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    item = block.of[k]
    order = np.lexsort((item, row))
    k, row, item = k[order], row[order], item[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(item) != 0)]))
    for a, b in zip(cut, np.append(cut[1:], len(k)), strict=True):
        r, i = int(row[a]), int(item[a])
        begin, size = block.first[i], block.first[i + 1] - block.first[i]
        of = np.concatenate([block.at[block.of_cut[x] : block.of_cut[x + 1]] for x in k[a:b]]) - begin
        # words under any seed: no tiling covers more
        edge = np.zeros(size + 1, dtype=np.int32)
        edge[of] += 1
        edge[of + SEED] -= 1
        if (np.cumsum(edge)[:size] > 0).sum() < coverage * size:
            continue
        tiles = tile(words[first[r] : first[r + 1]], block.words[begin : begin + size])
        share = sum(t[2] for t in tiles) / size
        if share >= coverage:
            yield r, i, share, tiles


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item whose tiles cover at least ``coverage`` of the item's words.

    Columns: doc_id, item_id, coverage, tiles (word positions and length).
    """
    context = docs.sparkSession.sparkContext
    ours = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    items = benchmark.select("item_id", F.lower("text").alias("text")).where("text is not null")
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {item_type.simpleString()}, coverage double, tiles {TILES}"
    tile_type = pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.int32()), ("length", pa.int32())]))

    def scan(block):
        def run(batches):
            items = block.value
            for batch in batches:
                data, offsets = K.text_buffers(batch["text"])
                rows, names, shares, tiles = [], [], [], []
                for i, j in K.chunks(data, offsets):
                    words, first = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for r, k, share, found in matches(items, words, first, coverage):
                        rows.append(i + r)
                        names.append(items.ids[k])
                        shares.append(share)
                        tiles.append([{"doc": a, "item": b, "length": n} for a, b, n in found])
                if rows:
                    yield pa.record_batch({"doc_id": batch["doc_id"].take(pa.array(rows)), "item_id": pa.array(names), "coverage": pa.array(shares), "tiles": pa.array(tiles, tile_type)})

        return run

    found = [ours.mapInArrow(scan(context.broadcast(b)), schema) for b in blocks(items, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns kept; rows are judged by their text, whatever their id."""
    from .storage import written

    # the text decides, so its hashes name the row; they are never null
    name = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    bad = written(contaminated(docs.select(name.alias("doc_id"), "text"), benchmark, coverage).select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), name.alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
