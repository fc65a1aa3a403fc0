"""SimHash near-dedup with a vantage-point tree over the fingerprints.

Fingerprints of equal value are one point.  A tree of vantage points, grown on
a sample, splits the points by their Hamming distance to each vantage
point: up to the median inside, the rest outside.  It is as deep as the number
of points asks for, about LEAF points a leaf; the sample is 1/512 of the points
and 4 million of them at most.  A leaf is a shard.  Every
point lives in one shard, and also visits each shard that its search ball
overlaps: with distance d to a vantage point of radius m, the triangle bound
lets a search of radius r skip the inside if d > m + r, the outside if
d <= m - r.  For a pair on two sides of a split only the inner point visits the
outer side, so each linked pair meets in exactly one shard.  Shards that come out
larger than a cell may be are dealt out as a grid of cells.  A cell unites what it finds and emits
one edge a point at most; components then form by alternating star rounds, each
written to the shared folder.

A text without words (null, empty, blank) has fingerprint zero, which links
like any other.  Repeated rows and ids are points of equal value.  A null id is
less than none: a component's least id is that of its rows that have one.  Very
long texts are hashed SHINGLES_AT_ONCE shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import lookup, written

#: The tree: points of a leaf, sampled points of a leaf and of the tree, points dealt at once, points in a cell that live there or visit.
LEAF, SAMPLED, SAMPLE, AT_ONCE, HOME, VISITS = 8192, 16, 1 << 22, 1 << 19, 16384, 131072
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half the shingle hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        part = words[i : i + SHINGLES_AT_ONCE + width - 1]
        grams = zip(*(part[k:] for k in range(width)), strict=False) if len(words) >= width else [part]
        digests = b"".join([xxhash.xxh64_digest(b" ".join(g), seed) for g in grams])
        votes += np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches):
        for batch in batches:
            fps = [0 if t is None else fingerprint(t.encode(), width, seed) for t in (x.as_py() for x in batch["text"])]
            yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@dataclass
class VantageTree:
    """Node k splits into 2k+1 (inside) and 2k+2; nodes of radius -1 are leaves."""

    points: np.ndarray
    radii: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, depth: int) -> VantageTree:
        size = (1 << (depth + 1)) - 1
        points, radii = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int8)
        held = {0: sample}
        for k in range((1 << depth) - 1):
            have = held.pop(k, None)
            if have is None or len(have) < 2:
                continue
            # of a few candidates, the point from which the others are spread the most
            tried = have[:: max(1, len(have) // 8)][:8]
            seen = have[:: max(1, len(have) // 4096)]
            best = tried[np.argmax(np.bitwise_count(seen[None, :] ^ tried[:, None]).std(axis=1))]
            d = np.bitwise_count(have ^ best)
            m = int(np.median(d))
            if m >= d.max():
                m = int(d.max()) - 1
            if m < d.min():
                continue
            points[k], radii[k] = best, m
            held[2 * k + 1], held[2 * k + 2] = have[d <= m], have[d > m]
        return cls(points, radii)

    def deal(self, fps: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, int, bool]]:
        """(positions in fps, leaf, whether they live there) of every shard that points live in or visit."""
        todo = [(0, np.arange(len(fps), dtype=np.int32), np.zeros(0, dtype=np.int32))]
        while todo:
            k, home, visit = todo.pop()
            if not len(home) and not len(visit):
                continue
            point, m = self.points[k], int(self.radii[k])
            if m < 0:
                yield home, k, True
                yield visit, k, False
                continue
            dh, dv = np.bitwise_count(fps[home] ^ point).astype(np.int16), np.bitwise_count(fps[visit] ^ point).astype(np.int16)
            todo.append((2 * k + 1, home[dh <= m], visit[dv <= m + reach]))
            todo.append((2 * k + 2, home[dh > m], np.concatenate([visit[dv > m - reach], home[(dh <= m) & (dh > m - reach)]])))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; label[x] is the least member of the set of x."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def link_cell(home: np.ndarray, visit: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, least point of its set) among the points of one cell."""
    nodes = np.unique(np.concatenate([home, visit]))
    label = np.arange(len(nodes))
    if not len(home) or not len(visit):
        return nodes[:0], nodes[:0]
    pivot = home[0]
    dh, dv = np.bitwise_count(home ^ pivot).astype(np.int16), np.bitwise_count(visit ^ pivot).astype(np.int16)
    order = np.argsort(dh, kind="stable")
    home, dh = home[order], dh[order]
    at_home, step = np.searchsorted(nodes, home), max(1, (1 << 20) // len(home))
    for d in np.unique(dv):
        lo, hi = np.searchsorted(dh, [d - reach, d + reach + 1])
        if lo == hi:
            continue
        near = visit[dv == d]
        for i in range(0, len(near), step):
            part = near[i : i + step]
            x, y = np.nonzero(np.bitwise_count(part[:, None] ^ home[None, lo:hi]) <= reach)
            if len(x):
                label = unite(label, np.searchsorted(nodes, part)[x], at_home[lo:hi][y])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(points: DataFrame, reach: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that give the components of "at most ``reach`` bits apart"."""
    n = points.count()
    depth = max(0, (min(n // LEAF, SAMPLE // SAMPLED) - 1).bit_length()) if n > LEAF else 0
    share = min(1.0, SAMPLED * (1 << depth) / max(n, 1))
    sample = points.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("fp").toArrow()["fp"].to_numpy().view(np.uint64)
    tree = VantageTree.grow(sample[np.argsort(K.mix(sample))], depth) if depth else VantageTree(np.zeros(1, dtype=np.uint64), np.full(1, -1, dtype=np.int8))
    tree = points.sparkSession.sparkContext.broadcast(tree)  # a node for LEAF points

    def deal(batches):
        def leaves(fps):
            held, size = [], 0
            for at, leaf, lives in tree.value.deal(fps, reach):
                for i in range(0, len(at), 1 << 18):
                    held.append((at[i : i + (1 << 18)], leaf, lives))
                    size += len(held[-1][0])
                    if size >= 1 << 18:
                        yield held
                        held, size = [], 0
            yield held

        def send(fps):
            for held in leaves(fps):
                n = [len(h[0]) for h in held]
                at = np.concatenate([h[0] for h in held]) if held else np.zeros(0, dtype=np.int32)
                yield pa.record_batch({"leaf": pa.array(np.repeat([h[1] for h in held], n).astype(np.int32)), "fp": pa.array(fps[at].view(np.int64)), "lives": pa.array(np.repeat([h[2] for h in held], n).astype(bool))})

        held, size = [], 0
        for batch in batches:
            held.append(batch["fp"].to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield from send(np.concatenate(held))
                held, size = [], 0
        if held:
            yield from send(np.concatenate(held))

    dealt = written(points.select("fp").mapInArrow(deal, "leaf int, fp long, lives boolean"), "shards")
    counts = dealt.groupBy("leaf").agg(F.sum(F.col("lives").cast("int")).alias("home"), F.count(F.lit(1)).alias("all"))
    grid = counts.select("leaf", F.greatest(F.lit(1), F.ceil(F.col("home") / HOME)).cast("int").alias("rows"), F.ceil(F.col("all") / VISITS).cast("int").alias("cols"))
    dealt = dealt.join(F.broadcast(written(grid, "grid")), "leaf")  # a row for LEAF points
    rows, cols = F.col("rows"), F.col("cols")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), rows).cast("int")
    yours = F.pmod(F.xxhash64("fp", F.lit(2)), cols).cast("int")
    every = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    # who lives in a shard stands in one row of its grid, who visits it (its own points too) in one column
    homes = dealt.where("lives").select("leaf", mine.alias("r"), F.explode(every(cols)).alias("c"), "fp", F.lit(True).alias("lives"))
    visits = dealt.select("leaf", F.explode(every(rows)).alias("r"), yours.alias("c"), "fp", F.lit(False).alias("lives"))

    def cell(group: pa.Table) -> pa.Table:
        fps, lives = group["fp"].to_numpy().view(np.uint64), group["lives"].to_numpy()
        a, b = link_cell(fps[lives], fps[~lives], reach)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return homes.unionByName(visits).groupBy("leaf", "r", "c").applyInArrow(cell, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component, for every node of an edge that is not a root.

    Alternates large-star and small-star rounds until the edges are stars.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")).select("u", F.least("u", "m").alias("m"), "rows"), "least")
        large = lookup(both, least, "u", "rows").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, reach: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = written(fingerprints(docs, width, seed, id_col, text_col), "prints")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("rows")), "points")
    roots = written(components(links(points, reach)), "roots")
    grouped = written(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "grouped")
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("points"))
    named = lookup(grouped, written(least, "least"), "root", "points").select("fp", "component_id", "rows")
    found = lookup(prints, written(named, "named"), "fp", "rows")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, reach: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """Of each component the row with its smallest doc_id, all columns kept.

    Rows of one component that tie (equal ids, or no row of it has an id) leave
    the one with the least hash of its text; equal ids in different components
    both stay.
    """
    # rows are told apart by id and text, which also give the fingerprint; what is equal in both is one component's
    name = [F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")]
    prints = written(fingerprints(docs.select(F.struct(*name).alias("doc_id"), "text"), width, seed), "prints")
    named = prints.select("fp", F.struct(F.col("doc_id.id").isNull().alias("none"), "doc_id.*").alias("name"))
    points = written(named.groupBy("fp").agg(F.min("name").alias("least")), "points")
    roots = written(components(links(points, reach)), "roots")
    rooted = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stays = written(rooted.groupBy("root").agg(F.min(F.struct("least", "fp")).alias("k")).select("k.fp", F.col("k.least").alias("key")), "kept")
    twice = named.join(stays, "fp").where("name = key").groupBy("fp").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").limit(1).count()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), *name).alias("key"))
    # a key's rows are equal in id and text: one of them stays
    out = rows.join(stays.select("key").hint("merge"), "key", "left_semi")  # as many as the documents: never broadcast
    return (out.dropDuplicates(["key"]) if twice else out).select("row.*")
