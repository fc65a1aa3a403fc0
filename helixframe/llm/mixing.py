"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected: the most even mix (exponent 0) that still keeps the
entropy at its target, or the most repeated source within its limit.  Weights
are then realised over a token budget.  Each source's documents are dealt to
blocks; an epoch of the source runs through a keyed permutation of its blocks
and, within each, of its documents, and the last epoch stops where the source's
share of the budget ends.  Copies fall into output blocks that each hold every
source by its weight.

The default budget is the least that reads each source at least once, so that
no document is cut.  Tokens are words.  A null source counts as the source "".
Sources without tokens have no share and are read once.  Rows equal in id, text
and source are one item that is taken or left as a whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import lookup, written

SEED = 17
#: Tokens and rows of a block of a source; tokens of an output block; bisection steps and how many one pass takes.
BLOCK_TOKENS, BLOCK_ROWS, MIX_TOKENS, STEPS, AT_ONCE = 1 << 20, 10_000, 1 << 22, 40, 5


@dataclass(frozen=True)
class Target:
    """Either ``entropy`` (a share of the greatest possible) or ``repeats`` (epochs of the most repeated source)."""

    entropy: float | None = None
    repeats: float | None = 2.0


def measured(docs: DataFrame) -> DataFrame:
    """A row for each distinct (source, doc_id, text): id columns, rows, and tokens of those rows together."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    keyed = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), "doc_id", F.xxhash64("text").alias("text_hash"), words.cast("long").alias("n"))
    return keyed.groupBy("mix_source", "doc_id", "text_hash").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("copies"))


def exponent(totals: DataFrame, target: Target) -> float:
    """Bisects in [0, 1]; each pass sums what a few steps need over the sources, in Spark."""
    everything = totals.agg(F.sum("tokens")).first()[0] or 1
    shares = totals.where("tokens > 0").select((F.col("tokens") / F.lit(everything)).alias("p"))
    lo, hi = 0.0, 1.0
    for _ in range(STEPS // AT_ONCE):
        tried = [lo + (hi - lo) * k / 2**AT_ONCE for k in range(2**AT_ONCE + 1)]
        sums = [f(F.pow("p", F.lit(a)) * x) for a in tried for f, x in ((F.sum, F.lit(1.0)), (F.sum, F.log("p")))]
        row = shares.agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("least"), F.max("p").alias("most"), *sums).first()
        n, least, most = row[0], row[1], row[2]
        if not n or least == most:
            return 1.0

        def too_even(k: int, row=row, tried=tried, n=n, least=least, most=most) -> bool:
            z, zlog, a = row[3 + 2 * k], row[4 + 2 * k], tried[k]
            if target.entropy is not None:
                return math.log(z) - a * zlog / z > target.entropy * math.log(n) + 1e-12
            return (most / least) ** (1 - a) > target.repeats + 1e-12

        if not too_even(0):
            return lo
        k = next((k for k in range(1, len(tried)) if not too_even(k)), len(tried) - 1)
        lo, hi = tried[k - 1], tried[k]
    return hi


def plan(totals: DataFrame, target: Target, budget: float | None = None) -> DataFrame:
    """Per source: weight, epochs (how often it is read, a fraction for the last) and blocks."""
    alpha = exponent(totals, target)
    raw = totals.withColumn("raw", F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha))).otherwise(0.0))
    z, slowest = raw.agg(F.sum("raw"), F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw")))).first()
    total = float(budget) if budget is not None else (slowest or 0.0) * (z or 0.0)
    wide = raw.withColumn("weight", F.col("raw") / F.lit(z or 1.0))
    epochs = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(total) / F.col("tokens"), 9)).otherwise(1.0)
    blocks = F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.ceil(F.col("items") / BLOCK_ROWS))
    return wide.select("mix_source", "tokens", "items", "weight", epochs.alias("epochs"), blocks.alias("blocks"))


def mix(docs: DataFrame, target: Target = Target(), budget: float | None = None, seed: int = SEED, mix_tokens: int = MIX_TOKENS) -> DataFrame:
    """A row for each time an item is read: doc_id, text_hash, mix_source, copies, epoch, mix_block, mix_order."""
    items = written(measured(docs), "items")
    totals = written(items.groupBy("mix_source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items")), "totals")
    sources = written(plan(totals, target, budget).withColumn("rows", F.col("items")), "plan").withColumnRenamed("tokens", "source_tokens")
    read = lookup(items, sources.drop("items"), "mix_source", "rows")
    read = read.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("blocks")))
    last = F.ceil("epochs") - 1
    read = read.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    read = read.withColumn("turn", F.xxhash64("doc_id", "text_hash", "epoch", F.lit(seed)))
    block = ["mix_source", "epoch", "block"]
    sizes = read.groupBy(*block).agg(F.sum("tokens").alias("size"))
    # a source may have very many blocks: they are summed in 1024 groups by the leading bits of their place, then within each
    epoch, place = ["mix_source", "epoch"], F.xxhash64("mix_source", "epoch", "block", F.lit(seed))
    sizes = sizes.withColumn("place", place).withColumn("part", F.shiftright("place", 54))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy(*epoch, "part").agg(F.sum("size").alias("size"))
    parts = parts.select(*epoch, "part", F.coalesce(F.sum("size").over(ahead(Window.partitionBy(*epoch).orderBy("part"))), F.lit(0)).alias("part_begin"))
    within = F.coalesce(F.sum("size").over(ahead(Window.partitionBy(*epoch, "part").orderBy("place", "block"))), F.lit(0))
    begins = sizes.withColumn("within", within).join(parts, [*epoch, "part"]).select(*block, (F.col("part_begin") + F.col("within")).alias("begin"))
    inside = Window.partitionBy(*block).orderBy("turn", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(begins, block)
    placed = placed.withColumn("at", F.col("begin") + F.col("inner"))
    taken = placed.where((F.col("epoch") + 1 <= F.col("epochs")) | (F.col("at") < (F.col("epochs") - F.col("epoch")) * F.col("source_tokens")))
    stream = F.col("epoch") * F.col("source_tokens") + F.col("at")
    mix_block = F.when(F.col("weight") > 0, F.floor(stream / (F.col("weight") * mix_tokens))).otherwise(0)
    return taken.select("doc_id", "text_hash", "mix_source", "copies", "tokens", "epoch", mix_block.alias("mix_block"), "turn").withColumnRenamed("turn", "mix_order")


def mixed_documents(docs: DataFrame, target: Target = Target(), budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix reads it; all columns kept."""
    key = F.struct(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))
    times = written(mix(docs, target, budget).groupBy("mix_source", "doc_id", "text_hash").agg(F.count(F.lit(1)).cast("int").alias("times")).select(F.struct(F.col("mix_source").alias("s"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).alias("key"), "times"), "times")
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    out = rows.join(times, rows["key"].eqNullSafe(times["key"]))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")
