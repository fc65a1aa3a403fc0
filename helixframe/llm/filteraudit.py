"""Filter interaction audit: what each filter removes, in every order of the filters.

Each document's failures are a mask of one bit a filter.  Spark counts the
documents of each part by mask, so that a part is a table of at most 2**k cells,
however many documents it has.  A Gray-code walk then visits all 2**k subsets of
active filters, toggling one filter a step: each cell keeps how many active
filters it fails, and the running survivors change by the cells whose counter
leaves or reaches zero.  The stored states give every step of every order as a
difference of two.

The duplicates filter needs the smallest id of each text: rows are counted by
text, part, labels and id, then by text, part and labels, so copies of one text
are few rows before they meet, however many there are.

Null texts are empty and empty texts are equal.  A null part is the empty
string, as is an empty one.  A row without an id fails no duplicates filter and
makes no other row fail it, and has no labels; rows of equal id and text are no
duplicates of each other.  A document with several label rows is good or toxic
if any of them says so; null labels say nothing.  Very long texts are measured
whole.  Empty tables give no rows.  Further columns of any name are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Salts of rows without an id, which have no labels to meet.
SALTS = 1024


def text_checks(text: Column, words: Column) -> list[Column]:
    """Failure conditions of one text: under 200 words; under half of them distinct; over 3 % capitals; signs of markup."""
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text), text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", checks=text_checks) -> DataFrame:
    """Counts by part and mask: part, mask, documents, good, toxic.

    Bit i of the mask is the failure of check i; the bit after the last check is
    a text that a row of smaller id has too.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), 0))
    failed = checks(F.col("text"), F.col("words"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    copy_bit = 1 << len(failed)
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0)
    own = own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")).withColumn("salt", salt)
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    flags = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    rows = own.withColumn("salt", F.col("salt").cast("long")).join(marks, ["id", "salt"], "left").select("id", "salt", "part", "digest", "mask", *flags)
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("id", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min(named).alias("top"))
    groups = written(groups, "texts")
    smallest = groups.groupBy("digest").agg(F.min("top.id").alias("smallest"))
    groups = groups.join(smallest, "digest")
    spared = F.when(F.col("top.id") == F.col("smallest"), F.col("top.n")).otherwise(0)
    copies = F.col("named") - F.coalesce(spared, F.lit(0))
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), copies.alias("n"))))
    split = groups.select("part", "good", "toxic", split.alias("cell")).select("part", "good", "toxic", "cell.*")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def subset_states(counts: np.ndarray) -> np.ndarray:
    """Survivors under every subset of filters, by a Gray-code walk; counts and states are indexed by mask."""
    masks = np.arange(len(counts))
    active_failures = np.zeros(len(counts), dtype=np.int64)
    alive = counts.sum(axis=0)
    states = np.empty_like(counts)
    states[0] = alive
    active = 0
    for step in range(1, len(counts)):
        flipped = step & -step  # the bit in which one Gray code differs from the next
        touched = masks & flipped > 0
        if active & flipped:
            active_failures[touched] -= 1
            alive = alive + counts[touched & (active_failures == 0)].sum(axis=0)
        else:
            alive = alive - counts[touched & (active_failures == 0)].sum(axis=0)
            active_failures[touched] += 1
        active ^= flipped
        states[active] = alive
    return states


def audit(counted: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from the ``cells`` of masks; a letter of ``filters`` is a bit, the first the lowest.

    kept, removed, redundant (fails this filter, removed earlier), unique_fails
    (fails no other), good_lost, toxic_lost, shapley (removed by this filter,
    summed over all orders): the average over orders times their number.
    """
    size = 1 << len(filters)
    orders = list(permutations(range(len(filters))))
    longs = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def walk(part: pa.Table) -> pa.Table:
        counts = np.zeros((size, 3), dtype=np.int64)
        at = part["mask"].to_numpy()
        for i, c in enumerate(("documents", "good", "toxic")):
            counts[at, i] = part[c].to_numpy()
        states = subset_states(counts)
        fails = [int(counts[np.arange(size) >> f & 1 > 0, 0].sum()) for f in range(len(filters))]
        rows, by_filter = [], [0] * len(filters)
        for order in orders:
            active = 0
            for step, f in enumerate(order, 1):
                before, after = states[active], states[active | 1 << f]
                active |= 1 << f
                lost = (before - after).tolist()
                by_filter[f] += lost[0]
                rows.append((f, "".join(filters[x] for x in order), step, int(after[0]), lost[0], fails[f] - lost[0], int(counts[1 << f, 0]), lost[1], lost[2]))
        f, order, step, *values = zip(*rows, strict=True)
        values.append([by_filter[x] for x in f])
        return pa.table({"part": pa.array([part["part"][0].as_py()] * len(rows)), "filter_order": pa.array(order), "step": pa.array(step, pa.int32())} | {c: pa.array(v, pa.int64()) for c, v in zip(longs, values, strict=True)})

    return counted.groupBy("part").applyInArrow(walk, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in longs))
