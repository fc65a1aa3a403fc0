"""Biological constraints on strands, as expressions.

``violations`` lists what is wrong with a strand, ``is_valid`` only whether
anything is; ``tally`` counts over whole tables, in Arrow batches.  Order of the list: length, GC share, GC share of windows,
homopolymer runs, palindromes.  An empty strand has only its length checked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from .codecs import ascii_bytes, bounded

VIOLATION = "struct<kind:string,position:int,length:int,actual:double,lo:double,hi:double>"


@dataclass(frozen=True)
class Limits:
    """GC bounds, longest run, least palindrome that counts (even), length bounds, window of the local GC share."""

    min_gc: float = 0.40
    max_gc: float = 0.60
    max_run: int = 3
    palindrome: int = 6
    min_length: int = 50
    max_length: int = 300
    window: int = 20


#: The presets.
LIMITS = {
    "default": Limits(),
    "relaxed": Limits(0.30, 0.70, 4, 8, 10, 500, 20),
    "strict": Limits(0.45, 0.55, 2, 4, 100, 200, 10),
    "strand-literal": Limits(min_length=150, max_length=200),
    "sequence-literal": Limits(palindrome=8, min_length=1, max_length=500),
    "primer": Limits(min_length=1, max_length=1000, window=20),
}


def _entry(kind: str, position=None, length=None, actual=None, lo=None, hi=None) -> Column:
    value = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(F.lit(kind).alias("kind"), value(position, "int").alias("position"), value(length, "int").alias("length"), value(actual, "double").alias("actual"), value(lo, "double").alias("lo"), value(hi, "double").alias("hi"))


def _if(condition: Column, entry: Column) -> Column:
    return F.when(condition, F.array(entry)).otherwise(F.array().cast(f"array<{VIOLATION}>"))


def run_starts(strand: Column) -> Column:
    """0-based starts of the homopolymer runs."""
    n = F.length(strand)
    at = F.sequence(F.lit(1), n)
    return F.transform(F.filter(at, lambda i: (i == 1) | (F.substring(strand, i, F.lit(1)) != F.substring(strand, i - 1, F.lit(1)))), lambda i: i - 1)


def palindrome_reach(strand: Column) -> Column:
    """For each place between two bases, half the length of the longest palindrome around it."""
    n = F.length(strand)
    other = dna.complement(strand)

    def reach(c: Column) -> Column:
        grow = lambda held, k: F.when((held == k - 1) & (F.substring(strand, c - k + 1, F.lit(1)) == F.substring(other, c + k, F.lit(1))), k).otherwise(held)
        return F.aggregate(F.sequence(F.lit(1), F.least(c, n - c)), F.lit(0), grow)

    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), reach)).otherwise(F.array().cast("array<int>"))


def violations(strand: Column, limits: Limits = LIMITS["default"]) -> Column:
    """All violations; of palindromes the first of each even length."""
    n, gc = F.length(strand), dna.gc_content(strand)
    some = n > 0
    found = [
        _if(n < limits.min_length, _entry("too_short", length=n, lo=limits.min_length, hi=limits.max_length)),
        _if(n > limits.max_length, _entry("too_long", length=n, lo=limits.min_length, hi=limits.max_length)),
        _if(some & ((gc < limits.min_gc) | (gc > limits.max_gc)), _entry("gc", actual=gc, lo=limits.min_gc, hi=limits.max_gc)),
    ]
    local = F.transform(dna.local_gc(strand, limits.window), lambda x, i: F.when((x < limits.min_gc) | (x > limits.max_gc), _entry("local_gc", position=i, length=limits.window, actual=x, lo=limits.min_gc, hi=limits.max_gc)))
    long_runs = F.transform(F.arrays_zip(run_starts(strand).alias("at"), dna.runs(strand).alias("run")), lambda r: F.when(F.length(r["run"]) > limits.max_run, _entry("homopolymer", position=r["at"], length=F.length(r["run"]), hi=limits.max_run)))
    reach = palindrome_reach(strand)
    sizes = F.sequence(F.lit(limits.palindrome // 2), F.array_max(reach))
    first = lambda k: F.array_min(F.filter(F.transform(reach, lambda r, i: F.when(r >= k, i + 1 - k)), lambda p: p.isNotNull()))
    mirrored = F.when(F.array_max(reach) >= limits.palindrome // 2, F.transform(sizes, lambda k: _entry("palindrome", position=first(k), length=2 * k))).otherwise(F.array().cast(f"array<{VIOLATION}>"))
    kept = [F.when(some, F.filter(x, lambda v: v.isNotNull())).otherwise(F.array().cast(f"array<{VIOLATION}>")) for x in (local, long_runs)]
    return F.concat(*found, *kept, F.when(some, mirrored).otherwise(F.array().cast(f"array<{VIOLATION}>")))


def is_valid(strand: Column, limits: Limits = LIMITS["default"]) -> Column:
    """No violation, without listing any; a longer palindrome always holds one of the least length."""
    n, gc = F.length(strand), dna.gc_content(strand)
    size = limits.palindrome
    mirrored = F.when(n >= size, F.exists(F.sequence(F.lit(1), n - size + 1), lambda i: dna.palindrome(F.substring(strand, i, F.lit(size))))).otherwise(False)
    local = F.forall(dna.local_gc(strand, limits.window), lambda x: x.between(limits.min_gc, limits.max_gc))
    inner = gc.between(limits.min_gc, limits.max_gc) & local & (dna.max_run(strand) <= limits.max_run) & ~mirrored
    return n.between(limits.min_length, limits.max_length) & ((n == 0) | inner)


#: Strands that are measured at once, and bytes by bytes as ``dna.complement`` has them.
AT_ONCE = 2_048
OTHER = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(b"ATGC", b"TACG")), dtype=np.uint8)


def measures(seq: pa.Array, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ASCII strands: length, count of G and C as ``dna.gc_count`` has it, longest run, and whether a limit is broken as ``is_valid`` says."""
    data, bounds = ascii_bytes(seq)
    n, end = np.diff(bounds), bounds[1:]
    strand = np.repeat(np.arange(len(n)), n)
    held = bounded((data != ord("A")) & (data != ord("T")))
    gc, longest = held[end] - held[bounds[:-1]], np.zeros(len(n), dtype=np.int64)
    share = gc / np.maximum(n, 1)
    broken = (n > 0) & ((share < limits.min_gc) | (share > limits.max_gc)) | (n < limits.min_length) | (n > limits.max_length)

    def inside(at: np.ndarray, size: int) -> np.ndarray:
        return strand[at[at + size <= end[strand[at]]]]

    if len(data) >= limits.window:
        few = np.arange(limits.window + 1) / limits.window
        bad = (few < limits.min_gc) | (few > limits.max_gc)
        broken[inside(np.flatnonzero(bad[held[limits.window :] - held[: -limits.window]]), limits.window)] = True
    size = limits.palindrome
    if len(data) >= size:
        other, last = OTHER[data], len(data) - size + 1
        mirrored = np.ones(last, dtype=bool)
        for k in range((size + 1) // 2):
            mirrored &= data[k : k + last] == other[size - 1 - k : size - 1 - k + last]
        broken[inside(np.flatnonzero(mirrored), size)] = True
    if len(data):
        at = np.flatnonzero(np.concatenate([[True], (data[1:] != data[:-1]) | (strand[1:] != strand[:-1])]))
        run = np.where(np.isin(data[at], np.frombuffer(b"ATGC", dtype=np.uint8)), np.diff(np.append(at, len(data))), 0)
        first = np.flatnonzero(np.concatenate([[True], strand[at][1:] != strand[at][:-1]]))
        longest[strand[at[first]]] = np.maximum.reduceat(run, first)
        broken |= longest > limits.max_run
    return n, gc, longest, broken


def tally(strands: DataFrame, limits: Limits = LIMITS["default"]) -> DataFrame:
    """One row over all of ``strands`` (seq): strands, nucleotides, avg_gc, max_run, violating; a batch leaves its task as one row of sums, and a null strand has no bases and breaks no limit."""

    def run(batches):
        for batch in batches:
            some, whole = [np.zeros(4)], batch["seq"]
            for i in range(0, len(whole), AT_ONCE):
                seq = whole.slice(i, AT_ONCE).drop_null()
                n, gc, longest, broken = measures(seq, limits)
                some.append(np.array([n.sum(), (gc / np.maximum(n, 1)).sum(), longest.max(initial=0), broken.sum()]))
            nt, gc, _, bad = np.sum(some, axis=0)
            yield pa.record_batch({"strands": pa.array([len(whole)]), "nucleotides": pa.array([int(nt)]), "gc": pa.array([float(gc)]), "max_run": pa.array([int(max(x[2] for x in some))], pa.int32()), "violating": pa.array([int(bad)])})

    per = strands.select("seq").mapInArrow(run, "strands long, nucleotides long, gc double, max_run int, violating long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(total("strands"), total("nucleotides"), F.try_divide(F.sum("gc"), F.sum("strands")).alias("avg_gc"), F.max("max_run").alias("max_run"), total("violating"))


def violation_rows(strands: DataFrame, limits: Limits = LIMITS["default"], keep: tuple[str, ...] = ("strand_id",)) -> DataFrame:
    """A row for each violation, with the ``keep`` columns of its strand; ``strands`` has seq."""
    return strands.select(*keep, F.explode(violations(F.col("seq"), limits)).alias("v")).select(*keep, "v.*")


def screening(strands: DataFrame, limits: Limits = LIMITS["default"], key: str = "file_id") -> DataFrame:
    """Per file of encoded strands: strands, how many are valid, and whether all are.

    A codec whose strands a payload alone determines has nothing to try instead,
    so its strict use is to encode and refuse files that aren't clean.
    """
    per = strands.groupBy(key).agg(F.count(F.lit(1)).alias("strands"), F.count_if(F.coalesce(is_valid(F.col("seq"), limits), F.lit(False))).alias("valid"))
    return per.withColumn("clean", F.col("valid") == F.col("strands"))
