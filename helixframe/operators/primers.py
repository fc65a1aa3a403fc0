"""Primer pairs: making a library, tagging strands, and finding which pair a read carries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, dna
from ..sources.tables import written
from . import constraints
from .running import running_total

#: Pairs in the first range that is tried.
FIRST_RANGE = 3_000
SCHEMA = "ordinal int, primer_id string, fwd string, rev string"


def plausible(primer: Column) -> Column:
    """What the primer preset of the constraints allows: GC share, runs, no palindrome."""
    return constraints.is_valid(primer, constraints.LIMITS["primer"])


def drawn(seed: Column) -> Column:
    """A primer of pseudo-random bases for each seed."""
    return F.substring(F.translate(F.md5(seed.cast("string")), "0123456789abcdef", "AAAATTTTGGGGCCCC"), 1, dna.PRIMER_LENGTH)


def candidates(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Pairs drawn for 0 .. n - 1: ordinal, fwd, rev."""
    name = lambda side: F.concat_ws(":", F.lit(seed), "id", F.lit(side))
    return spark.range(n).select(F.col("id").alias("ordinal"), drawn(name("fwd")).alias("fwd"), drawn(name("rev")).alias("rev"))


def coded(primer: Column) -> Column:
    """A primer's bases as a number, two bits a base; null for what isn't PRIMER_LENGTH bases."""
    return F.when(primer.rlike(f"^[ATGC]{{{dna.PRIMER_LENGTH}}}$"), F.conv(F.translate(primer, dna.BASES, "0123"), 4, 10).cast("long"))


def seeded(pairs: DataFrame, distance: int) -> DataFrame:
    """Each primer (ordinal, code, and primer where it has no code) with its seeds: numbers of which primers that differ in fewer than ``distance`` places share one.

    Cut into distance + 2 blocks, such primers agree in three whole blocks.
    """
    n, blocks = dna.PRIMER_LENGTH, distance + 2
    bounds = [n * i // blocks for i in range(blocks + 1)]
    every = pairs.select("ordinal", F.explode(F.array("fwd", "rev")).alias("primer")).withColumn("code", coded(F.col("primer")))
    mask = lambda c: sum(3 << 2 * (n - 1 - j) for i in c for j in range(bounds[i], bounds[i + 1]))
    # what isn't a base has seeds as if it were an A; only compared primers count, so that unlike ones may share a seed
    like = coded(F.rpad(F.regexp_replace("primer", f"[^{dna.BASES}]", "A"), n, "A"))
    masks = F.array(*(F.lit(mask(c)) for c in combinations(range(blocks), 3)))
    every = every.withColumn("like", like)
    seeds = F.transform(masks, lambda m, k: F.col("like").bitwiseAND(m) + F.shiftleft(k.cast("long"), 2 * n))
    # seeds are many, so a primer that has a code goes without its bases
    return every.select("ordinal", F.when(F.col("code").isNull(), F.col("primer")).alias("primer"), "code", F.explode(seeds).alias("seed"))


def decoded(code: Column) -> Column:
    """A primer's bases from its number."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), dna.PRIMER_LENGTH, "0"), "0123", dna.BASES)


def near(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """(first, second): ordinals of ``a`` and greater ones of ``b`` of which some primers differ in fewer than ``distance`` places."""
    ours = seeded(a, distance)
    # a primer has dozens of seeds, which Spark doesn't see in the table's size: never gather them at the driver for a broadcast
    other = seeded(b, distance).hint("merge").select("seed", F.col("ordinal").alias("second"), F.col("primer").alias("other"), F.col("code").alias("other_code"))
    whole = lambda bases, code: F.coalesce(F.col(bases), decoded(F.col(code)))
    apart = F.col("code").bitwiseXOR(F.col("other_code"))
    differ = F.bit_count(apart.bitwiseOR(F.shiftright(apart, 1)).bitwiseAND(F.lit(int("01" * dna.PRIMER_LENGTH, 2))))
    close = F.when(apart.isNotNull(), differ < distance).otherwise(dna.hamming(whole("primer", "code"), whole("other", "other_code")) < distance)
    met = ours.join(other, "seed").where(F.col("ordinal") < F.col("second")).where(close)
    return met.select(F.col("ordinal").alias("first"), "second").distinct()


def conflicts(pairs: DataFrame, distance: int = dna.PRIMER_DISTANCE) -> DataFrame:
    """Pairs of which some primers differ in fewer than ``distance`` places: first, second (ordinals, first < second)."""
    return near(pairs, pairs, distance)


def independent(pairs: DataFrame, distance: int = dna.PRIMER_DISTANCE) -> DataFrame:
    """The plausible pairs that trying them in order keeps, each against all kept before: ordinal, fwd, rev.

    Pairs come in ranges of their order, each twice as large as the one before.
    Those in conflict with a pair that is kept already go first, so that only
    what is left of a range is compared with itself: the kept pairs are few where
    conflicts are many.  An ordinal stands for one pair.
    """
    fit = written(pairs.where(plausible(F.col("fwd")) & plausible(F.col("rev"))).select("ordinal", "fwd", "rev"), "primers")
    n, shares = fit.count(), []
    while FIRST_RANGE * (2 ** (len(shares) + 1) - 1) < n:
        shares.append(FIRST_RANGE * (2 ** (len(shares) + 1) - 1) / n)
    # any bounds give the same pairs; these needn't be exact
    bounds = [None, *sorted(set(fit.approxQuantile("ordinal", shares, 0.01) if shares else [])), None]
    kept = None
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        some = fit if low is None else fit.where(F.col("ordinal") > int(low))
        some = some if high is None else some.where(F.col("ordinal") <= int(high))
        if kept is not None:
            lost = near(kept, some, distance).select(F.col("second").alias("ordinal")).distinct()
            some = written(some.join(lost, "ordinal", "left_anti"), "open")
        fresh = tried_in_order(some, distance)
        kept = written(fresh if kept is None else kept.unionByName(fresh), "kept")
    return kept


def tried_in_order(fit: DataFrame, distance: int) -> DataFrame:
    """The pairs that trying them in order keeps.

    In each round the pairs stay that no open pair before them is in conflict
    with, and those in conflict with one that stays go; a chain of conflicts is a
    round a link, and random pairs have few.
    """
    edges = written(conflicts(fit, distance), "conflicts")
    gone = None
    while edges.head(1):
        later = edges.select(F.col("second").alias("first")).distinct()
        stays = edges.select("first").distinct().join(later, "first", "left_anti")
        lost = written(edges.join(stays, "first", "left_semi").select(F.col("second").alias("ordinal")).distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        left = edges.join(lost.withColumnRenamed("ordinal", "second"), "second", "left_anti").join(lost.withColumnRenamed("ordinal", "first"), "first", "left_anti")
        edges = written(left.select("first", "second"), "conflicts")
    return fit if gone is None else fit.join(gone, "ordinal", "left_anti")


def library_table(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """The first n pairs, each plausible and at least 6 substitutions from every primer of every other: ordinal, primer_id, fwd, rev."""
    tried = 8 * n + 64
    while True:
        kept = written(independent(candidates(spark, tried, seed)), "library")
        if kept.count() >= n:
            break
        tried *= 2
    # ranged and counted: no task sees more than a range
    numbered = running_total(kept.withColumns({"one": F.lit(1).cast("long"), "all": F.lit(0)}), "one", ["ordinal"], ["all"], "rank")
    first = numbered.where(F.col("rank") <= n).select((F.col("rank") - 1).cast("int").alias("ordinal"), "fwd", "rev")
    return written(first.select("ordinal", F.format_string("P%04d", "ordinal").alias("primer_id"), "fwd", "rev"), "library")


def assigned(files: DataFrame, primers: DataFrame, order: list[str]) -> DataFrame:
    """``files`` with the next pair of the library each, in order, and null where it has none left."""
    ranked = running_total(files.withColumns({"_one": F.lit(1).cast("long"), "_all": F.lit(0)}), "_one", order, ["_all"], "_rank")
    pairs = primers.select((F.col("ordinal") + 1).cast("long").alias("_rank"), "primer_id", "fwd", "rev")
    return ranked.join(pairs, "_rank", "left").drop("_rank", "_one", "_all")


def tagged(strands: DataFrame, primers: DataFrame) -> DataFrame:
    """``strands`` (with primer_id and seq) between their primers; those whose primer isn't in the library go."""
    return strands.join(primers.select("primer_id", "fwd", "rev"), "primer_id").withColumn("seq", dna.tag(F.col("seq"), F.col("fwd"), F.col("rev"))).drop("fwd", "rev")


def untagged(reads: DataFrame, primers: DataFrame) -> DataFrame:
    """``reads`` (with primer_id and seq) without their primers; seq is null where they aren't found."""
    return reads.join(primers.select("primer_id", "fwd", "rev"), "primer_id").withColumn("seq", dna.untag(F.col("seq"), F.col("fwd"), F.col("rev"))).drop("fwd", "rev")


def identified(reads: DataFrame, primers: DataFrame) -> DataFrame:
    """``reads`` (with strand_id and seq) and the first pair in library order whose forward primer fits; else null.

    A pair can only fit if some piece of its forward primer stands in the read's
    head: with 4 edits spread over 5 pieces of 4 bases, one piece is untouched
    and has moved by 4 places at most.  Reads meet pairs by such a piece and its
    place, so no read is compared with the whole library.
    """
    size = dna.PRIMER_LENGTH // (dna.PRIMER_EDITS + 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(dna.PRIMER_EDITS)), lambda k: F.struct(k.alias("piece"), F.substring("fwd", k * size + 1, F.lit(size)).alias("bases")))
    posted = primers.select("ordinal", "primer_id", "fwd", F.explode(pieces).alias("key"))
    moves = F.sequence(F.lit(-dna.PRIMER_EDITS), F.lit(dna.PRIMER_EDITS))
    looks = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dna.PRIMER_EDITS)), lambda k: F.transform(F.filter(moves, lambda m: k * size + m >= 0), lambda m: F.struct(k.alias("piece"), F.substring("seq", k * size + m + 1, F.lit(size)).alias("bases")))))
    tried = reads.select("strand_id", "seq", F.explode(F.array_distinct(looks)).alias("key")).join(posted, "key")
    fits = tried.dropDuplicates(["strand_id", "ordinal"]).where(dna.primer_end(F.col("seq"), F.col("fwd")).isNotNull())
    first = fits.groupBy("strand_id").agg(F.min(F.struct("ordinal", "primer_id"))["primer_id"].alias("found"))
    return reads.join(first, "strand_id", "left")


def retrieved(strands: DataFrame, target: DataFrame, efficiency: float = 0.95, crosstalk: float = 0.01, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """Selective retrieval of one pair's strands: ``strands`` (strand_id, primer_id, fwd) with is_target and amplified.

    ``target`` is one row (primer_id, fwd).  Its own strands are amplified with
    ``efficiency``; others cross-talk with a rate that follows the likeness of
    their primer, a hundredth of it below the threshold.
    """
    one = target.select(F.col("primer_id").alias("target_id"), F.col("fwd").alias("target_fwd")).first()
    likeness = dna.similarity(F.col("fwd"), F.lit(one["target_fwd"]))
    hit = F.col("primer_id") == F.lit(one["target_id"])
    chance = F.when(hit, efficiency).otherwise(F.when(likeness > threshold, crosstalk * likeness).otherwise(crosstalk * 0.01))
    return strands.withColumn("is_target", hit).withColumn("amplified", bits.uniform(F.lit(seed), F.col("strand_id")) < chance)


def retrieval_quality(found: DataFrame) -> DataFrame:
    """Precision and recall of ``retrieved``; 1 where there is nothing to count."""
    got, good = F.count_if("amplified"), F.count_if(F.col("amplified") & F.col("is_target"))
    return found.agg(F.coalesce(good / F.nullif(got, F.lit(0)), F.lit(1.0)).alias("precision"), F.coalesce(good / F.nullif(F.count_if("is_target"), F.lit(0)), F.lit(1.0)).alias("recall"))
