"""The pool: files as strands, a versioned catalog, and what can be said about them.

``catalog`` rows describe versions of files, ``strands`` rows hold their bases.
Writing is a map from payloads to both; versions, listing, deletion and
migration are joins and windows on the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, dna
from ..sources.tables import spread_by, written
from . import codecs, consensus, noise, reedsolomon
from . import parity as stripes

PARITY = 4


def catalog(files: DataFrame, codec: str = "ternary", parity: int = PARITY, profile: str = "illumina") -> DataFrame:
    """A row for each file of ``files`` (file_id, filename, payload, created_at as epoch seconds)."""
    n = F.octet_length("payload").cast("long")
    hashed = bits.content_hash(F.col("payload"))
    base = files.select("file_id", "filename", "created_at", n.alias("size"), hashed.alias("content_hash"), F.lit(codec).alias("codec"), F.lit(profile).alias("profile"), F.lit(parity).alias("redundancy"))
    counted = base.withColumn("data_strands", strand_count(F.col("size"), codec))
    stripes = F.ceil(F.col("data_strands") / max(1, reedsolomon.BLOCK - parity)).cast("long")
    counted = counted.withColumn("parity_strands", stripes * parity)
    return counted.withColumn("archive_id", bits.archive_id(F.col("filename"), F.col("content_hash"), F.col("codec"), F.col("profile"), F.col("created_at")))


def strand_count(size: Column, codec: str) -> Column:
    """Data strands of a payload of ``size`` bytes, by closed form; none for an empty one."""
    return F.when(size > 0, codecs.CODECS[codec].count(size)).otherwise(0).cast("long")


def nucleotides() -> Column:
    """Bases of a catalog row's strands, by closed form.

    A parity strand has four bases for each of the longest strand of its stripe;
    of the two-rule codec the last strand is shorter, which counts where it is
    alone in its stripe.
    """
    two_rule, n = F.col("codec") == "yinyang", F.col("data_strands")
    bases = 4 * (F.col("size") + 4)
    data = F.when(two_rule & (F.col("size") > 0), bases + codecs.HEAD * n).otherwise((codecs.INDEX + codecs.SEGMENT) * n)
    alone = two_rule & (n > 0) & ((n - 1) % F.greatest(F.lit(1), F.lit(reedsolomon.BLOCK) - F.col("redundancy")) == 0)
    lacking = F.when(alone, (codecs.CHUNK * n - bases) * F.col("redundancy")).otherwise(0)
    width = F.when(two_rule, codecs.HEAD + codecs.CHUNK).otherwise(codecs.INDEX + codecs.SEGMENT)
    return data + 4 * (width * F.col("parity_strands") - lacking)


def strands(files: DataFrame, codec: str = "ternary", parity: int = PARITY, sized: bool = False) -> DataFrame:
    """Data and parity strands of ``files`` (file_id, payload): file_id, stripe, source_index, is_parity, seq; if ``sized``, with the data_strands of the stripe."""
    some = files.where(F.octet_length("payload") > 0).select("file_id", "payload")
    if parity:
        return stripes.encoded(some, codec, parity, sized)
    if not sized:
        return stripes.add_parity(codecs.CODECS[codec].encode(some), parity)
    made = codecs.CODECS[codec].encode(some.withColumn("_all", strand_count(F.octet_length("payload").cast("long"), codec)))
    at = reedsolomon.stripe(F.col("strand_index"), parity)
    here = F.least(F.lit(reedsolomon.BLOCK), F.col("_all") - at * reedsolomon.BLOCK).cast("int")
    return made.select("file_id", at.alias("stripe"), (F.col("strand_index") % reedsolomon.BLOCK).cast("int").alias("source_index"), F.lit(False).alias("is_parity"), "seq", here.alias("data_strands"))


def tagged_size(data: Column, parity: Column) -> Column:
    """Nucleotides of strands with their primers."""
    return data + parity + 2 * dna.PRIMER_LENGTH


def _ratios(rolled: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return rolled.withColumns({"redundancy": ratio(F.col("strands"), F.col("data_strands")), "avg_length": ratio(F.col("nucleotides"), F.col("strands"))})


def stat(strands: DataFrame) -> DataFrame:
    """Per file and for the pool (file_id null): strands, data, parity, nucleotides, redundancy, mean length; of strands as they are."""
    rolled = strands.rollup("file_id").agg(
        F.grouping("file_id").alias("is_total"), F.count(F.lit(1)).alias("strands"), F.count_if(~F.col("is_parity")).alias("data_strands"), F.count_if("is_parity").alias("parity_strands"),
        F.coalesce(F.sum(F.length("seq")), F.lit(0)).cast("long").alias("nucleotides"),
    )
    return _ratios(rolled)


def planned_stat(catalog: DataFrame) -> DataFrame:
    """What ``stat`` says of the strands that a catalog's files have when none is lost, by closed form: no strand is made or read."""
    each = catalog.where("size > 0").select("file_id", "data_strands", "parity_strands", nucleotides().alias("nucleotides"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("data_strands", "parity_strands", "nucleotides")]
    rolled = each.rollup("file_id").agg(F.grouping("file_id").alias("is_total"), F.coalesce(F.sum(F.col("data_strands") + F.col("parity_strands")), F.lit(0)).cast("long").alias("strands"), *sums)
    return _ratios(rolled)


def layouts(files: DataFrame, names: tuple[str, ...] = tuple(codecs.CODECS)) -> DataFrame:
    """A row for each codec: strands, nucleotides and bits_per_nt that all of ``files`` (payload) take under it, by closed form in one scan."""
    sized = files.select(F.octet_length("payload").cast("long").alias("size")).where("size > 0")
    counts = F.array(*(F.struct(F.lit(k).alias("codec"), strand_count(F.col("size"), k).alias("data_strands")) for k in names))
    each = sized.select("size", F.explode(counts).alias("c")).select("size", "c.*", F.lit(0).cast("long").alias("parity_strands"), F.lit(0).alias("redundancy"))
    summed = each.withColumn("nucleotides", nucleotides()).groupBy("codec").agg(F.sum("data_strands").alias("strands"), F.sum("nucleotides").alias("nucleotides"), F.sum("size").alias("size"))
    return summed.select("codec", "strands", "nucleotides", (8 * F.col("size") / F.col("nucleotides")).alias("bits_per_nt"))


def versions(files: DataFrame, order: list[str]) -> DataFrame:
    """``files`` with version (1 is the oldest of its filename) and is_current."""
    each = Window.partitionBy("filename")
    numbered = files.withColumn("version", F.row_number().over(each.orderBy(*order)))
    return numbered.withColumn("is_current", F.col("version") == F.max("version").over(each))


def listed(files: DataFrame, prefix: str = "") -> DataFrame:
    """Current versions whose name starts with ``prefix``."""
    return files.where(F.col("is_current") & F.col("filename").startswith(prefix))


def delete(files: DataFrame, names: DataFrame) -> DataFrame:
    """The catalog without all versions of the named files."""
    return files.join(names.select("filename").distinct(), "filename", "left_anti")


def migrate(files: DataFrame, names: DataFrame, codec: str, parity: int) -> DataFrame:
    """The catalog after the named files moved to another codec: their newest version is version 1, the old manifests are its history."""
    named = names.select("filename").distinct()
    moved = files.join(named, "filename", "left_semi").groupBy("filename").agg(
        F.max_by(F.struct("file_id", "size"), "version").alias("newest"), F.sort_array(F.collect_list(F.struct("version", "codec", "redundancy"))).alias("history")
    )
    fresh = moved.select("filename", "newest.file_id", "newest.size", F.lit(1).alias("version"), F.lit(codec).alias("codec"), F.lit(parity).alias("redundancy"), F.size("history").alias("history"))
    stays = files.join(named, "filename", "left_anti").select("filename", "file_id", "size", "version", "codec", "redundancy", F.lit(0).alias("history"))
    return stays.unionByName(fresh)


def recommended_redundancy(profile: Column, coverage: Column) -> Column:
    """Parity strands a stripe should have on a device at a coverage."""
    deep = coverage >= 10
    return F.when(profile == "twist", 2).when(profile == "illumina", F.when(deep, 3).otherwise(4)).when(profile == "nanopore", F.when(deep, 6).otherwise(8))


def voted_error(rate: Column, coverage: Column) -> Column:
    """Error rate that is left after a vote over ``coverage`` reads."""
    return F.when(coverage > 1, rate / (coverage * coverage)).otherwise(rate)


def sequenced(strands: DataFrame, synthesis: str, sequencing: str, coverage: int, seed: int, spread: bool = True) -> DataFrame:
    """Whole reads of the strands after the channel, without qualities; parity strands have noise of their own.

    Without ``spread`` strands are read where they are, in as many tasks as they come in.
    """
    named = strands.withColumn("strand_id", F.xxhash64("file_id", "stripe", "source_index"))
    named = spread_by(named, "strand_id") if spread else named
    return noise.usable(noise.simulate(named, synthesis, sequencing, coverage, seed, quality="none"))


def recover(reads: DataFrame, shape: DataFrame, codec: str = "ternary", parity: int = PARITY) -> DataFrame:
    """Payloads from reads: consensus of each strand, parity over each stripe, codec, and the hash as the judge.

    ``reads`` has file_id, stripe, source_index, is_parity, seq; ``shape`` has
    file_id, data_strands, content_hash.  Gives file_id, payload, status (``ok``,
    or what failed first), rounds (of retries after which it was ok, or that were
    tried), mended (strands that parity gave) and mean confidence.

    Files whose hash fails come back: stripes whose spare strands contradict the
    others leave out strands, the least confident first, until what is left
    agrees; see ``retried``.  What then still fails is searched for wrong bases
    place by place.
    """
    voted = consensus.by_group(reads, "file_id", "stripe", "source_index", "is_parity")
    spine = shape.select("file_id", F.col("data_strands").alias("_all"), "content_hash")
    width = max(1, reedsolomon.BLOCK - parity)
    in_stripe = F.least(F.lit(width), F.col("_all") - F.col("stripe") * width).cast("int")
    rows = voted.join(spine, "file_id").withColumn("data_strands", in_stripe).withColumn("parity", F.lit(parity))
    first = stripes.mend(rows, parity)
    tried = written(judged(first, spine, codec).withColumn("rounds", F.lit(0)), "tried")
    done = tried
    if parity:
        failed = tried.where("status not in ('ok', 'lost')").select("file_id")
        for n in range(1, parity + 1):
            if not failed.head(1):
                break
            again = written(judged(retried(rows.join(failed, "file_id", "left_semi"), parity, n), spine, codec, left=failed).withColumn("rounds", F.lit(n)), "tried")
            done, failed = replaced(done, again.where("status = 'ok'")), again.where("status != 'ok'").select("file_id")
        if failed.head(1):
            left = rows.join(failed, "file_id", "left_semi").select("file_id", "stripe", "source_index", "is_parity", "seq", "data_strands")
            fixed = reedsolomon.recover(left, parity).select("file_id", F.floor(F.col("strand_index") / width).cast("int").alias("stripe"), "seq", (F.col("mended") > 0).alias("mended"))
            done = replaced(done, written(judged(fixed, spine, codec, left=failed).withColumn("rounds", F.lit(parity + 1)), "tried").where("status = 'ok'"))
    confidence = voted.groupBy("file_id").agg(F.avg("avg_confidence").alias("confidence"))
    return done.join(confidence, "file_id", "left")


def observed_errors(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Strands as they came and as they were recovered, place by place: keys, compared, mismatches, error_rate, places (0-based, of the mismatches).

    Both have the ``keys`` and seq.  A strand that only one side has isn't
    compared, nor is what lies behind the end of the shorter.
    """
    pairs = before.select(*keys, F.col("seq").alias("_before")).join(after.select(*keys, F.col("seq").alias("_after")), [*keys])
    n = F.least(F.length("_before"), F.length("_after"))
    differs = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.substring("_before", i + 1, F.lit(1)) != F.substring("_after", i + 1, F.lit(1)))
    places = F.when(F.col("_before") == F.col("_after"), F.array().cast("array<int>")).otherwise(differs)
    found = pairs.where(n > 0).select(*keys, n.alias("compared"), places.alias("places"))
    return found.select(*keys, "compared", F.size("places").alias("mismatches"), (F.size("places") / F.col("compared")).alias("error_rate"), "places")


def errors_by_place(observed: DataFrame) -> DataFrame:
    """Mismatches at each place of a strand that has any: place, mismatches."""
    return observed.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("mismatches"))


def bytes_per_strand(size: Column, data_strands: Column) -> Column:
    """Payload bytes that a data strand holds; 0 without strands."""
    return F.coalesce(size / F.nullif(data_strands, F.lit(0)), F.lit(0.0))


def replaced(rows: DataFrame, newer: DataFrame) -> DataFrame:
    """``rows`` with the files of ``newer`` as they are there."""
    return rows.join(newer.select("file_id"), "file_id", "left_anti").unionByName(newer)


def judged(data: DataFrame, spine: DataFrame, codec: str, left: DataFrame | None = None) -> DataFrame:
    """Each file of ``spine`` (of those in ``left``, if it is given) decoded from its data strands: file_id, payload, status, mended."""
    if left is not None:
        spine = spine.join(left, "file_id", "left_semi")
    decoded = codecs.decode(data, codec)
    mended = data.groupBy("file_id").agg(F.count_if("mended").alias("mended"))
    right = bits.content_hash(F.col("payload")) == F.col("content_hash")
    status = F.when(F.col("status").isNull(), "lost").when(F.col("status") != "ok", F.col("status")).when(right, "ok").otherwise("hash")
    out = spine.join(decoded, "file_id", "left").join(mended, "file_id", "left")
    return out.select("file_id", F.when(right, F.col("payload")).alias("payload"), status.alias("status"), F.coalesce("mended", F.lit(0)).alias("mended"))


def retried(rows: DataFrame, parity: int, n: int) -> DataFrame:
    """Data strands of failed files after round ``n``: file_id, seq, mended.

    A stripe whose spare strands agree with the others stays.  In any other, the
    n - 1 least confident strands and one more are left out, whichever it is;
    of the choices that leave the rest in agreement that with the least
    confident one more counts.  Where no strand would be left to agree, only the
    n least confident ones are left out.
    """
    key = ["file_id", "stripe"]
    kept = [*key, "source_index", "is_parity", "seq", "data_strands", "parity"]
    rows = rows.where(F.length("seq") > 0)
    # a stripe has at most 256 strands
    order = Window.partitionBy(*key).orderBy(F.desc("contested"), "min_confidence", "source_index")
    ranked = written(rows.select(*kept, F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy(*key)).alias("present")), "ranked")
    fine = written(stripes.checked(ranked, parity), "checked")
    wrong = fine.where("not consistent").select(*key)
    bad = ranked.join(wrong, key, "left_semi")
    spare = F.col("present") - F.col("data_strands")
    choices = F.when(spare > n, F.sequence(F.lit(n), F.col("present").cast("int"))).when(spare == n, F.array(F.lit(n))).otherwise(F.array().cast("array<int>"))
    trials = bad.select(*kept, "rank", F.explode(choices).alias("choice")).where((F.col("rank") >= n) & (F.col("rank") != F.col("choice")))
    named = trials.withColumn("file_id", F.struct("file_id", "choice"))
    good = stripes.checked(named, parity).where("consistent").select("file_id.file_id", "stripe", "file_id.choice", "values")
    best = written(good.groupBy(*key).agg(F.min_by("values", "choice").alias("values"), F.min("choice").alias("choice")), "best")
    # strands that were left out come from parity, the others as they are
    chosen = ranked.join(best.select(*key, "choice"), key, "left").where("not is_parity and (choice is null or (rank >= %d and rank != choice))" % n)
    given = fine.where("consistent").select(*key, "values").unionByName(best.select(*key, "values"))
    given = given.select("file_id", F.explode("values").alias("value")).select("file_id", "value.seq", F.lit(True).alias("mended")).where("seq is not null")
    return chosen.select("file_id", "seq", F.lit(False).alias("mended")).unionByName(given)
