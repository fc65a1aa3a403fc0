"""Payloads as fixed-size blocks, and devices that hold them by address and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bits import with_length
from ..sources.tables import written
from . import codecs, pool
from . import parity as stripes

SIZE = 512
#: Addresses, at most, that are broadcast.
FEW = 100_000


def to_blocks(files: DataFrame, size: int = SIZE) -> DataFrame:
    """(file_id, lba, block): the payload behind its length, in blocks of ``size`` bytes, the last filled with zeros."""
    digits = F.hex(with_length(F.col("payload")))
    n = F.ceil(F.length("digits") / (2 * size)).cast("int")
    cut = F.substring(F.col("digits"), F.col("lba") * (2 * size) + 1, F.lit(2 * size))
    rows = files.where("payload is not null").select("file_id", digits.alias("digits")).select("file_id", "digits", F.explode(F.sequence(F.lit(0), n - 1)).alias("lba"))
    return rows.select("file_id", "lba", F.unhex(F.rpad(cut, 2 * size, "0")).alias("block"))


def from_blocks(blocks: DataFrame) -> DataFrame:
    """(file_id, payload) from all blocks of each file; payload is null if the blocks are too few for the length."""
    gathered = blocks.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("lba", F.hex("block").alias("digits")))).alias("all"))
    whole = gathered.select("file_id", F.array_join("all.digits", "").alias("digits"))
    n = F.conv(F.substring("digits", 1, 8), 16, 10).cast("int")
    return whole.select("file_id", F.when(F.length("digits") >= 8 + 2 * n, F.unhex(F.substring(F.col("digits"), F.lit(9), 2 * n))).alias("payload"))


def rewritten(writes: DataFrame, order: list[str]) -> DataFrame:
    """A rewritable device after ``writes`` (lba and a payload): the newest write of each address, and its generation."""
    newest = F.max_by(F.struct(*[c for c in writes.columns if c != "lba"]), F.struct(*order))
    return writes.groupBy("lba").agg(newest.alias("held"), F.count(F.lit(1)).alias("generation")).select("lba", "generation", "held.*")


def write_once(writes: DataFrame, order: list[str]) -> DataFrame:
    """A write-once device: every write with status ``ok``, or ``already_written`` if an earlier one has its address."""
    first = writes.groupBy("lba").agg(F.min(F.struct(*order)).alias("_first"))
    return writes.join(first, "lba").withColumn("status", F.when(F.struct(*order) == F.col("_first"), "ok").otherwise("already_written")).drop("_first")


def stored(blocks: DataFrame, parity: int, codec: str = "ternary") -> DataFrame:
    """Blocks (lba, block) as strands with parity: lba, stripe, source_index, is_parity, seq, data_strands (of the stripe), parity."""
    files = blocks.select(F.col("lba").alias("file_id"), F.col("block").alias("payload"))
    made = pool.strands(files, codec, parity, sized=True)
    return made.select(F.col("file_id").alias("lba"), "stripe", "source_index", "is_parity", "seq", "data_strands", F.lit(parity).alias("parity"))


def read(strands: DataFrame, asked: DataFrame, capacity: int, parity: int, codec: str = "ternary") -> DataFrame:
    """Blocks at the asked addresses (lba), from the strands that are left of them: lba, block, status.

    The status is ``ok``, ``out_of_range`` for an address beyond the device,
    ``never_written`` for one that has no strands, or ``uncorrectable``.
    """
    wanted = written(asked.select("lba").distinct(), "asked")
    # few addresses pick strands; of many, blocks are opened where strands are, and picked, as they are a fraction of their strands
    held = strands.join(F.broadcast(wanted), "lba", "left_semi") if wanted.count() <= FEW else strands
    held = held.withColumnRenamed("lba", "file_id")
    found = codecs.decode(stripes.mend(held, parity), codec).withColumnRenamed("file_id", "lba")
    # a block whose strands are all harmed or parity has a row here and none above
    known = held.select(F.col("file_id").alias("lba")).distinct().withColumn("_written", F.lit(True))
    out = wanted.join(known, "lba", "left").join(found, "lba", "left")
    beyond = (F.col("lba") < 0) | (F.col("lba") >= capacity)
    status = F.when(beyond, "out_of_range").when(F.col("_written").isNull(), "never_written").when(F.col("status") == "ok", "ok").otherwise("uncorrectable")
    return out.select("lba", F.when(status == "ok", F.col("payload")).alias("block"), status.alias("status"))
