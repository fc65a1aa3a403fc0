"""Parity of stripes as joins and XOR sums: encoding and erasure recovery without grouped Python.

A stripe's strands are values of a polynomial over GF(256) at the points 0, 1,
...: the data strands' bases at the first k, four bases of a parity strand a
symbol at the next.  A value at a missing point is the sum of the known ones,
each times a coefficient that depends on the points alone.  An Arrow function
multiplies the strands of a batch and sums up those of one stripe, so what
leaves a task is one sum for each wanted point and stripe, not strands; Spark
brings the sums of a stripe together, 256 at most, and they are XORed.
Encoding is the case in which the parity points are the missing ones.

Coefficients come from one sum of logarithms for each number of points and the
few points that are left out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dna
from ..sources.tables import written
from .codecs import BASES, CODE, CODECS, ascii_bytes, binaries, bounded, grouped, strings, together
from .reedsolomon import BLOCK, EXP, LOG, MUL, stripe

#: For n points: at each, the summed logarithms of its differences to the others (modulo 255).
_i = np.arange(BLOCK)
SUMS = (np.cumsum(np.where(_i[:, None] == _i[None, :], 0, LOG[_i[:, None] ^ _i[None, :]]), axis=1) % 255).T
#: Symbols that are multiplied at once, and stripes, at most, whose names are broadcast.
SYMBOLS, FEW = 4 << 20, 100_000
MADE = pa.field("made", pa.struct([("source_index", pa.int32()), ("seq", pa.string())]))
DIGITS = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), dtype=np.uint8).reshape(256, 2)
PACKED = BASES[(_i[:, None] >> np.array([6, 4, 2, 0])) & 3]


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a column of lists, as long as the longest, and where there is something."""
    size = np.diff(lists.offsets.to_numpy())
    there = np.arange(size.max(initial=0)) < size[:, None]
    out = np.zeros(there.shape, dtype=np.int64)
    out[there] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, there


def coefficients(n: np.ndarray, point: np.ndarray, excluded: pa.Array, targets: pa.Array, wanted: int) -> np.ndarray:
    """What each row's strand is multiplied by for each of its targets; 0 for those that it doesn't have."""
    return weights(n, point, *matrix(excluded), *matrix(targets), wanted)


def weights(n: np.ndarray, point: np.ndarray, left: np.ndarray, some: np.ndarray, target: np.ndarray, asked: np.ndarray, wanted: int) -> np.ndarray:
    """``coefficients`` of rows of excluded points and of targets, with where there are any."""
    own = np.where(some, LOG[point[:, None] ^ left], 0).sum(axis=1) - SUMS[n - 1, point]
    out = np.zeros((wanted, len(n)), dtype=np.uint8)
    for j in range(min(wanted, target.shape[1])):
        y = target[:, j]
        others = np.where(some & (left != y[:, None]), LOG[y[:, None] ^ left], 0).sum(axis=1)
        logs = SUMS[n - 1, y] - others - LOG[y ^ point] + own
        out[j] = np.where(asked[:, j], EXP[logs % 255], 0)
    return out


def symbols_of(seq: pa.Array, is_parity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the symbols of strands, zero-padded, and how many each has.  What isn't a base reads as code 0."""
    data, bounds = ascii_bytes(seq)
    size = np.diff(bounds)
    if not is_parity.any() and len(size) and (size == size[0]).all():
        return (CODE[data] & 3).reshape(len(size), -1), size
    codes = np.zeros((len(seq), -(-int(size.max(initial=0)) // 4) * 4), dtype=np.uint8)
    codes[np.arange(codes.shape[1]) < size[:, None]] = CODE[data] & 3
    if is_parity.any():
        four = codes[is_parity].reshape(int(is_parity.sum()), -1, 4)
        joined = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
        size = np.where(is_parity, size // 4, size)
        codes[is_parity] = 0
        codes[is_parity, : joined.shape[1]] = np.where(np.arange(joined.shape[1]) < size[is_parity, None], joined, 0)
    return codes[:, : int(size.max(initial=0))], size


def multiplied(symbols: np.ndarray, by: np.ndarray, is_parity: np.ndarray) -> np.ndarray:
    """Rows of symbols, each times its number; a data strand's symbols are two bits."""
    if is_parity.all():
        return MUL[by[:, None], symbols]
    out = (symbols & 1) * by[:, None] ^ (symbols >> 1) * MUL[2, by][:, None]
    if is_parity.any():
        out[is_parity] = MUL[by[is_parity, None], symbols[is_parity]]
    return out


def partial_sums(rows: DataFrame, wanted: int) -> DataFrame:
    """Sums of the strands of each stripe that a batch holds: file_id, stripe, n, width, sums (those of the targets one after the other)."""

    def run(batches):
        for whole in batches:
            longest = max(pc.max(pc.binary_length(whole["seq"])).as_py() or 1, 1) if len(whole) else 1
            step = max(1, SYMBOLS // longest)
            for i in range(0, len(whole), step):
                batch = whole.slice(i, step)
                stripes = together(grouped(batch["file_id"]), batch["stripe"].to_numpy())
                order = np.argsort(stripes, kind="stable")
                batch = batch.take(pa.array(order))
                begin = np.flatnonzero(np.diff(stripes[order], prepend=-1))
                is_parity = batch["is_parity"].to_numpy(zero_copy_only=False).astype(bool)
                symbols, size = symbols_of(batch["seq"], is_parity)
                width = np.maximum.reduceat(size, begin)
                by = coefficients(batch["n"].to_numpy(), batch["point"].to_numpy(), batch["excluded"], batch["targets"], wanted)
                sums = np.stack([np.bitwise_xor.reduceat(multiplied(symbols, c, is_parity), begin, axis=0) for c in by], axis=1)
                held = np.broadcast_to(np.arange(symbols.shape[1]) < width[:, None, None], sums.shape)
                at = pa.array(begin)
                yield pa.record_batch({"file_id": batch["file_id"].take(at), "stripe": batch["stripe"].take(at), "n": batch["n"].take(at), "width": pa.array(width.astype(np.int32)), "sums": binaries(sums[held], bounded(width * wanted))})

    shape = T.StructType([rows.schema["file_id"], *T.StructType.fromDDL("stripe int, n int, width int, sums binary")])
    ours = rows.select("file_id", F.col("stripe").cast("int").alias("stripe"), F.col("n").cast("int").alias("n"), F.col("point").cast("int").alias("point"), "is_parity", "seq", "excluded", "targets")
    return ours.mapInArrow(run, shape)


def met(parts: list[dict], wanted: int) -> bytes:
    """The sum of a stripe's sums, of the greatest width."""
    width = max(p["width"] for p in parts)
    out = np.zeros((wanted, width), dtype=np.uint8)
    for p in parts:
        out[:, : p["width"]] ^= np.frombuffer(p["sums"], dtype=np.uint8).reshape(wanted, -1)
    return out.tobytes()


def filled(rows: DataFrame, wanted: int, packed: bool = False) -> DataFrame:
    """What stands at points that are left out, from the others: file_id, stripe, n, symbols (of each target, as hex, or as bases if ``packed``).

    ``rows`` has file_id, stripe, n (points of the stripe), point, is_parity,
    seq, excluded (the points left out, so that the others are as many as data
    strands), targets (those of them that are wanted, at most ``wanted``).
    """
    sums = partial_sums(rows.where(~F.array_contains("excluded", F.col("point"))), wanted)
    # a stripe has at most 256 strands, so at most as many sums
    joined = sums.groupBy("file_id", "stripe").agg(F.max("n").alias("n"), F.collect_list(F.struct("width", "sums")).alias("parts"))
    texts = PACKED if packed else DIGITS

    def run(batches):
        for batch in batches:
            parts, count = batch["parts"], np.diff(batch["parts"].offsets.to_numpy())
            flat = parts.flatten()
            data, width = flat.field("sums"), flat.field("width").to_numpy()
            if (count != 1).any():
                whole = [x[0]["sums"] if len(x) == 1 else met(x, wanted) for x in parts.to_pylist()]
                data, width = pa.array(whole, pa.binary()), np.array([len(x) // wanted for x in whole], dtype=np.int64)
            raw = np.frombuffer(b"".join(data.to_pylist()), dtype=np.uint8)
            made = strings(texts[raw].ravel(), bounded(np.repeat(width.astype(np.int64) * texts.shape[1], wanted)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * wanted), made)
            yield pa.record_batch({"file_id": batch["file_id"], "stripe": batch["stripe"], "n": batch["n"], "symbols": lists})

    return joined.mapInArrow(run, T.StructType([rows.schema["file_id"], *T.StructType.fromDDL("stripe int, n int, symbols array<string>")]))


def targeted(rows: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """What stands at the targets of harmed stripes: the columns of ``plan``, source_index, symbols."""
    key = ["file_id", "stripe"]
    made = filled(rows.join(plan.select(*key, "n", "excluded", "targets"), key).withColumnRenamed("source_index", "point"), most).drop("n").join(plan, key)
    pairs = F.arrays_zip(F.col("targets"), F.slice("symbols", F.lit(1), F.size("targets")).alias("symbols"))
    return made.withColumn("made", F.explode(pairs)).select(*plan.columns, F.col("made.targets").alias("source_index"), F.col("made.symbols").alias("symbols"))


@lru_cache(maxsize=BLOCK)
def parity_coefficients(k: int, parity: int) -> np.ndarray:
    """What the strands of a stripe of ``k`` data strands are multiplied by for each parity strand."""
    points = pa.array([list(range(k, k + parity))] * k, pa.list_(pa.int32()))
    return coefficients(np.full(k, k + parity), np.arange(k), points, points, parity)


def encoded(files: DataFrame, codec: str, parity: int, sized: bool = False) -> DataFrame:
    """The strands of ``files`` (file_id, payload) and their parity strands, as ``add_parity`` gives them; if ``sized``, with the data_strands of their stripe.

    A codec makes whole stripes at once, so each is multiplied where it is made:
    a map, in which payloads become strands once and nothing is shuffled.
    """
    width = max(1, BLOCK - parity)
    make = CODECS[codec].maker(width)

    def run(batches):
        for batch in batches:
            for row, index, seq in make(batch["payload"]):
                file, stripes = batch["file_id"], index // width
                begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (stripes[1:] != stripes[:-1])]))
                k = np.diff(np.append(begin, len(index)))
                data = np.zeros(len(index), dtype=bool)
                symbols, size = symbols_of(seq, data)
                longest = np.maximum.reduceat(size, begin)
                by = np.concatenate([parity_coefficients(int(x), parity) for x in k], axis=1)
                sums = np.stack([np.bitwise_xor.reduceat(multiplied(symbols, c, data), begin, axis=0) for c in by], axis=1)
                held = np.broadcast_to(np.arange(symbols.shape[1]) < longest[:, None, None], sums.shape)
                bases = strings(PACKED[sums[held]].ravel(), bounded(np.repeat(4 * longest, parity)))
                # a stripe's strands leave together, so that they may be mended together
                point = (k[:, None] + np.arange(parity)).ravel()
                order = np.argsort(np.concatenate([np.repeat(np.arange(len(begin)), k), np.repeat(np.arange(len(begin)), parity)]), kind="stable")
                own = np.concatenate([np.arange(len(index)), np.repeat(begin, parity)])[order]
                place = np.concatenate([index % width, point])[order]
                is_parity = np.concatenate([data, np.ones(len(point), dtype=bool)])[order]
                both = pa.concat_arrays([seq, bases]).take(pa.array(order))
                made = [file.take(pa.array(row[own])), pa.array(stripes[own].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(is_parity), both, pa.array(np.repeat(k, k + parity).astype(np.int32))]
                yield pa.record_batch(made[: len(names)], names=names)

    shape = T.StructType([files.schema["file_id"], *T.StructType.fromDDL("stripe int, source_index int, is_parity boolean, seq string" + ", data_strands int" * sized)])
    names = shape.names
    return files.select("file_id", "payload").mapInArrow(run, shape)


def add_parity(strands: DataFrame, parity: int) -> DataFrame:
    """``strands`` (file_id, strand_index, seq, and data_strands of the file if it is known) and their parity strands: file_id, stripe, source_index, is_parity, seq.

    source_index counts a stripe's data strands, then its parity strands.
    """
    width = max(1, BLOCK - parity)
    at = stripe(F.col("strand_index"), parity)
    placed = strands.select("file_id", at.alias("stripe"), (F.col("strand_index") % width).cast("int").alias("source_index"), F.lit(False).alias("is_parity"), "seq")
    if not parity:
        return placed
    if "data_strands" not in strands.columns:
        strands = strands.join(strands.groupBy("file_id").agg(F.count(F.lit(1)).alias("data_strands")), "file_id")
    k = F.least(F.lit(width), F.col("data_strands") - at * width).cast("int")
    points = F.sequence(k, k + parity - 1)
    rows = strands.select("file_id", at.alias("stripe"), (k + parity).alias("n"), (F.col("strand_index") % width).cast("int").alias("point"), F.lit(False).alias("is_parity"), "seq", points.alias("excluded"), points.alias("targets"))
    made = filled(rows, parity, packed=True).select("file_id", "stripe", "n", F.posexplode("symbols").alias("at", "seq"))
    made = made.select("file_id", "stripe", (F.col("n") - parity + F.col("at")).alias("source_index"), F.lit(True).alias("is_parity"), "seq")
    return placed.unionByName(made)


def mend(strands: DataFrame, most: int) -> DataFrame:
    """The two tables of ``mended`` as one."""
    data, made = mended(strands, most)
    return data if made is None else data.unionByName(made)


def mended(strands: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Data strands that are there, and the lost ones from parity, none if no stripe lost any: file_id, stripe, source_index, seq, mended (whether it was lost).

    ``strands`` has file_id, stripe, source_index, is_parity, seq, data_strands
    (of the stripe) and parity (strands of the stripe, ``most`` at most); a seq
    that is null, empty or not there is lost.  Up to ``parity`` strands of a
    stripe may be lost; beyond that, those that are left come back alone.  A lost
    strand has the length of the longest that is left.

    Strands aren't shuffled.  A task mends what of a stripe it has together; what
    meets is a row for each of these parts, and a stripe that was one part is done.
    Those that tasks share, as stripes do that are out of order or lie where one
    task ends, are mended by sums that meet.
    """
    there = strands.where(F.length("seq") > 0).select("file_id", "stripe", "source_index", "is_parity", "seq", "data_strands", "parity")
    data = there.where(~F.col("is_parity")).select("file_id", "stripe", "source_index", "seq", F.lit(False).alias("mended"))
    if not most:
        return data, None
    key = ["file_id", "stripe"]
    bits = [F.bit_or(f"bits{j}").alias(f"bits{j}") for j in range(4)]
    met = stripe_parts(there, most).groupBy(*key).agg(F.count(F.lit(1)).alias("parts"), F.max("k").alias("k"), F.max("parity").alias("parity"), F.sum("rows").alias("rows"), F.any_value("made").alias("made"), *bits)
    state = written(met, "stripes")
    done = state.where("parts = 1 and size(made) > 0").select(*key, F.explode("made").alias("made"))
    made = done.select(*key, "made.source_index", "made.seq", F.lit(True).alias("mended")).where("seq is not null")
    k = F.col("k")
    shared = written(lacking(state.where("parts > 1")).where(F.exists("lost", lambda x: x < k)), "harmed")
    n, twice = shared.agg(F.count(F.lit(1)), F.bool_or("twice")).first()
    if n:
        plan = shared.select(*key, "n", F.concat("lost", "spare").alias("excluded"), F.filter("lost", lambda x: x < k).alias("targets"))
        few = shared.select(*key)
        rows = there.join(F.broadcast(few) if n <= FEW else few.hint("merge"), key, "left_semi")
        # strands that are there twice would cancel out
        rest = targeted(rows.dropDuplicates([*key, "source_index"]) if twice else rows, plan, most)
        rest = rest.select(*key, "source_index", data_strand(F.col("symbols")).alias("seq"), F.lit(True).alias("mended")).where("seq is not null")
        return data, made.unionByName(rest)
    return (data, made) if done.head(1) else (data, None)


def stripe_parts(there: DataFrame, most: int) -> DataFrame:
    """What of each stripe comes together: file_id, stripe, k, parity, rows, the points as bits0 to bits3, and made: the data strands that it lacks (source_index, seq, null if one is no base), where it has as many points as data strands at least."""

    def parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        where = together(grouped(batch["file_id"]), batch["stripe"].to_numpy())
        point = batch["source_index"].to_numpy().astype(np.int64)
        # by stripe and point, each point once
        order = np.lexsort((point, where))
        where, point = where[order], point[order]
        begin = np.flatnonzero(np.diff(where, prepend=-1))
        rows = np.diff(np.append(begin, len(where)))
        one = np.repeat(np.arange(len(begin)), rows)
        first = order[begin]
        k, parity = (batch[c].to_numpy().astype(np.int64)[first] for c in ("data_strands", "parity"))
        present = np.zeros((len(begin), BLOCK), dtype=bool)
        present[one, point] = True
        bits = np.packbits(present, axis=1, bitorder="little").view(np.int64)
        _i = np.arange(BLOCK)
        inside = _i < (k + parity)[:, None]
        target = ~present & (_i < k[:, None])
        harmed = target.any(axis=1) & ((present & inside).sum(axis=1) >= k)
        made, size = pa.array([], MADE.type), np.zeros(len(begin), dtype=np.int64)
        if harmed.any():
            # the first k points that are there are used, the others left out
            used = present & inside & (np.cumsum(present & inside, axis=1) <= k[:, None])
            fresh = np.concatenate([[True], (one[1:] != one[:-1]) | (point[1:] != point[:-1])])
            mine = np.flatnonzero(harmed[one] & fresh & used[one, point])
            left, some = columns(inside & ~used)
            asked, wanted = columns(target & harmed[:, None])
            strands = batch.take(pa.array(order[mine]))
            stripes, at = one[mine], point[mine]
            is_parity = strands["is_parity"].to_numpy(zero_copy_only=False).astype(bool)
            symbols, length = symbols_of(strands["seq"], is_parity)
            start = np.flatnonzero(np.diff(stripes, prepend=-1))
            width = np.maximum.reduceat(length, start)
            by = weights((k + parity)[stripes], at, left[stripes], some[stripes], asked[stripes], wanted[stripes], asked.shape[1])
            sums = np.stack([np.bitwise_xor.reduceat(multiplied(symbols, c, is_parity), start, axis=0) for c in by], axis=1)
            which = stripes[start]
            size[which] = wanted[which].sum(axis=1)
            values, long = sums[wanted[which]], np.repeat(width, size[which])
            held = np.arange(values.shape[1]) < long[:, None]
            seq = strings(BASES[values & 3][held], bounded(long))
            wrong = ((values > 3) & held).any(axis=1) | (long == 0)
            seq = pc.if_else(pa.array(wrong), pa.scalar(None, pa.string()), seq)
            made = pa.StructArray.from_arrays([pa.array(asked[which][wanted[which]].astype(np.int32)), seq], fields=list(MADE.type))
        at = pa.array(first)
        lists = pa.ListArray.from_arrays(pa.array(bounded(size).astype(np.int32)), made)
        whole = [pa.array(np.ascontiguousarray(bits[:, j])) for j in range(4)]
        return pa.record_batch([batch["file_id"].take(at), batch["stripe"].take(at), pa.array(k.astype(np.int32)), pa.array(parity.astype(np.int32)), pa.array(rows.astype(np.int32)), *whole, lists], names=shape.names)

    def run(batches):
        kept = None
        for whole in batches:
            batch = whole if kept is None else pa.concat_batches([kept, whole])
            # the last stripe of a batch may go on in the next
            last = together(grouped(batch["file_id"]), batch["stripe"].to_numpy()) if len(batch) else np.zeros(0)
            end = int(np.flatnonzero(last != last[-1])[-1]) + 1 if len(last) and (last != last[-1]).any() else 0
            if not end and len(batch) > 2 * BLOCK:
                end = len(batch)
            longest = max(pc.max(pc.binary_length(batch["seq"])).as_py() or 1, 1) if len(batch) else 1
            step = max(BLOCK, SYMBOLS // longest)
            i = 0
            while i < end:
                # stripes that follow one another, whole where they aren't longer than a step
                j = min(end, i + step)
                if j < end and last[j] == last[j - 1]:
                    back = np.flatnonzero(last[i:j] != last[j])
                    j = i + int(back[-1]) + 1 if len(back) else j
                yield parts(batch.slice(i, j - i))
                i = j
            kept = batch.slice(end) if end < len(batch) else None
        if kept is not None:
            yield parts(kept)

    shape = T.StructType([there.schema["file_id"], *T.StructType.fromDDL("stripe int, k int, parity int, rows int, bits0 long, bits1 long, bits2 long, bits3 long, made array<struct<source_index:int,seq:string>>")])
    ours = there.select("file_id", F.col("stripe").cast("int").alias("stripe"), F.col("source_index").cast("int").alias("source_index"), "is_parity", "seq", F.col("data_strands").cast("int").alias("data_strands"), F.col("parity").cast("int").alias("parity"))
    return ours.where(F.col("source_index").between(0, BLOCK - 1)).mapInArrow(run, shape)


def columns(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the numbers of the columns that are set, and where there are any."""
    n = flags.sum(axis=1)
    there = np.arange(n.max(initial=0)) < n[:, None]
    out = np.zeros(there.shape, dtype=np.int64)
    out[there] = np.nonzero(flags)[1]
    return out, there


def losses(there: DataFrame) -> DataFrame:
    """Of stripes that have as many strands as data strands at least: file_id, stripe, k, n, lost (points that aren't there), spare (points beyond k that are), twice (whether a point is there twice)."""
    # the points as bits of four numbers, which are summed up by hash without sets
    bits = [F.coalesce(F.bit_or(F.expr(f"CASE WHEN shiftright(source_index, 6) = {j} THEN shiftleft(1L, source_index) END")), F.lit(0)).alias(f"bits{j}") for j in range(4)]
    state = there.withColumn("source_index", F.col("source_index").cast("int")).groupBy("file_id", "stripe").agg(F.max("data_strands").alias("k"), F.max("parity").alias("parity"), F.count(F.lit(1)).alias("rows"), *bits)
    return lacking(state)


def lacking(state: DataFrame) -> DataFrame:
    """``losses`` from stripes' points as bits."""
    state = state.withColumn("n", (F.col("k") + F.col("parity")).cast("int"))
    state = state.withColumn("points", F.expr("filter(sequence(0, n - 1), i -> getbit(element_at(array(bits0, bits1, bits2, bits3), shiftright(i, 6) + 1), i & 63) = 1)")).drop("bits0", "bits1", "bits2", "bits3")
    state = state.withColumn("twice", F.col("rows") > F.size("points")).drop("rows").where("size(points) >= k")
    state = state.withColumn("lost", F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "points"))
    return state.withColumn("spare", F.slice(F.sort_array("points", asc=False), F.lit(1), F.col("parity") - F.size("lost")))


def data_strand(symbols: Column) -> Column:
    """The bases of hex symbols; null if one is no base."""
    return F.when(symbols.rlike("^(0[0-3])+$"), F.translate(F.regexp_replace(symbols, "0(.)", "$1"), "0123", "ATGC"))


def strand_symbols(seq: Column, is_parity: Column) -> Column:
    """Hex of a strand's symbols: two digits a base of a data strand, four bases of a parity strand."""
    return F.when(is_parity, F.lower(F.hex(dna.unpack(seq)))).otherwise(F.regexp_replace(F.translate(seq, "ATGC", "0123"), "(.)", "0$1"))


def checked(strands: DataFrame, most: int) -> DataFrame:
    """Whether the strands that a stripe could do without agree with the others: file_id, stripe, consistent, values.

    ``strands`` is as for ``mend``, without the strands that are to be left out;
    ``values`` are the data strands that aren't there, as (source_index, seq).
    A stripe that has none to spare isn't contradicted, and one with too few
    strands has no row.
    """
    key = ["file_id", "stripe"]
    there = strands.where(F.length("seq") > 0).select(*key, "source_index", "is_parity", "seq", "data_strands", "parity")
    plan = losses(there).select(*key, "k", "n", F.concat("lost", "spare").alias("excluded")).withColumn("targets", F.col("excluded"))
    made = targeted(there, plan, most).select(*key, "k", "source_index", "symbols")
    actual = there.select(*key, "source_index", strand_symbols(F.col("seq"), F.col("is_parity")).alias("actual"))
    met = made.join(actual, [*key, "source_index"], "left")
    # the last data strand may be shorter than its zero-padded value
    right = F.col("symbols").startswith(F.col("actual")) & (F.translate(F.expr("substring(symbols, length(actual) + 1)"), "0", "") == "")
    value = F.when(F.col("actual").isNull() & (F.col("source_index") < F.col("k")), F.struct("source_index", data_strand(F.col("symbols")).alias("seq")))
    return met.groupBy(*key).agg(F.coalesce(F.bool_and(right), F.lit(True)).alias("consistent"), F.collect_list(value).alias("values"))
