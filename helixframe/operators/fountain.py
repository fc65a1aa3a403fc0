"""Fountain (LT) codes: segments, droplets and peeling.

A payload behind its length is cut into segments; droplet number s is the xor of
a subset of them that s alone determines, so a strand needs only s as its
header.  Degrees and subsets come from a keyed hash.  Decoding peels: a droplet
of one unknown segment gives it, and goes out of all others.  The number of
segments is stored with a file, not guessed.

A payload's segments come in generations of at most 64, each with droplets of its
own, so that work and the share of droplets needed don't grow with the payload.
How many droplets a generation needs to peel depends on its number of segments
alone, and at least that many are made.

A preset with tries screens: droplet numbers are tried in order, and those whose
strand breaks a constraint are passed over.  As packed text and small numbers
never pass, a screened strand's header is a bijection of generation and number
that looks random, and its droplet is whitened by it.  Tries are bounded; where
they don't give enough droplets, that is told and what there is is kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dna
from .codecs import CODE, ascii_bytes, binaries, bounded, cut, grouped, length_bytes, strings
from .constraints import LIMITS, Limits
from .noise import draw
from .parity import PACKED


@dataclass(frozen=True)
class Preset:
    """Bytes in a segment, droplets made per segment, and shares of degree 1, 2, 3, sqrt(k) and the rest k/2.

    With ``tries``, strands keep to the named limits, and so many numbers are
    tried for each droplet on average before a generation is left short.  Of
    random strands of 80, 96 and 112 bases 1 in 180, 520 and 1900 keep to the
    default limits, so the presets leave even a single segment about ten times
    the tries that it needs.
    """

    segment: int = 16
    redundancy: float = 1.5
    degrees: tuple[float, ...] = (0.40, 0.30, 0.15, 0.10)
    tries: int = 0
    limits: str = "default"

    def wanted(self, k: int) -> int:
        """Droplets of k segments, before it is seen whether they peel."""
        return max(int(np.ceil(self.redundancy * k)), k + 1)


#: The presets; ``erasure`` is the erasure layer's own mix of degrees.
PRESETS = {
    "default": Preset(), "dense": Preset(20, 1.2), "resilient": Preset(12, 2.0), "erasure": Preset(16, 1.5, (0.35, 0.30, 0.20, 0.15)),
    "screened": Preset(tries=5000), "screened-dense": Preset(20, 1.2, tries=20_000), "screened-resilient": Preset(12, 2.0, tries=5000),
}
HEADER, GENERATION, FIRST = 32, 64, 42
#: Generations whose droplets are made at once.
AT_ONCE = 128
#: How many numbers are tried at once, and the odd factors of the bijection behind screened headers.
STEP, FACTORS = 2048, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def subsets(seeds: np.ndarray, k: int, preset: Preset) -> np.ndarray:
    """Which segments of a generation of k are in the droplets of some numbers: a row of k flags for each."""
    at = np.searchsorted(np.cumsum(preset.degrees), draw(seeds, 11), side="right")
    degree = np.minimum(k, np.array([1, 2, 3, max(1, int(np.sqrt(k))), max(1, k // 2)])[at])
    order = np.argsort(draw(seeds[:, None], 12, np.arange(k, dtype=np.uint64)), axis=1, kind="stable")
    return np.argsort(order, axis=1) < degree[:, None]


@lru_cache(maxsize=1 << 16)
def subset(seed: int, k: int, preset: Preset) -> np.ndarray:
    """The segments of a droplet of a generation of k, in order."""
    return np.flatnonzero(subsets(np.array([seed], dtype=np.uint64), k, preset)[0])


@lru_cache(maxsize=1024)
def needed(k: int, preset: Preset) -> int:
    """How many droplets are made of k segments: as the preset says, and enough to peel."""
    n = preset.wanted(k)
    while peel([(s, bytes(1)) for s in range(FIRST, FIRST + n)], k, preset) is None:
        n += 1
    return n


@lru_cache(maxsize=1 << 16)
def flags(seed: int, k: int, preset: Preset) -> int:
    """The segments of a droplet of a generation of k as the bits of a number."""
    return sum(1 << i for i in subset(seed, k, preset).tolist())


def peel(received: list[tuple[int, bytes]], k: int, preset: Preset) -> np.ndarray | None:
    """The k segments, or None if the droplets don't give all of them.

    Droplets and what is left of their segments are whole numbers, so that a step
    is one xor of each, however many bytes a droplet has.
    """
    size = len(received[0][1]) if received else 0
    left = [flags(s, k, preset) for s, _ in received]
    value = [int.from_bytes(b, "little") for _, b in received]
    holders: list[list[int]] = [[] for _ in range(k)]
    for d, bits in enumerate(left):
        while bits:
            low = bits & -bits
            holders[low.bit_length() - 1].append(d)
            bits ^= low
    known: dict[int, int] = {}
    ready = [d for d, bits in enumerate(left) if bits and not bits & (bits - 1)]
    while ready and len(known) < k:
        d = ready.pop()
        one, mine = left[d], value[d]
        if not one:
            continue
        i = one.bit_length() - 1
        known[i] = mine
        for d in holders[i]:
            if left[d] & one:
                left[d] ^= one
                value[d] ^= mine
                if left[d] and not left[d] & (left[d] - 1):
                    ready.append(d)
    if len(known) < k or not k:
        return None
    return np.frombuffer(b"".join(known[i].to_bytes(size, "little") for i in range(k)), dtype=np.uint8).reshape(k, size)


@lru_cache(maxsize=256)
def drops_of(k: int, preset: Preset) -> tuple[np.ndarray, np.ndarray]:
    """The droplets that are made of k segments: what they are the xor of, one after the other, and where each begins."""
    some = [subset(s, k, preset) for s in range(FIRST, FIRST + needed(k, preset))]
    return np.concatenate(some), np.cumsum([0] + [len(x) for x in some])[:-1]


def scattered(place: np.ndarray, back: bool = False) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers, or its inverse."""
    x = place ^ (place >> np.uint64(32))
    for f in (pow(c, -1, 1 << 64) for c in FACTORS[::-1]) if back else FACTORS:
        x = x * np.uint64(f)
        x ^= x >> np.uint64(32)
    return x


def whitening(keys: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes for each key."""
    return (draw(keys[:, None], 13, np.arange(width, dtype=np.uint64)) * 256).astype(np.uint8)


def base_codes(data: np.ndarray) -> np.ndarray:
    """The two-bit codes of rows of bytes."""
    return ((data[:, :, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3).reshape(len(data), -1)


def within(codes: np.ndarray, limits: Limits, part: bool = False) -> np.ndarray:
    """Which rows of base codes keep to the limits; of a ``part`` of a strand, whether a strand with it can."""
    n, span = codes.shape[1], limits.palindrome
    good = np.full(len(codes), part or limits.min_length <= n <= limits.max_length)

    def narrowed(broken) -> None:
        rows = np.flatnonzero(good)
        good[rows[broken(codes[rows])]] = False

    def long_run(c: np.ndarray) -> np.ndarray:
        same, m = c[:, 1:] == c[:, :-1], n - limits.max_run
        return np.logical_and.reduce([same[:, j : j + m] for j in range(limits.max_run)]).any(axis=1)

    def mirrored(c: np.ndarray) -> np.ndarray:
        m = n - span + 1
        return np.logical_and.reduce([c[:, j : j + m] == c[:, span - 1 - j : span - 1 - j + m] ^ 1 for j in range(span // 2)]).any(axis=1)

    def unbalanced(c: np.ndarray) -> np.ndarray:
        gc = np.pad(np.cumsum(c > 1, axis=1), ((0, 0), (1, 0)))
        shares = [(gc[:, width:] - gc[:, :-width]) / width for width in (limits.window, *(() if part else (n,))) if width <= n]
        return np.logical_or.reduce([((s < limits.min_gc) | (s > limits.max_gc)).any(axis=1) for s in shares])

    if n > limits.max_run:
        narrowed(long_run)
    if n >= span:
        narrowed(mirrored)
    if n >= limits.window or not part:
        narrowed(unbalanced)
    return good


@lru_cache(maxsize=512)
def headers(generation: int, first: int, how: Preset) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of STEP numbers from ``first`` on those whose header alone keeps to the limits: numbers, header bytes, whitening."""
    numbers = np.arange(first, first + STEP, dtype=np.uint64)
    keys = scattered(np.uint64(generation) << np.uint64(32) | numbers)
    head = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
    good = within(base_codes(head), LIMITS[how.limits], part=True)
    return numbers[good], head[good], whitening(keys[good], how.segment)


@lru_cache(maxsize=256)
def chosen(generation: int, first: int, k: int, how: Preset) -> np.ndarray:
    """Which of k segments are in the droplets of the numbers of ``headers``, as rows of 0 and 1."""
    return subsets(headers(generation, first, how)[0], k, how).astype(np.float32)


def sown(data: bytes, generation: int, how: Preset) -> tuple[int, int, bool, list[int], list[bytes]]:
    """A generation's numbers tried, droplets wanted, whether those found peel, and their numbers and strands as bytes."""
    some = np.frombuffer(data + bytes(-len(data) % how.segment), dtype=np.uint8).reshape(-1, how.segment)
    k = len(some)
    bits, wanted = np.unpackbits(some, axis=1).astype(np.float32), how.wanted(k)
    numbers: list[int] = []
    made: list[bytes] = []
    end = FIRST + wanted * how.tries
    for first in range(FIRST, end, STEP):
        tried, head, white = headers(generation, first, how)
        drops = np.packbits((chosen(generation, first, k, how) @ bits).astype(np.int32).astype(np.uint8) & 1, axis=1)
        whole = np.concatenate([head, drops ^ white], axis=1)
        for i in np.flatnonzero(within(base_codes(whole), LIMITS[how.limits]) & (tried < end)):
            numbers.append(int(tried[i]))
            made.append(whole[i].tobytes())
            if len(made) >= wanted and peel([(s, bytes(1)) for s in numbers], k, how) is not None:
                return numbers[-1] - FIRST + 1, wanted, True, numbers, made
    return end - FIRST, wanted, bool(made) and peel([(s, bytes(1)) for s in numbers], k, how) is not None, numbers, made


def cut_up(files: DataFrame, how: Preset) -> DataFrame:
    """(file_id, segments, generation, body): the generations of each file's payload behind its length; none without bytes."""
    size, payload = F.octet_length("payload"), F.col("payload")
    width = GENERATION * how.segment
    parts = F.ceil((size + 4) / how.segment).cast("int")

    def piece(g: Column) -> Column:
        at = g * width
        behind = F.substring(payload, F.greatest(at - 4, F.lit(0)) + 1, F.lit(width))
        return F.substring(F.concat(F.substring(length_bytes(payload), at + 1, F.lit(4)), behind), 1, width)

    generations = F.transform(F.sequence(F.lit(0), F.ceil(parts / GENERATION).cast("int") - 1), piece)
    return files.where(size > 0).select("file_id", parts.alias("segments"), F.posexplode(generations).alias("generation", "body"))


def screened(files: DataFrame, preset: str = "screened") -> DataFrame:
    """A row for each generation: file_id, segments, generation, tried and wanted numbers, whether it peels, numbers and droplets.

    Write it once to have both its ``screened_strands`` and its ``shortfall``.
    """
    how = PRESETS[preset]

    @F.pandas_udf("tried long, wanted long, peels boolean, numbers array<long>, droplets array<binary>")
    def sow(body: pd.Series, generation: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sown(b, int(g), how) for b, g in zip(body, generation, strict=True)], columns=["tried", "wanted", "peels", "numbers", "droplets"])

    return cut_up(files, how).select("file_id", "segments", "generation", sow("body", "generation").alias("s")).select("file_id", "segments", "generation", "s.*")


def screened_strands(sown: DataFrame) -> DataFrame:
    """(file_id, segments, strand_index, seq) of screened generations; the index orders strands by generation and number."""
    each = sown.select("file_id", "segments", "generation", F.explode(F.arrays_zip("numbers", "droplets")).alias("d"))
    return each.select("file_id", "segments", (F.shiftleft(F.col("generation").cast("long"), 32) + F.col("d.numbers")).alias("strand_index"), dna.pack(F.col("d.droplets")).alias("seq"))


def shortfall(sown: DataFrame) -> DataFrame:
    """Per file: droplets wanted and made, numbers tried, the share of them that passed, droplets too few (0 if none), whether every generation peels."""
    made = F.size("droplets").cast("long")
    per = sown.groupBy("file_id").agg(
        F.sum("wanted").alias("wanted"), F.sum(made).alias("made"), F.sum("tried").alias("tried"), F.sum(F.greatest(F.col("wanted") - made, F.lit(0))).alias("short"), F.bool_and("peels").alias("peels")
    )
    return per.withColumn("passed", F.col("made") / F.col("tried"))


def encode(files: DataFrame, preset: str = "default") -> DataFrame:
    """(file_id, segments, strand_index, seq) of each file; ``files`` has file_id and payload.

    A strand holds its generation and its droplet number as four bytes each, then
    the droplet; if screened, both are scattered and whitened.  Files without
    bytes have no strands.
    """
    how = PRESETS[preset]
    if how.tries:
        return screened_strands(screened(files, preset))

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                made = []
                for data, generation in zip(part["body"].to_pylist(), part["generation"].to_pylist(), strict=True):
                    some = np.frombuffer(data + bytes(-len(data) % how.segment), dtype=np.uint8).reshape(-1, how.segment)
                    at, begin = drops_of(len(some), how)
                    head = np.empty((len(begin), 2), dtype=">u4")
                    head[:, 0], head[:, 1] = generation, FIRST + np.arange(len(begin))
                    made.append(np.concatenate([head.view(np.uint8), np.bitwise_xor.reduceat(some[at], begin, axis=0)], axis=1))
                n = np.array([len(m) for m in made])
                row, number = pa.array(np.repeat(np.arange(len(n)), n)), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                index = np.repeat(part["generation"].to_numpy().astype(np.int64), n) * full + number
                seq = strings(PACKED[np.concatenate(made)].ravel(), np.arange(len(number) + 1) * (HEADER + 4 * how.segment))
                yield pa.record_batch({"file_id": part["file_id"].take(row), "segments": part["segments"].take(row), "strand_index": pa.array(index.astype(np.int32)), "seq": seq})

    full = needed(GENERATION, how)
    cut_files = cut_up(files, how).select("file_id", "segments", "generation", "body")
    return cut_files.mapInArrow(run, T.StructType([cut_files.schema["file_id"], *T.StructType.fromDDL("segments int, strand_index int, seq string")]))


def decode(strands: DataFrame, preset: str = "default") -> DataFrame:
    """(file_id, payload, status) from what strands of each file are left (file_id, segments, seq).

    Strands that are null, of another length or no bases count as lost.  A
    generation peels by itself, so a file of any size is many small groups.
    """
    how = PRESETS[preset]
    size = HEADER + 4 * how.segment

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            data, bounds = ascii_bytes(batch["seq"])
            good = np.diff(bounds) == size
            codes = CODE[data[np.repeat(good, np.diff(bounds))]].reshape(-1, size)
            fine = (codes < 4).all(axis=1)
            good[good], codes = fine, codes[fine].reshape(-1, size // 4, 4)
            held = codes[:, :, 0] << 6 | codes[:, :, 1] << 4 | codes[:, :, 2] << 2 | codes[:, :, 3]
            if how.tries:
                # a screened strand's bytes as an unscreened one has them
                keys = np.ascontiguousarray(held[:, :8]).view(">u8").ravel().astype(np.uint64)
                held = np.concatenate([scattered(keys, back=True).astype(">u8").view(np.uint8).reshape(-1, 8), held[:, 8:] ^ whitening(keys, how.segment)], axis=1)
            generation = np.full(len(batch), -1, dtype=np.int64)
            generation[good] = np.ascontiguousarray(held[:, :4]).view(">u4").ravel()
            same = np.stack([grouped(batch["file_id"]), grouped(batch["segments"]), generation])
            begin = np.flatnonzero(np.concatenate([[True], (same[:, 1:] != same[:, :-1]).any(axis=0)]))
            ends = bounded(np.where(good, size // 4, 0))[np.append(begin, len(batch))]
            at = pa.array(begin)
            yield pa.record_batch({"file_id": batch["file_id"].take(at), "segments": batch["segments"].take(at), "generation": pa.array(generation[begin], mask=~good[begin]), "droplets": binaries(held.ravel(), ends)})

    # droplets of one generation that follow one another leave a batch together
    ours = strands.select("file_id", "segments", "seq")
    runs = ours.mapInArrow(run, T.StructType([ours.schema["file_id"], ours.schema["segments"], *T.StructType.fromDDL("generation long, droplets binary")]))
    left = runs.groupBy("file_id", "segments", "generation").agg(F.collect_list("droplets").alias("received"))

    @F.pandas_udf(T.BinaryType())
    def peeled(received: pd.Series, k: pd.Series) -> pd.Series:
        def one(some: list[bytes], n: int) -> bytes | None:
            drops = {d[i : i + size // 4] for d in some for i in range(0, len(d), size // 4)} if n > 0 else ()
            found = peel([(int.from_bytes(d[4:8], "big"), d[8:]) for d in drops], n, how) if drops else None
            return None if found is None else found.tobytes()

        return pd.Series([one(some, int(n)) for some, n in zip(received, k, strict=True)], dtype=object)

    k = F.coalesce(F.least(F.lit(GENERATION), F.col("segments") - F.col("generation") * GENERATION), F.lit(0)).cast("int")
    parts = left.select("file_id", "segments", "generation", peeled("received", k).alias("part"))
    whole = parts.groupBy("file_id", "segments").agg(F.count("part").alias("n"), F.expr("listagg(part) WITHIN GROUP (ORDER BY generation)").alias("bytes"))
    payload, status = cut(F.col("bytes"))
    why = F.when(F.col("n") < F.ceil(F.col("segments") / GENERATION), "stuck").otherwise(status)
    judged = whole.select("file_id", payload.alias("payload"), why.alias("status"))
    return judged.select("file_id", F.when(F.col("status") == "ok", F.col("payload")).alias("payload"), "status")
