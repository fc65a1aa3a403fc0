"""Codecs between payloads and strands.

``encode(files)`` turns (file_id, payload) rows into (file_id, strand_index,
seq) rows and ``decode(strands)`` turns them back into (file_id, payload,
status).  Spark cuts a payload into the bytes of its strands and, on the way
back, orders and joins what each strand holds; only the cipher of a column of
pieces is vectorised Python, a step for each position of a strand.  Encoding
shuffles nothing.  Decoding opens strands one by one, wherever they are, and
shuffles their bytes by file.

A null or empty payload has no strands, as the codecs refuse empty input.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dna

BASES = np.frombuffer(b"ATGC", dtype=np.uint8)
CODE = np.full(256, 4, dtype=np.uint8)
CODE[BASES] = np.arange(4)
TRITS = np.array([[(b // 3**k) % 3 for k in range(5, -1, -1)] for b in range(256)], dtype=np.uint8)
SIXES = 3 ** np.arange(5, -1, -1)
#: Fixed values of the ternary format: trits in a strand and its index, whitening multipliers, seed of the tail filler.
SEGMENT, INDEX = 150, 12
WHITE = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FILLER = 0x9E3779B9
THREES = 3 ** np.arange(INDEX - 1, -1, -1)
#: Bytes that the trits of a strand touch, wherever in a byte they begin.
PIECE = SEGMENT // 6 + 1
#: Fixed values of the two-rule format: bases of a payload chunk and its index; base by [after T or G][bit pair].
CHUNK, HEAD = 142, 8
RULES = np.array([[1, 0, 2, 3], [0, 1, 3, 2]], dtype=np.uint8)
UNRULE = np.argsort(RULES, axis=1).astype(np.uint8)
#: Strands that are made at once, strands of one payload that are cut together, and places whose whitening is kept.
AT_ONCE, TOGETHER, KEPT = 16_384, 4_096, 1 << 20
#: Bases that are turned into bytes at once.
UNRULED = 4 << 20
#: The bit pairs of a byte, and bases by [after T or G, bit pair].
PAIRS = ((np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3).astype(np.uint8)
RULED = BASES[RULES].ravel()
#: What a run of strands of one file, numbered one after the other, holds.
RUN = "first int, n int, own binary, rest binary, own_bad long, rest_bad long, whole boolean, read boolean"
RULED_RUN = "first int, n int, bases int, chunk binary, whole boolean, known boolean, good boolean"
FAR = np.iinfo(np.int64).max


def whitening(at: np.ndarray) -> np.ndarray:
    """The trits added at positions of a payload."""
    x = at.astype(np.uint64) + np.uint64(WHITE[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(WHITE[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(WHITE[2])
    return ((x ^ (x >> np.uint64(31))) % np.uint64(3)).astype(np.uint8)


@lru_cache(maxsize=1)
def first_whitening() -> np.ndarray:
    return whitening(np.arange(KEPT))


def whitened(start: np.ndarray) -> np.ndarray:
    """Rows of the SEGMENT trits that are added from some positions on."""
    near = start <= KEPT - SEGMENT
    rows = np.lib.stride_tricks.sliding_window_view(first_whitening(), SEGMENT)[np.where(near, start, 0)]
    if not near.all():
        rows[~near] = whitening(start[~near, None] + np.arange(SEGMENT))
    return rows


def filler() -> bytes:
    """Pseudo-random bytes that fill up the last segment of a payload."""
    out, state = [], FILLER
    for _ in range(SEGMENT // 6):
        for left, by in ((True, 13), (False, 17), (True, 5)):
            state ^= (state << by if left else state >> by) & 0xFFFFFFFF
        out.append(state % 256)
    return bytes(out)


TAIL = filler()


def rotate(trits: np.ndarray) -> np.ndarray:
    """Columns of trits as base codes, each base differing from the one before; a column starts from A."""
    out, last = np.empty_like(trits), np.zeros(trits.shape[1], dtype=np.uint8)
    for j in range(len(trits)):
        np.add(trits[j], trits[j] >= last, out=out[j])
        last = out[j]
    return out


def unrotate(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The trits of rows of base codes, and which rows are valid."""
    before = np.concatenate([np.zeros((len(codes), 1), dtype=np.uint8), codes[:, :-1]], axis=1)
    return codes - (codes > before), ((codes < 4) & (codes != before)).all(axis=1)


def grouped(column: pa.Array) -> np.ndarray:
    """A number for each row, equal for equal values; nulls are equal."""
    if pa.types.is_struct(column.type):
        return together(np.asarray(column.is_null()).astype(np.int64), *map(grouped, column.flatten()))
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def together(*parts: np.ndarray) -> np.ndarray:
    """A number for each row, below the number of rows, equal where all of ``parts`` (0 and more) are equal."""
    out = parts[0].astype(np.int64)
    for part in parts[1:]:
        out = np.unique(out * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1].ravel()
    return out


def ascii_bytes(seq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of strings, others than ASCII as ``?``, and where each string begins; null as empty."""
    seq = seq.fill_null("")
    bounds = np.frombuffer(seq.buffers()[1], dtype=np.int32)[seq.offset : seq.offset + len(seq) + 1].astype(np.int64)
    data = np.frombuffer(seq.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    if (data > 127).any():
        texts = [s.encode("ascii", "replace") for s in seq.to_pylist()]
        return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return data, bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def bounded(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def unruled(data: np.ndarray, room: np.ndarray, bases: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole bytes of bases by two rules, and how many each row has: a row is ``runs`` runs, each of so many bases in ``room`` packed bytes."""
    inside = np.arange(4 * len(data)) - np.repeat(4 * (np.cumsum(room) - room), 4 * room) < np.repeat(bases, 4 * room)
    codes = PAIRS[data].ravel()[inside]
    n = np.diff(bounded(bases)[bounded(runs)])
    late = np.zeros(len(codes), dtype=np.uint8)
    late[1:] = (codes[:-1] == 1) | (codes[:-1] == 2)
    late[(np.cumsum(n) - n)[n > 0]] = 0
    pairs = UNRULE.ravel()[4 * late + codes]
    pairs = pairs[np.arange(len(pairs)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(n // 4 * 4, n)].reshape(-1, 4)
    return pairs[:, 0] << 6 | pairs[:, 1] << 4 | pairs[:, 2] << 2 | pairs[:, 3], n // 4


def ruled(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """Four bases for each byte by two rules.  A base is A or C, or T or G, as the pairs so far with a low bit of 0 are even or odd in number; ``sizes`` are the bytes of each row."""
    pairs = PAIRS[np.frombuffer(data, dtype=np.uint8)].ravel()
    flips = 1 - (pairs & 1)
    state = np.bitwise_xor.accumulate(flips) ^ flips
    full = sizes[sizes > 0]
    begin = 4 * (np.cumsum(full) - full)
    return RULED[(state ^ np.repeat(state[begin], 4 * full)) * 4 + pairs]


@lru_cache(maxsize=1)
def heads() -> np.ndarray:
    """The index bases of the two-rule format by index."""
    return ruled(np.arange(1 << 16).astype(">u2").tobytes(), np.full(1 << 16, 2)).reshape(-1, HEAD)


def made_by(files: DataFrame, strands) -> DataFrame:
    """``files`` with strand_index and seq in place of payload: ``strands`` takes payloads (null: none) and gives tables of row, strand_index and seq."""
    others = [c for c in files.columns if c != "payload"]
    shape = T.StructType([files.schema[c] for c in others]).add("strand_index", T.IntegerType()).add("seq", T.StringType())

    def run(batches):
        for batch in batches:
            for row, index, seq in strands(batch["payload"]):
                at = pa.array(row)
                yield pa.record_batch([*(batch[c].take(at) for c in others), pa.array(index.astype(np.int32)), seq], names=[*others, "strand_index", "seq"])

    return files.mapInArrow(run, shape)


def runs_of(strands: DataFrame, opened, shape: str) -> DataFrame:
    """Runs of the strands of each file (file_id, seq) that a batch holds: ``opened`` takes seqs and numbers of their files."""

    def run(batches):
        for batch in batches:
            if len(batch):
                at, columns = opened(batch["seq"], grouped(batch["file_id"]))
                yield pa.record_batch({"file_id": batch["file_id"].take(pa.array(at)), **columns})

    return strands.select("file_id", "seq").mapInArrow(run, T.StructType([strands.schema["file_id"], *T.StructType.fromDDL(shape)]))


def run_starts(file: np.ndarray, index: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of strands by file and index, and where in it runs begin; a strand whose index isn't known is one by itself."""
    order = np.lexsort((index, ~known, file))
    f, i, k = file[order], index[order], known[order]
    goes_on = (f[1:] == f[:-1]) & (i[1:] == i[:-1] + 1) & k[1:] & k[:-1]
    return order, np.flatnonzero(np.concatenate([[True], ~goes_on]))


def length_bytes(payload: Column) -> Column:
    return F.unhex(F.lpad(F.hex(F.octet_length(payload).cast("long")), 8, "0"))


def cut(whole: Column, bad: Column | None = None) -> tuple[Column, Column]:
    """The payload behind its length and a status; ``bad`` is the first place that isn't a byte."""
    n = F.conv(F.hex(F.substring(whole, 1, 4)), 16, 10).cast("long")
    bad = F.lit(np.iinfo(np.int64).max) if bad is None else bad
    status = F.when((F.octet_length(whole) < 4) | (bad < 4), "header").when((F.octet_length(whole) < n + 4) | (bad < n + 4), "payload").otherwise("ok")
    return F.substring(whole, F.lit(5), n.cast("int")), status


@dataclass(frozen=True)
class Ternary:
    """Rotating ternary cipher: 150 whitened trits a strand behind a 12-trit index; neighbours share ``overlap`` trits."""

    overlap: int = 0
    name: str = "ternary-rotating-cipher"

    @property
    def step(self) -> int:
        return max(1, SEGMENT - self.overlap)

    def count(self, size: Column) -> Column:
        """Strands of a payload of ``size`` bytes."""
        return (1 + F.greatest(F.lit(0), F.ceil((6 * (size + 4) - SEGMENT) / self.step))).cast("long")

    def encode(self, files: DataFrame) -> DataFrame:
        return made_by(files, self.maker())

    def maker(self, width: int = 1):
        """Strands of payloads as for ``made_by``; what is given at once are whole runs of ``width`` strands, but for a payload's last."""
        step, most = self.step, width * max(1, TOGETHER // width)

        def piece(payload: memoryview, first: int, last: int) -> bytes:
            a, b = first * step // 6, last * step // 6 + PIECE
            if a < 4:
                return (len(payload).to_bytes(4, "big") + payload[: max(b - 4, 0)].tobytes() + TAIL + bytes(1))[a:b]
            return (payload[a - 4 : b - 4].tobytes() + TAIL + bytes(1))[: b - a]

        def made(todo: list[tuple[int, int, int, bytes]]):
            row, first, n = (np.array(x, dtype=np.int64) for x in list(zip(*todo, strict=True))[:3])
            bounds, at = bounded(np.array([len(t[3]) for t in todo])), first * step // 6
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
            start = index * step
            trits = TRITS[np.frombuffer(b"".join(t[3] for t in todo), dtype=np.uint8)].ravel()
            body = np.lib.stride_tricks.sliding_window_view(trits, SEGMENT)[start + np.repeat(6 * (bounds[:-1] - at), n)]
            body = (body + whitened(start)) % 3
            codes = np.concatenate([rotate((index // THREES[:, None] % 3).astype(np.uint8)), rotate(np.ascontiguousarray(body.T))])
            return np.repeat(row, n), index, strings(BASES[codes].T.ravel(), np.arange(len(index) + 1) * (INDEX + SEGMENT))

        def strands(payloads):
            todo, size = [], 0
            for row in range(len(payloads)):
                if not payloads[row].is_valid:
                    continue
                payload = memoryview(payloads[row].as_buffer())
                n = 1 + max(0, -(-(6 * (len(payload) + 4) - SEGMENT) // step))
                if n > 3**INDEX:
                    raise ValueError(f"strands don't fit a {INDEX}-trit index")
                for first in range(0, n, most):
                    some = min(most, n - first)
                    todo.append((row, first, some, piece(payload, first, first + some - 1)))
                    size += some
                    if size >= AT_ONCE:
                        yield made(todo)
                        todo, size = [], 0
            if todo:
                yield made(todo)

        return strands

    def decode(self, strands: DataFrame) -> DataFrame:
        """Bytes that two strands hold are taken from the later one.  Why a file has no payload: strands of a wrong length or base, missing ones, or a bad trit group.

        Strands of one file that a batch holds leave it as runs, so few rows are shuffled where they come in order.
        """
        step = self.step

        def held(trits: np.ndarray, skip: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Bytes begin .. end - 1 of each row, one after the other, their number, and each row's first that isn't a byte."""
            most = int(end.max(initial=0))
            values, at = np.zeros((len(trits), most), dtype=np.uint16), np.arange(most)
            for s in np.unique(skip):
                rows = np.flatnonzero(skip == s)
                n = min(most, (SEGMENT - s) // 6)
                groups = trits[rows, s : s + 6 * n].reshape(len(rows), n, 6)
                value = groups[:, :, 0].astype(np.uint16)
                for k in range(1, 6):
                    value = value * 3 + groups[:, :, k]
                values[rows, :n] = value
            inside = (at >= begin[:, None]) & (at < end[:, None])
            bad = np.where((values > 255) & inside, first[:, None] + at, FAR).min(axis=1, initial=FAR)
            return values.astype(np.uint8)[inside], np.maximum(end - begin, 0), bad

        def opened(seq, file):
            data, bounds = ascii_bytes(seq)
            whole = np.diff(bounds) == INDEX + SEGMENT
            codes = CODE[data] if whole.all() else CODE[data[np.repeat(whole, np.diff(bounds))]]
            codes = codes.reshape(-1, INDEX + SEGMENT)
            head, fine = unrotate(codes[:, :INDEX])
            body, good = unrotate(codes[:, INDEX:])
            number = (head.astype(np.int64) * fine[:, None]) @ THREES
            index, known = np.zeros(len(seq), dtype=np.int64), np.zeros(len(seq), dtype=bool)
            index[whole], known[whole] = number, fine & good
            trits = np.zeros((len(seq), SEGMENT), dtype=np.uint8)
            trits[whole] = (body + 3 - whitened(number * step)) % 3
            order, begin = run_starts(file, index, known)
            index, known, trits, whole = index[order], known[order], trits[order], whole[order]
            skip = -index * step % 6
            first, own = (index * step + skip) // 6, np.where(known, -(-(step - skip) // 6), 0)
            n = np.diff(np.append(begin, len(seq)))
            last = begin + n - 1
            data, size, bad = held(trits, skip, np.zeros_like(own), own, first)
            rest, more, rest_bad = held(trits[last], skip[last], own[last], np.where(known[last], (SEGMENT - skip[last]) // 6, 0), first[last])
            return order[begin], {
                "first": pa.array(index[begin].astype(np.int32), mask=~known[begin]), "n": pa.array(n.astype(np.int32)), "own": binaries(data, bounded(size)[np.append(begin, len(seq))]), "rest": binaries(rest, bounded(more)),
                "own_bad": pa.array(np.minimum.reduceat(bad, begin)), "rest_bad": pa.array(rest_bad), "whole": pa.array(whole[begin]), "read": pa.array(known[begin]),
            }

        files = runs_of(strands, opened, RUN).groupBy("file_id").agg(
            F.bool_and("whole").alias("whole"), F.bool_and("read").alias("read"), F.array_sort(F.collect_list(F.struct("first", "n"))).alias("found"),
            F.expr("listagg(own) WITHIN GROUP (ORDER BY first)").alias("own"), F.max_by("rest", "first").alias("rest"),
            F.least(F.min("own_bad"), F.max_by("rest_bad", "first")).alias("bad"),
        )
        joined = files.select("file_id", "whole", "read", _dense("found").alias("dense"), F.concat("own", "rest").alias("bytes"), "bad")
        return _opened(joined, *cut(F.col("bytes"), F.col("bad")))


@dataclass(frozen=True)
class TwoRule:
    """Two bits a base, chosen by two rules of which one sees the base before; 142 bases a strand behind an 8-base index."""

    name: str = "yin-yang"

    def count(self, size: Column) -> Column:
        return F.ceil(4 * (size + 4) / CHUNK).cast("long")

    def encode(self, files: DataFrame) -> DataFrame:
        return made_by(files, self.maker())

    def maker(self, width: int = 1):
        """Strands of payloads as for ``made_by``, a payload's all at once."""

        def made(todo: list[tuple[int, int, bytes]]):
            row, n = (np.array(x, dtype=np.int64) for x in list(zip(*todo, strict=True))[:2])
            sizes = np.array([len(t[2]) for t in todo])
            bases = ruled(b"".join(t[2] for t in todo), sizes)
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            length = np.minimum(CHUNK, np.repeat(4 * sizes, n) - index * CHUNK)
            whole = np.empty((len(index), HEAD + CHUNK), dtype=np.uint8)
            whole[:, :HEAD] = heads()[index]
            held = np.arange(HEAD + CHUNK) < HEAD + length[:, None]
            held[:, :HEAD] = False
            whole[held] = bases
            held[:, :HEAD] = True
            return np.repeat(row, n), index, strings(whole[held], bounded(HEAD + length))

        def strands(payloads):
            todo, size = [], 0
            for row in range(len(payloads)):
                if not payloads[row].is_valid:
                    continue
                payload = payloads[row].as_py()
                n = -(-4 * (len(payload) + 4) // CHUNK)
                if n > 1 << 16:
                    raise ValueError("strands don't fit a 16-bit index")
                todo.append((row, n, len(payload).to_bytes(4, "big") + payload))
                size += n
                if size >= AT_ONCE:
                    yield made(todo)
                    todo, size = [], 0
            if todo:
                yield made(todo)

        return strands

    def decode(self, strands: DataFrame) -> DataFrame:
        def opened(seq, file):
            data, bounds = ascii_bytes(seq)
            whole = np.diff(bounds) > HEAD
            codes = CODE[data[bounds[:-1][whole, None] + np.arange(HEAD)]]
            late = np.zeros_like(codes)
            late[:, 1:] = (codes[:, :-1] == 1) | (codes[:, :-1] == 2)
            fine = (codes < 4).all(axis=1)
            number = UNRULE.ravel()[4 * late + np.minimum(codes, 3)].astype(np.int64) @ (4 ** np.arange(HEAD - 1, -1, -1))
            index, known = np.zeros(len(seq), dtype=np.int64), np.zeros(len(seq), dtype=bool)
            index[whole], known[whole] = np.where(fine, number, 0), fine
            order, begin = run_starts(file, index, known)
            # the bases behind the indexes, in the order of the strands
            size = np.maximum(np.diff(bounds) - HEAD, 0)[order]
            place = np.arange(size.sum()) + np.repeat((bounds[:-1] + HEAD)[order] - (np.cumsum(size) - size), size)
            n = np.diff(np.append(begin, len(seq)))
            # what leaves a batch are two bits a base, each run from a byte of its own
            codes, ends = CODE[data[place]], bounded(size)[np.append(begin, len(seq))]
            bases = np.diff(ends)
            room = -(-bases // 4)
            packed = np.zeros(4 * room.sum(), dtype=np.uint8)
            packed[np.arange(len(codes)) + np.repeat(4 * (np.cumsum(room) - room) - ends[:-1], bases)] = codes & 3
            four = packed.reshape(-1, 4)
            good = np.diff(bounded(codes > 3)[ends]) == 0
            return order[begin], {
                "first": pa.array(index[order][begin].astype(np.int32), mask=~known[order][begin]), "n": pa.array(n.astype(np.int32)), "bases": pa.array(bases.astype(np.int32)),
                "chunk": binaries(four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3], bounded(room)), "whole": pa.array(whole[order][begin]), "known": pa.array(known[order][begin]), "good": pa.array(good),
            }

        def run(batches):
            for whole in batches:
                lists = whole["found"]
                at = bounded(np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                all_bases = flat.field("bases").to_numpy().astype(np.int64)
                upto = bounded(all_bases)[at]
                i = 0
                while i < len(whole):
                    j = max(i + 1, int(np.searchsorted(upto, upto[i] + UNRULED, side="right")) - 1)
                    chunk, bases = flat.field("chunk").slice(at[i], at[j] - at[i]), all_bases[at[i] : at[j]]
                    data = np.frombuffer(b"".join(chunk.to_pylist()), dtype=np.uint8)
                    out, n = unruled(data, -(-bases // 4), bases, np.diff(at[i : j + 1]))
                    yield pa.record_batch([whole[c].slice(i, j - i) for c in ("file_id", "whole", "read", "dense")] + [binaries(out, bounded(n))], names=["file_id", "whole", "read", "dense", "bytes"])
                    i = j

        files = runs_of(strands, opened, RULED_RUN).groupBy("file_id").agg(
            F.bool_and("whole").alias("whole"), F.bool_and("known").alias("known"), F.bool_and("good").alias("good"), F.array_sort(F.collect_list(F.struct("first", "n", "bases", "chunk"))).alias("found")
        )
        dense = _dense("found")
        files = files.select("file_id", "whole", (F.col("known") & (F.col("good") | ~dense)).alias("read"), dense.alias("dense"), "found")
        joined = files.mapInArrow(run, T.StructType([strands.schema["file_id"], *T.StructType.fromDDL("whole boolean, read boolean, dense boolean, bytes binary")]))
        return _opened(joined, *cut(F.col("bytes")))


def _dense(found: str) -> Column:
    """Whether sorted runs are numbered 0, 1, 2, ... one after the other."""
    after = F.aggregate(found, F.lit(0), lambda end, run: F.when(run["first"] == end, end + run["n"]).otherwise(-1))
    return after > 0


def _opened(files: DataFrame, payload: Column, status: Column) -> DataFrame:
    why = F.when(~F.col("whole"), "length").when(~F.col("read"), "base").when(~F.col("dense"), "missing").otherwise(status)
    judged = files.select("file_id", payload.alias("payload"), why.alias("status"))
    return judged.select("file_id", F.when(F.col("status") == "ok", F.col("payload")).alias("payload"), "status")


CODECS = {"ternary": Ternary(), "ternary-overlap": Ternary(75), "ternary-high": Ternary(112), "yinyang": TwoRule()}


def encode(files: DataFrame, codec: str = "ternary") -> DataFrame:
    """(file_id, strand_index, seq) of each file; ``files`` has file_id and payload (binary)."""
    return CODECS[codec].encode(files.where(F.octet_length("payload") > 0).select("file_id", "payload"))


def decode(strands: DataFrame, codec: str = "ternary") -> DataFrame:
    """(file_id, payload, status) of each file; payload is null unless status is ``ok``."""
    return CODECS[codec].decode(strands.select("file_id", "seq"))


def collection_stats(files: DataFrame, codec: str = "ternary") -> DataFrame:
    """Per file that has strands: n_bytes, strands, nucleotides, bits_per_nt, avg_gc (mean share of a strand), max_run.

    Strands are summed up where they are made, so a file is one row in the shuffle.
    """
    sized = files.where(F.octet_length("payload") > 0).select("file_id", F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
    made = CODECS[codec].encode(sized)
    seq = F.col("seq")
    per = made.groupBy("file_id", "n_bytes").agg(F.count(F.lit(1)).alias("strands"), F.sum(F.length(seq)).alias("nucleotides"), F.avg(dna.gc_content(seq)).alias("avg_gc"), F.max(dna.max_run(seq)).alias("max_run"))
    return per.withColumn("bits_per_nt", 8 * F.col("n_bytes") / F.col("nucleotides"))
