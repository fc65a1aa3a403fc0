"""Reed-Solomon parity across the strands of a stripe.

At each position of a stripe, the data strands' bases (0 to 3) are values of a
polynomial over GF(256) at 0, 1, ..., and the parity strands hold its values at
the next points, four bases a symbol.  Up to ``parity`` strands may be missing,
or half as many wrong.  ``parity`` makes and mends strands by joins; here are the
field, one stripe's arithmetic, and the search for wrong bases in the few stripes
that nothing else recovers, a group of at most 256 strands each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import BASES, CODE

BLOCK, POLYNOMIAL = 256, 0x11D


def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, x = np.zeros(512, dtype=np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        x = (x << 1) ^ (POLYNOMIAL if x & 128 else 0)
    log = np.zeros(256, dtype=np.int64)
    log[exp[:255]] = np.arange(255)
    return exp, log


EXP, LOG = _field()
_i = np.arange(256)
MUL = np.where((_i[:, None] > 0) & (_i[None, :] > 0), EXP[(LOG[:, None] + LOG[None, :])], 0).astype(np.uint8)
INV = np.where(_i > 0, EXP[(255 - LOG) % 255], 0).astype(np.uint8)


def gf_matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over GF(256)."""
    out = np.zeros((a.shape[0], b.shape[1]), dtype=np.uint8)
    for k in range(a.shape[1]):
        out ^= MUL[a[:, k][:, None], b[k][None, :]]
    return out


def lagrange(known: tuple[int, ...], wanted: tuple[int, ...]) -> np.ndarray:
    """The matrix that takes values at ``known`` to values at ``wanted``; products are sums of logarithms."""
    x, y = np.array(known), np.array(wanted)
    between = LOG[x[:, None] ^ x[None, :]]
    np.fill_diagonal(between, 0)
    to_known = y[:, None] ^ x[None, :]
    logs = LOG[to_known].sum(axis=1, keepdims=True) - LOG[to_known] - between.sum(axis=1)[None, :]
    out = EXP[logs % 255].astype(np.uint8)
    same = to_known == 0
    hit = same.any(axis=1)
    out[hit] = same[hit]
    return out


@lru_cache(maxsize=1024)
def parity_matrix(k: int, parity: int) -> np.ndarray:
    return lagrange(tuple(range(k)), tuple(range(k, k + parity)))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan over GF(256), with zero for unknowns that are free; None without a solution."""
    m = np.concatenate([a, b[:, None]], axis=1).astype(np.uint8)
    n, row, out = len(m), 0, np.zeros(a.shape[1], dtype=np.uint8)
    at = []
    for c in range(a.shape[1]):
        pivot = next((r for r in range(row, n) if m[r, c]), None)
        if pivot is None:
            continue
        m[[row, pivot]] = m[[pivot, row]]
        m[row] = MUL[INV[m[row, c]], m[row]]
        for r in np.flatnonzero(m[:, c]):
            if r != row:
                m[r] ^= MUL[m[r, c], m[row]]
        at.append(c)
        row += 1
    if m[row:, -1].any():
        return None
    out[at] = m[:row, -1]
    return out


def evaluate(poly: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.uint8)
    for c in poly[::-1]:
        out = MUL[out, x] ^ c
    return out


def correct(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray | None:
    """Values at 0..k-1 of the polynomial of degree below k through most of the points; None if too many are wrong."""
    for e in range((len(x) - k) // 2, -1, -1):
        # all points: the wrong ones may lie anywhere, and be fewer than e
        a = np.zeros((len(x), 2 * e + k), dtype=np.uint8)
        power = np.ones(len(x), dtype=np.uint8)
        for j in range(e + k):
            a[:, j] = power
            if j < e:
                a[:, e + k + j] = MUL[y, power]
            if j == e:
                right = MUL[y, power]
            power = MUL[power, x]
        got = solve(a, right)
        if got is None:
            continue
        q, locator = got[: e + k].copy(), np.append(got[e + k :], 1).astype(np.uint8)
        if (evaluate(q, x) != MUL[y, evaluate(locator, x)]).any():
            continue
        quotient = np.zeros(k, dtype=np.uint8)
        for j in range(k - 1, -1, -1):
            quotient[j] = q[j + e]
            q[j : j + e + 1] ^= MUL[quotient[j], locator]
        if not q.any():
            return evaluate(quotient, np.arange(k, dtype=np.uint8))
    return None


def symbols(strands: list[str | None], width: int, packed: bool) -> np.ndarray:
    """Rows of ``width`` symbols; short strands read as 0, and so do bases that aren't."""
    out = np.zeros((len(strands), width), dtype=np.uint8)
    for i, s in enumerate(strands):
        if not s:
            continue
        codes = CODE[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)] % 4
        if packed:
            codes = codes[: len(codes) // 4 * 4].reshape(-1, 4) @ np.array([64, 16, 4, 1])
        out[i, : min(width, len(codes))] = codes[:width]
    return out


def packed_strand(row: np.ndarray) -> str:
    return BASES[(row[:, None] >> np.array([6, 4, 2, 0])) & 3].tobytes().decode("ascii")


def encode_stripe(strands: list[str], parity: int) -> list[str]:
    data = symbols(strands, len(strands[0]), packed=False)
    return [packed_strand(r) for r in gf_matmul(parity_matrix(len(strands), parity), data)]


def decode_stripe(data: list[str | None], parity: list[str | None], lengths: list[int]) -> tuple[list[str] | None, int]:
    """The data strands (None if they can't be had) and how many symbols were mended; missing strands are None."""
    k, p = len(data), len(parity)
    width = lengths[0]
    have = [i for i, s in enumerate([*data, *parity]) if s]
    if len(have) < k:
        return None, 0
    values = np.concatenate([symbols(data, width, False), symbols(parity, width, True)])
    x = np.array(have, dtype=np.uint8)
    base, rest = tuple(have[:k]), tuple(have[k:])
    out, lost = values[:k].copy(), tuple(i for i in range(k) if not data[i])
    if lost:
        out[list(lost)] = gf_matmul(lagrange(base, lost), values[list(base)])
    mended = sum(1 for s in data if not s) * width
    if rest:
        wrong = (gf_matmul(lagrange(base, rest), values[list(base)]) != values[list(rest)]).any(axis=0)
        for c in np.flatnonzero(wrong):
            fixed = correct(x, values[have, c], k)
            if fixed is None:
                return None, mended
            mended += int((fixed != out[:, c]).sum())
            out[:, c] = fixed
    if (out > 3).any():
        return None, mended
    return [BASES[r[:n]].tobytes().decode("ascii") for r, n in zip(out, lengths, strict=True)], mended


def stripe(index: Column, parity: int) -> Column:
    return F.floor(index / max(1, BLOCK - parity)).cast("int")


def recover(strands: DataFrame, parity: int) -> DataFrame:
    """Data strands of every stripe from what is left of it: (file_id, strand_index, seq, mended).

    ``strands`` has file_id, stripe, source_index, is_parity, seq, and data_strands,
    the number of data strands of the stripe; a seq that is null or not there is
    missing.  All data strands of a stripe have the length of the longest that is
    left, but for the last, which may be shorter if it is there.  Stripes that
    can't be recovered give their strands as they are.
    """
    kind = strands.schema["file_id"].dataType.simpleString()
    width = max(1, BLOCK - parity)

    def run(group: pa.Table) -> pa.Table:
        k = group["data_strands"][0].as_py()
        have = dict(zip(group["source_index"].to_pylist(), group["seq"].to_pylist(), strict=True))
        data, extra = [have.get(i) for i in range(k)], [have.get(k + j) for j in range(parity)]
        full = max([len(s) for s in data if s] + [len(s) // 4 for s in extra if s], default=0)
        lengths = [full] * (k - 1) + [len(data[-1]) if data[-1] else full]
        got, mended = decode_stripe(data, extra, lengths) if full else (None, 0)
        rows = got if got is not None else data
        at = group["stripe"][0].as_py() * width
        keep = [i for i, s in enumerate(rows) if s]
        file_id = group["file_id"].combine_chunks().take(pa.array([0] * len(keep), pa.int32()))
        return pa.table({"file_id": file_id, "strand_index": pa.array([at + i for i in keep], pa.int32()), "seq": pa.array([rows[i] for i in keep], pa.string()), "mended": pa.array([mended] * len(keep), pa.int32())})

    return strands.groupBy("file_id", "stripe").applyInArrow(run, f"file_id {kind}, strand_index int, seq string, mended int")
