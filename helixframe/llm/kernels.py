"""Vectorised text kernels that run on Arrow batches inside Spark tasks.

A batch's text column is one UTF-8 buffer plus row offsets.  The kernels find
the words in that buffer with a 256-entry byte table, hash every word, and roll
those word hashes into Rabin-Karp hashes of fixed-length word windows.  Null and empty texts hold no words.

Memory is bounded by ``PIECE`` bytes of text (a row longer than that is hashed
piece by piece, cut between words), plus 8 bytes or so for each word of the
rows in one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Odd 64-bit multipliers of bytes, and of the polynomials of words, and of words again.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
OTHER_BASE = 0xAF251AF3B0F025B5

#: Bytes that separate words: space and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False

#: Letters, digits and every byte of a multi-byte character; the rest separates.
ALNUM = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    ALNUM[_lo : _hi + 1] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[tuple[int, bool], np.ndarray] = {}


def power_table(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """A prefix of the (inverse) powers, kept for the life of the worker up to a piece."""
    key = (base, inverse)
    if key not in _tables or len(_tables[key]) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        table = powers(step, max(n, 1 << 16))
        if n > PIECE + 1:
            return table
        _tables[key] = table
    return _tables[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads a polynomial's weak low bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some rows: byte bounds in ``data``, and each row's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row offsets of a string column; nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    lo, hi = int(at[0]), int(at[-1])
    return np.frombuffer(data, dtype=np.uint8)[lo:hi], at - lo


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, j
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> Words:
    """Maximal runs of word bytes; a row's end also ends a word."""
    n = len(data)
    word = table[data]
    edge = np.empty(n + 1, dtype=bool)
    if n:
        edge[0], edge[n] = word[0], word[-1]
        np.not_equal(word[1:], word[:-1], out=edge[1:n])
    else:
        edge[:] = False
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    cut = inner[word[inner] & word[inner - 1]] if n else inner[:0]
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    if len(cut):
        cut = np.unique(cut)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return Words(data, start, end, np.searchsorted(start, offsets, side="left"))


def hash_words(words: Words, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands.

    Every byte at every place of a word has a pseudo-random number of its own,
    and a word's hash is their sum: unlike a polynomial modulo 2**64, no pattern
    of bytes makes the sums of two words meet.  Hashes of unlike seeds are
    independent.
    """
    out = np.empty(len(words.start), dtype=np.uint64)
    seeded = mix(np.array([seed], dtype=np.uint64) + np.uint64(BYTE_BASE))[0]
    i, n = 0, len(out)
    while i < n:
        lo = int(words.start[i])
        j = max(i + 1, int(np.searchsorted(words.end, lo + PIECE, side="right")))
        hi = int(words.end[j - 1])
        piece = words.data[lo:hi]
        if lower:
            piece = LOWER[piece]
        start, end = words.start[i:j] - lo, words.end[i:j] - lo
        values = np.arange(hi - lo) - np.repeat(start, np.diff(np.append(start, hi - lo)))
        values = mix((values.astype(np.uint64) << np.uint64(8) | piece) * np.uint64(BYTE_BASE) + seeded)
        bounds = np.empty(2 * len(start), dtype=np.int64)
        bounds[0::2], bounds[1::2] = start, end
        if bounds[-1] == len(values):
            bounds = bounds[:-1]
        out[i:j] = mix(np.add.reduceat(values, bounds)[0::2] + (end - start).astype(np.uint64))
        i = j
    return out


def hash_windows(hashes: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Rolling hash of ``width`` consecutive words, for every start that leaves room."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * power_table(base, len(hashes)), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * power_table(base, n, inverse=True))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Which of the starts of ``hash_windows`` stay inside one row."""
    total = int(first[-1])
    n = max(0, total - width + 1)
    row_end = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + width <= row_end[:n]
