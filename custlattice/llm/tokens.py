"""Words of a batch of texts as arrays, and hashes of words and word sequences without a loop over words.

A batch is one byte buffer with row offsets. The hash of bytes b0..bn is sum((b_i + 1) * P^i) modulo 2^64, then mixed.
It is a difference of two prefix sums, so any span of the buffer costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
#: Bytes handled at once; a longer text is handled alone.
SLICE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but the white space \x20 and \x09-\x0D.
WORD = np.ones(256, dtype=bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and all bytes of other characters.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and row offsets of a string or binary array; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of about SLICE bytes of text: the rows, their buffer and offsets."""
    raw, off = text_bytes(batch.column(batch.schema.get_field_index(name)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        j = min(j, n, i + 8192)
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    """start, end: byte positions. rows: of row r the words rows[r] to rows[r + 1]. hashes: one per word."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    sums: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _powers(_P_INVERSE, len(self.sums))[start])

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    @property
    def left_in_row(self) -> np.ndarray:
        """Words from this one to the end of its row, itself included."""
        return np.repeat(self.rows[1:], np.diff(self.rows)) - np.arange(len(self.start))


def words(raw: np.ndarray, off: np.ndarray, kind: np.ndarray = WORD) -> Words:
    """Maximal runs of bytes of `kind`, A-Z lower-cased for the hashes."""
    n = len(raw)
    inside = kind[raw]
    full = off[:-1] < off[1:]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[off[:-1][full]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[off[1:][full] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    low = LOWER[raw]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=sums[1:])
    return Words(low, start, end, np.searchsorted(start, off), sums)


def word_slices(texts: pa.Array, kind: np.ndarray = WORD) -> Iterator[tuple[int, Words]]:
    """Of consecutive parts of an array of texts, the number of rows and their words."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    for part, raw, off in slices(batch, "text"):
        yield part.num_rows, words(raw, off, kind)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive words from each position, as if the rows were one; the last k - 1 positions are missing."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(pow(_Q, j + 1, 1 << 64))
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class HashTable:
    """Membership and position of 64-bit hashes in a sorted key array; most misses cost one look at a byte table."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = np.sort(np.asarray(keys, dtype=np.uint64))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self.keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` that are keys, and which key each is."""
        at = np.flatnonzero(self.maybe[hashes >> self.shift])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        which = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[which] == hashes[at]
        return at[hit], which[hit]
