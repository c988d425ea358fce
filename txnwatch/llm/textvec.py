"""Vectorised work on the UTF-8 bytes of many texts at once (NumPy, inside tasks).

Texts of an Arrow column are taken in chunks of about a megabyte. Words, lines
and word n-grams get 64-bit hashes from one running polynomial over random
byte values, so nothing loops over characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**64, 256, dtype=U) | U(1)
#: Odd multipliers for positions in n-grams of words.
PLACE = _rng.integers(1, 2**64, 64, dtype=U) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: All of ASCII but digits and lower-case letters.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = True
PUNCTUATION[48:58] = False
PUNCTUATION[97:123] = False

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n (wrapping)."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * CHUNK_BYTES)
        for k, base in enumerate((BASE, _INVERSE)):
            run = np.full(size, base, U)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=U)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the n + 1 offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts of about ``limit`` bytes, one text at least."""
    data, offsets = raw(column)
    first = 0
    while first < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(offsets) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


class Words:
    """The words of a chunk, between bytes of ``apart``: byte spans, text number and count per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE):
        inside = ~apart[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        self.inside = inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # words of text k: bounds[k] to bounds[k + 1]
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)


class Hasher:
    """Hashes of byte spans of one chunk."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.run = np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * up[: len(data)], dtype=U)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.run[end] - self.run[start]) * self.down[start] + (end - start).astype(U))


def grams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words that lie within one text, and where they start."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(m, U)
    for k in range(n):
        total += hashes[k : k + m] * PLACE[k]
    at = np.flatnonzero(text[:m] == text[n - 1 :])
    return mix(total[at]), at
