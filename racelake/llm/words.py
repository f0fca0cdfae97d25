"""Words of Arrow text columns as numpy arrays, and 64-bit polynomial hashes of words and word windows.

A word is a run of bytes outside `\\x20` and `\\x09-\\x0D`; those are single bytes in UTF-8, so words are found
in the bytes. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same set as a Java character class.
SPACE_CLASS = r"[ \t-\r]"
WORD_PATTERN = r"[^ \t-\r]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Odd factors have an inverse modulo 2**64.
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """base**0 … base**n and its inverses; grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        return self.up[: n + 1], self.down[: n + 1]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


@dataclass
class Words:
    """Words of some rows in order: their bytes are `data[start:end]`, `row` counts from 0."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    rows: int

    def __len__(self) -> int:
        return len(self.row)

    def per_row(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def first_of_row(self) -> np.ndarray:
        """Index of each row's first word, and one past the last row's last word."""
        return np.concatenate([[0], np.cumsum(self.per_row())])

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One uint64 for each word; `lower` folds A-Z."""
        data = _LOWER[self.data] if lower else self.data
        up, down = _BYTE_POWERS.get(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        length = (self.end - self.start).astype(np.uint64)
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + length)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and row offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(data, row, start, np.flatnonzero(last) + 1, len(offsets) - 1)


def row_slices(column: pa.Array, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes of text each; a longer text is a range of its own."""
    _, offsets = text_buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def words_of(column: pa.Array) -> Words:
    return find_words(*text_buffers(column))


def windows(hashes: np.ndarray, first_of_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of each run of `size` words inside one row: the index of its first word, and the hash."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    at = np.arange(n - size + 1)
    row_end = np.repeat(first_of_row[1:], np.diff(first_of_row))
    at = at[at + size <= row_end[at]]
    return at, mix((sums[at + size] - sums[at]) * down[at])
