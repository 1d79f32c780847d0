"""Vectorised text kernels over Arrow buffers: words, word hashes, n-gram hashes, windowed minima.

Whole record batches are processed as byte arrays, a slice of rows at a time,
so memory depends on the slice (or the longest text), not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at a time; a longer text is handled alone and whole.
SLICE = 1 << 20
#: Odd multipliers of the two polynomial hashes.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))

#: Classes of bytes. UTF-8 continuation and lead bytes are all 0x80 or more, so byte classes equal code point classes.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size."""
    up, down = _powers(base, 1 << max(12, (size - 1).bit_length()))
    return up[:size], down[:size]


@dataclass
class Words:
    """The words of some texts. Word i of text d is in bytes start[i]:end[i]; bounds[d]:bounds[d+1] are its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.count)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes start:end of each word."""
        if self.prefix is None:
            up, _ = powers(BYTE_BASE, len(self.data) + 1)
            self.prefix = np.zeros(len(self.data) + 1, U)
            np.cumsum(BYTE_CODE[self.data] * up[:-1], out=self.prefix[1:])
        _, down = powers(BYTE_BASE, len(self.data) + 1)
        return mix((self.prefix[end] - self.prefix[start]) * down[start] + (end - start).astype(U))

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(column, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of slices of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of member bytes, none across two texts; fold maps bytes first."""
    if fold is not None:
        data = fold[data]
    inside = member[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut], after[cut - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; the last n-1 places have none."""
    size = len(hashes)
    if size < n:
        return np.zeros(0, U)
    up, down = powers(WORD_BASE, size + 1)
    prefix = np.zeros(size + 1, U)
    np.cumsum(hashes * up[:-1], out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * down[: size - n + 1] + U(n))


def covered(places: np.ndarray, length, size: int) -> np.ndarray:
    """Which of size words lie in place:place+length of any place."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + length, -1)
    return np.cumsum(edge[:-1]) > 0
