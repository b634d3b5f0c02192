"""Words of many texts at once: boundaries and 64-bit hashes by NumPy over an Arrow column's bytes.

A word is read eight bytes at a time. Each eight are mixed, with their place in the word, by a non-linear bijection, and
the results added up: words of up to eight bytes never share a hash except by the length's share in it, longer ones as
random numbers would. No Python object is made for a word. Where two words taken for one would change a text or drop
it, the callers compare bytes or a cryptographic digest besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_PLACE, _LENGTH = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words(NamedTuple):
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    bounds: np.ndarray  # bounds[d]:bounds[d + 1] are the words of text d
    hash: np.ndarray  # uint64
    data: np.ndarray  # the bytes, for hashes of parts of words

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def head(self, n: int) -> np.ndarray:
        """The hash of each word's first n bytes."""
        return hashes(self.data, self.start, np.minimum(self.start + n, self.end))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; NumPy's sort is many times as fast here as its unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _read(eight: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    return eight[at] & (~_U(0) >> (_U(64) - _U(8) * np.clip(left, 1, 8).astype(_U)))


def _beyond(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which stretches go on after eight bytes, where their parts of eight begin in the third, and the parts' numbers."""
    long = np.flatnonzero(length > 8)
    parts = (length[long] - 1) // 8
    first = np.cumsum(parts) - parts
    return long, first, 1 + np.arange(int(parts.sum())) - np.repeat(first, parts)


def equal(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether stretches of the given lengths hold the same bytes."""
    x, y = _eights(a), _eights(b)
    out = _read(x, at_a, length) == _read(y, at_b, length)
    long, first, k = _beyond(length)
    if len(long):
        n = np.diff([*first, len(k)])
        left = length[long].repeat(n) - 8 * k
        out[long] &= np.logical_and.reduceat(_read(x, at_a[long].repeat(n) + 8 * k, left) == _read(y, at_b[long].repeat(n) + 8 * k, left), first)
    return out


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each stretch of the bytes."""
    eight, length = _eights(LOWER[data] if lower else data), end - start
    out = _read(eight, start, length)
    long, first, k = _beyond(length)
    if len(long):
        n = np.diff([*first, len(k)])
        value = _read(eight, start[long].repeat(n) + 8 * k, length[long].repeat(n) - 8 * k)
        out[long] += np.add.reduceat(mix(value ^ mix(k.astype(_U) * _PLACE)), first)
    return mix(out ^ (length.astype(_U) * _LENGTH))


def slices(column: pa.Array, most: int = (1 << 20) - 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, offsets) of runs of texts of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTE) -> Words:
    """The runs of bytes for which ``inside`` holds, never across texts, hashed with A-Z lower-cased."""
    n = len(data)
    is_in = np.zeros(n + 1, dtype=bool)
    is_in[:n] = inside[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = is_in[:-1]
    begins = is_in & (~before | first)
    ends = before & (~is_in | first)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(start, end, np.searchsorted(start, offsets), hashes(data, start, end), data)


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words, and the bounds of each text's runs; a text of 1 to n - 1 words has one run of all."""
    counts = np.diff(bounds)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(bounds[:-1], made) + np.arange(out[-1]) - np.repeat(out[:-1], made)
    last = np.repeat(bounds[1:], made)
    h = np.zeros(out[-1], _U)
    for k in range(n):
        there = at + k
        ok = there < last
        part = np.where(ok, hashes[np.minimum(there, max(len(hashes) - 1, 0))], _U(0)) if len(hashes) else h
        h = h * _U(0x9E3779B97F4A7C15) + part
    return mix(h), out
