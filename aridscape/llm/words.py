"""Words, hashes and token ids of whole Arrow columns with numpy.

A word is ``[^\\x20\\x09-\\x0D]+``: a run of bytes other than the six ASCII
white-space bytes. The 64-bit hash of a byte range is a polynomial over random
byte values, taken from prefix sums, so that any range costs two look-ups.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def _return_memory() -> None:
    """Python workers live on between tasks: large arrays go back to the system
    when they are freed, instead of staying with an idle worker."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library


_return_memory()

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(7))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        for value in (_BASE, _INVERSE):
            factors = np.full(n, value, np.uint64)
            factors[0] = 1
            if value == _BASE:
                _power = np.cumprod(factors)
            else:
                _inverse = np.cumprod(factors)
    return _power, _inverse


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits spread over all 64 places (a fixed finaliser)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Rows ``first .. first + len(offsets) - 1`` of a column and their words.

    ``data`` holds the bytes, ``offsets`` the rows' places in it, ``starts``
    and ``ends`` the words', ``row`` each word's row within the slice and
    ``bounds`` each row's first word.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None, lower: bool = False) -> np.ndarray:
        """Hash of each byte range (ascending, not overlapping; the words by default)."""
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        out = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            part = self.data[base : ends[to - 1]]
            power, inverse = _powers(len(part) + 1)
            values = _BYTE[LOWER[part] if lower else part]
            values *= power[: len(part)]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = (sums[e] - sums[s]) * inverse[s] + e.astype(np.uint64) - s.astype(np.uint64)
            at = to
        return mixed(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets, data


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of about ``size`` bytes; a longer row is a slice of its own."""
    if not len(column):
        return
    all_offsets, all_data = text_buffers(column)
    first, n = 0, len(all_offsets) - 1
    while first < n:
        to = max(first + 1, int(np.searchsorted(all_offsets, all_offsets[first] + size, "right")) - 1)
        to = min(to, n)
        offsets = all_offsets[first : to + 1] - all_offsets[first]
        data = all_data[all_offsets[first] : all_offsets[to]]
        inside = _WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        breaks = offsets[:-1][offsets[:-1] < len(data)]
        begins[breaks] = inside[breaks]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | begins[1:]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        bounds = np.searchsorted(starts, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        yield Slice(first, data, offsets, starts, ends, row, bounds)
        first = to


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of ``width`` words of one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = total * np.uint64(_BASE) + hashes[at + k]
    return at, mixed(total)
