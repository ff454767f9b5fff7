"""Word kernels over the byte buffers of Arrow string columns.

All words of a slice of rows are found and hashed with a few numpy passes over its bytes; no Python string is made per
word. Slices hold at most SLICE_BYTES of text, or one row, so that temporaries stay small whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_U = np.uint64

#: Bytes of words that white space (space, tab to carriage return) parts.
BY_SPACE = np.ones(256, bool)
BY_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits; bytes of other scripts count as letters.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: Words of letters and digits (1), and of other signs (2).
LETTERS_OR_SIGNS = np.where(ALNUM, 1, np.where(BY_SPACE, 2, 0)).astype(np.uint8)
#: A-Z to a-z, others to themselves.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE_BYTES + 1), _U(base))
        step[0] = 1
        have = np.cumprod(step)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64); changes x."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def large(column) -> pa.LargeStringArray:
    """As one array of strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Its bytes, and the n + 1 offsets of its rows in them."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


@dataclass
class Words:
    """Words of rows first to last - 1: starts and ends in data; those of row i are ptr[i - first] to ptr[i - first + 1]."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    _sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        """The row of each word, counted from first."""
        return np.repeat(np.arange(self.last - self.first), self.counts())

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hashes of the words, or of their first `most` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        n = len(self.data)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + _U(1)) * _power("up", _MULT, n), out=self._sums[1:])
        inverse = _power("down", pow(_MULT, -1, 2**64), n + 1)
        h = (self._sums[ends] - self._sums[self.starts]) * inverse[self.starts]
        h += (ends - self.starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        return mix(h)


def words(column, kind: np.ndarray = BY_SPACE, lower: np.ndarray | None = None, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of all rows of an Arrow string column (nulls are empty), slice by slice.

    kind: a number for each byte; a word is a run of bytes of one number other than 0.
    """
    data, offsets = buffers(large(column))
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
        low, high = int(offsets[first]), int(offsets[last])
        part = data[low:high]
        if lower is not None:
            part = lower[part]
        at = offsets[first : last + 1] - low
        inside = kind[part]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        begins, stops = at[:-1], at[1:]
        full = stops > begins
        before[begins[full]] = 0
        after[stops[full] - 1] = 0
        word = inside != 0
        starts, ends = np.flatnonzero(word & (inside != before)), np.flatnonzero(word & (inside != after)) + 1
        yield Words(first, last, part, starts, ends, np.searchsorted(starts, at))
        first = last


def join_hashes(*parts: np.ndarray) -> np.ndarray:
    """One hash for each row of hashes, by position."""
    out = parts[0].copy()
    for part in parts[1:]:
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += part
    return mix(out)


def shingles(hashes: np.ndarray, ptr: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each row, and their row pointers.

    short: a row of one to k - 1 words has one shingle of all its words.
    """
    counts = np.diff(ptr)
    n = np.maximum(counts - k + 1, 0)
    out_ptr = np.zeros(len(ptr), np.int64)
    if len(hashes) >= k:
        runs = join_hashes(*(hashes[i : len(hashes) - k + 1 + i] for i in range(k)))
        np.cumsum(n, out=out_ptr[1:])
        at = np.repeat(ptr[:-1] - out_ptr[:-1], n) + np.arange(out_ptr[-1])
        runs = runs[at]
    else:
        runs = np.zeros(0, np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < k)) if short else []
    if len(few):
        one = np.array([mix1(int(join_hashes(*(hashes[j : j + 1] for j in range(ptr[i], ptr[i + 1])))[0]) + int(counts[i])) for i in few], np.uint64)
        runs = np.insert(runs, out_ptr[few], one)
        n[few] = 1
        np.cumsum(n, out=out_ptr[1:])
    return runs, out_ptr


def text_slices(batch: pa.RecordBatch, column: str = "text", slice_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or one row."""
    _, offsets = buffers(large(batch.column(column)))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
