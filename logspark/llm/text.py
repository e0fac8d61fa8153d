"""Vectorised word, line and shingle hashing over Arrow string buffers.

The functions work on the UTF-8 bytes of many texts at once, so tasks never loop over words.
A word is a maximal run of bytes other than blank and 0x09-0x0D. Nulls count as empty texts.
Hashes are 64 bits wide: a polynomial over the bytes, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit values that depend on ``seed`` only."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed)) | U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n or more."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"], _powers["down"]


@dataclass
class Texts:
    """The bytes of some texts in a row; ``offsets`` has one entry more than there are texts."""

    data: np.ndarray
    offsets: np.ndarray
    lower: bool = False

    def __post_init__(self) -> None:
        if self.lower:
            self.data = _LOWER[self.data]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        solid = ~_SPACE[self.data]
        n = len(solid)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = solid[edge]
        ends[edge - 1] = solid[edge - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    @property
    def starts(self) -> np.ndarray:
        """Byte position at which each word begins."""
        return self._spans[0]

    @property
    def ends(self) -> np.ndarray:
        return self._spans[1]

    @cached_property
    def bounds(self) -> np.ndarray:
        """Position in the words at which each text begins, and the end."""
        return np.searchsorted(self.starts, self.offsets)

    @cached_property
    def owner(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range."""
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])

    @cached_property
    def words(self) -> np.ndarray:
        """Hash of each word."""
        return self.hashes(self.starts, self.ends)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each ``\\n``-split line and its text number; every text has one line at least."""
        breaks = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.offsets, breaks, side="right") - 1
        order = np.lexsort((np.r_[np.full(len(self), -1), breaks], np.r_[np.arange(len(self)), owner]))
        starts = np.r_[self.offsets[:-1], breaks + 1][order]
        owners = np.r_[np.arange(len(self)), owner][order]
        ends = np.empty_like(starts)
        if len(starts):
            last = np.r_[owners[1:] != owners[:-1], True]
            ends[:-1] = starts[1:] - 1
            ends[last] = self.offsets[1:]
        return starts, ends, owners

    def characters(self, positions: np.ndarray) -> np.ndarray:
        """Code points before each byte position, counted over all texts."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=total[1:])
        return total[positions]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``n``-word shingle and the bounds by text.

        A text with fewer words has one shingle, its whole sequence; a text without words has none.
        """
        counts = np.diff(self.bounds)
        made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        bounds = np.r_[0, np.cumsum(made)]
        owner = np.repeat(np.arange(len(self)), made)
        first = self.bounds[owner] + np.arange(bounds[-1]) - bounds[owner]
        size = np.minimum(counts[owner], n)
        padded = np.r_[self.words, np.zeros(n, U64)]
        total = size.astype(U64)
        for j, factor in enumerate(constants(n, 77)):
            part = padded[first + j] * factor
            if j:
                part[size <= j] = 0
            total += part
        return mix(total), bounds


def texts_of(column: pa.Array, lower: bool = False) -> Texts:
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw, offsets - offsets[0], lower)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def unique_in(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs in order, and how often each occurs; owners come in ascending order."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    return owner[at], values[at], np.diff(np.r_[at, len(values)])


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum of each range of ``values``; the largest number for an empty range."""
    out = np.full(len(bounds) - 1, np.iinfo(U64).max, U64)
    some = np.diff(bounds) > 0
    if some.any():
        out[some] = np.minimum.reduceat(values, bounds[:-1][some])
    return out


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as a column of Spark's long type."""
    return pa.array(values.view(np.int64))


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.dtype.itemsize * matrix.shape[1]
    offsets = pa.py_buffer((np.arange(len(matrix) + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(matrix.tobytes())])


def binary_ranges(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Consecutive ranges of an array as binary values."""
    offsets = pa.py_buffer((bounds * data.dtype.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data).tobytes())])
