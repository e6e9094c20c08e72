"""Texts of an Arrow batch as flat numpy arrays: words, their hashes, and numbers per document, without a loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
AS_LOWER = np.arange(256, dtype=np.uint8)
AS_LOWER[65:91] += 32
CODES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def trim() -> None:
    """Gives memory that is free now back to the system: a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of at most ``most`` bytes, or of one longer text; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of several texts: byte spans, the text each is in, and prefix sums that hash any span."""

    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each text: its first word; one more entry at the end
    sums: np.ndarray
    inverse: np.ndarray

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.stop)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words by ASCII white space; with ``lower``, A-Z hash as a-z."""
    n = len(data)
    solid = ~SPACE[data]
    before = np.empty(n, bool)
    before[1:] = solid[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    before[heads] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[:-1] = solid[1:]
    if n:
        after[-1] = False
    after[heads[heads > 0] - 1] = False
    stop = np.flatnonzero(solid & ~after) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(CODES[AS_LOWER[data] if lower else data] * power[:n], out=sums[1:])
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(start, stop, doc, first, sums, inverse)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from each text's first entry to the next text's; they do not depend on the texts before."""
    out = np.zeros(len(first) - 1)
    has = np.diff(first) > 0
    if has.any():
        out[has] = np.add.reduceat(np.asarray(values, float), first[:-1][has])
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
