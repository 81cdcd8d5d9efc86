"""Words of many texts at once: NumPy over the bytes of an Arrow column, with no loop over words or texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows that a function on Arrow batches handles at a time, where each takes much memory.
ROWS = 512
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are hashed by tables: a random 64-bit number for each byte at each of 64 places.
PLACES = 64
TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, size=PLACES * 256, dtype=np.uint64)
#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Texts lo to hi of a batch: their bytes, and where each starts (and the last ends) in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """A null text counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Slice(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice in order: first and last byte (exclusive), and for each text the number of its first word (and of the last text's end)."""

    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray
    letters: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.begins):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.begins
        starts = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=starts[1:])
        place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(starts, lengths)
        values = TABLE[((place & (PLACES - 1)) << 8) | self.data[self.letters]]
        if int(lengths.max()) > PLACES:
            values = values * (2 * (place // PLACES) + 1).astype(np.uint64)
        return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words(s: Slice, lower: bool = True) -> Words:
    """Runs of bytes that are not white space; a text's end ends a run. With `lower`, A-Z count as a-z."""
    data = LOWER[s.data] if lower else s.data
    n = len(data)
    ink = ~SPACE[data]
    new = np.zeros(n + 1, bool)
    new[s.offsets] = True
    opens, closes = ink.copy(), ink.copy()
    opens[1:] &= ~ink[:-1] | new[1:n]
    closes[:-1] &= ~ink[1:] | new[1:n]
    begins = np.flatnonzero(opens)
    return Words(begins, np.flatnonzero(closes) + 1, np.searchsorted(begins, s.offsets), data, np.flatnonzero(ink))


def parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return free memory to the system at a partition's end: workers are kept, and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
