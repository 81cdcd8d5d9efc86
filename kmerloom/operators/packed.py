"""Copies of k-mers by group, dealt out in few bytes: a row holds what some million bases have of a bucket of k-mers.

K-mers are multiplied by an odd number, which no two share the result of, so that equal ranges of the products hold about equally many; a bucket is such a range. In a row the products stand in order, each as its distance from the one before, in one number with its group as far as that differs in the row, byte by byte of all (so that bytes that are zero cost nothing once they are compressed). What is asked needs equal k-mers to meet, not the k-mers themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kmerloom.operators.kmers import _checked, _windows

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Windows of a bucket, as a power of two; least and most buckets, likewise; rows of a k-mer table that are packed at a time.
WINDOWS, LEAST, MOST, ROWS = 20, 6, 16, 1 << 20
SCHEMA = "bucket int, m int, low long, span long, kv binary, g binary, n binary"


class Layout(NamedTuple):
    """Bits of a k-mer, of a group's number, and of what is left of a k-mer inside its bucket."""

    bits: int
    low: int
    shift: int

    @property
    def joint(self) -> bool:
        """Whether a distance and a group fit into one number."""
        return self.shift + self.low < 63


def layout(k: int, groups: int, bases: int) -> Layout:
    """For `groups` groups, numbered from 0, and about so many windows."""
    return Layout(2 * k, max(1, (groups - 1).bit_length()), 2 * k - min(2 * k, MOST, max(LEAST, (bases >> WINDOWS).bit_length())))


def _order(kv: np.ndarray, g: np.ndarray, lay: Layout) -> np.ndarray:
    return np.argsort(kv << lay.low | g) if lay.bits + lay.low < 64 else np.lexsort((g, kv))


def _bytes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, the lowest of all first, as many as the largest needs."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T[:wide])


def _numbers(data: bytes, m: int) -> np.ndarray:
    have = np.frombuffer(data, np.uint8).reshape(-1, m)
    out = np.zeros((m, 8), np.uint8)
    out[:, : len(have)] = have.T
    return out.view("<i8").ravel()


def squeeze(x: np.ndarray) -> bytes:
    """Numbers from 0 in few bytes, for some thousand of them and more: byte by byte of all, entropy coded."""
    data = _bytes(x)
    return bytes([len(data)]) + pa.compress(data.tobytes(), "zstd", asbytes=True)


def unsqueeze(data: bytes, m: int) -> np.ndarray:
    return _numbers(pa.decompress(data[1:], data[0] * m, "zstd", asbytes=True), m)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])))


def pack(kv: np.ndarray, g: np.ndarray, lay: Layout) -> pa.RecordBatch:
    kv = (kv.astype(np.uint64) * ODD & np.uint64((1 << lay.bits) - 1)).astype(np.int64)
    order = _order(kv, g, lay)
    kv, g = kv[order], g[order]
    new = _starts(kv, g)
    n, kv, g = np.diff(np.append(new, len(kv))), kv[new], g[new]
    bucket = kv >> lay.shift
    first = _starts(bucket)
    step = np.diff(kv, prepend=0)
    step[first] = kv[first] - (bucket[first] << lay.shift)
    cuts = list(zip(first.tolist(), np.append(first[1:], len(kv)).tolist(), strict=True)) if len(kv) else []
    low = np.minimum.reduceat(g, first) if lay.joint and len(kv) else np.zeros(len(first), np.int64)
    span = np.maximum.reduceat(g, first) - low + 1 if lay.joint and len(kv) else np.ones(len(first), np.int64)
    if lay.joint:
        size = np.diff(np.append(first, len(kv)))
        step, g = step * np.repeat(span, size) + (g - np.repeat(low, size)), g[:0]
    steps, counts, more = _bytes(step), _bytes(n), np.maximum.reduceat(n, first) > 1 if len(kv) else n
    columns = [pa.array(bucket[first], pa.int32()), pa.array([b - a for a, b in cuts], pa.int32()), pa.array(low), pa.array(span)]
    columns.append(pa.array([steps[:, a:b].tobytes() for a, b in cuts], pa.binary()))
    groups = None if lay.joint else _bytes(g)
    columns.append(pa.array([b"" if lay.joint else groups[:, a:b].tobytes() for a, b in cuts], pa.binary()))
    # Most k-mers of a row occur once: no bytes stand for that.
    columns.append(pa.array([counts[:, a:b].tobytes() if many else b"" for (a, b), many in zip(cuts, more.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "m", "low", "span", "kv", "g", "n"])


def packed(pieces: DataFrame, columns: list[str], group: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray], lay: Layout, stride: int = 1, scaled: int = 1, least: bool = False, apart: int | None = None) -> DataFrame:
    """Packed rows of the k-mers of pieces (canonical ones if `least`). group: of a batch with the columns named, the rows of windows and their places on the axis, the number of each one's group, below 0 for windows that are left out. apart: windows of different ranges of so many bases are not in one row, so that a row's groups are near each other."""
    _checked(lay.bits // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, place, kv, _ in _windows(batches, lay.bits // 2, stride, scaled, False, least):
            g = group(batch, row, place)
            ends = [*(_starts(place // apart)[1:].tolist() if apart else []), len(place)]
            for a, b in zip([0, *ends], ends, strict=False):
                keep = g[a:b] >= 0
                yield pack(kv[a:b][keep], g[a:b][keep], lay)

    return pieces.select(*dict.fromkeys(["start", "len", *columns, "seq"])).mapInArrow(run, SCHEMA)


def packed_table(table: DataFrame, group: Callable[[pa.RecordBatch], np.ndarray], lay: Layout) -> DataFrame:
    """The same of a table with a k-mer, kv, in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([batch.column("kv").to_numpy(), group(batch)])
            if sum(len(x[0]) for x in held) >= ROWS:
                yield pack(*map(np.concatenate, zip(*held, strict=True)), lay)
                held = []
        if held:
            yield pack(*map(np.concatenate, zip(*held, strict=True)), lay)

    return table.mapInArrow(run, SCHEMA)


def dealt(rows: DataFrame) -> DataFrame:
    """Packed rows by bucket: all of a bucket in one task, one after another."""
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def buckets(batches: Iterator[pa.RecordBatch], lay: Layout) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each bucket k-mer (its product), group and copies, each pair once, in their order."""

    def merged(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kv, g, n = map(np.concatenate, zip(*rows, strict=True))
        rows.clear()
        order = _order(kv, g, lay)
        kv, g, n = kv[order], g[order], n[order]
        new = _starts(kv, g)
        return kv[new], g[new], np.add.reduceat(n, new)

    held, at, size = [], None, 0
    for batch in batches:
        for bucket, m, low, span, kv, g, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "m", "low", "span", "kv", "g", "n")), strict=True):
            if held and bucket != at:
                size = 0
                yield merged(held)
            elif size > 1 << WINDOWS + 2:  # k-mers that are everywhere: their copies are added up before more come
                held = [merged(held)]
                size = -len(held[0][0])
            at, size = bucket, size + m
            step, own = np.divmod(_numbers(kv, m), span) if lay.joint else (_numbers(kv, m), _numbers(g, m))
            held.append((np.cumsum(step) + (bucket << lay.shift), own + low, _numbers(n, m) if n else np.ones(m, np.int64)))
    if held:
        yield merged(held)
