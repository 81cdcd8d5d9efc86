"""Groups that share k-mers, in one shuffle: rows are dealt out and sorted by k-mer, and each task adds up pairs of groups in a table of its own as the k-mers stream by.

A task's table has a cell for each pair of groups and each sum, CELLS at most (64 MB): 2,048 groups for two sums. With more groups than that the pairs are for a join (belongs.belongs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.model import EngineError
from kmerloom.operators import packed

#: Cells of a task's table, and rows that are paired at a time.
CELLS, CHUNK = 1 << 23, 1 << 18
SUMS = ("total", "shared", "exclusive", "unique", "cross_mass")


def fits(groups: int, sums: tuple[str, ...] = SUMS) -> bool:
    return groups * groups * len(sums) <= CELLS


class Table:
    """Sums of pairs of groups. first: pairs are of one of the first groups with one of the others; without it, of any two."""

    def __init__(self, groups: int, first: int | None, sums: tuple[str, ...]):
        self.groups, self.first, self.out = groups, first, {s: np.zeros(groups * groups, np.int64) for s in sums}

    def add(self, name: str, at: np.ndarray, value: np.ndarray | int) -> None:
        if name in self.out:
            np.add.at(self.out[name], at, value)

    def pair(self, kv: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        """Adds k-mers with all their rows, in order of k-mer and group; rows of one group are added up."""
        if not len(kv):
            return
        groups, first, add = self.groups, self.first, self.add
        new = np.flatnonzero(np.append(True, (kv[1:] != kv[:-1]) | (g[1:] != g[:-1])))
        kv, g, n = kv[new], g[new], np.add.reduceat(n, new)
        begin = np.flatnonzero(np.append(True, kv[1:] != kv[:-1]))
        size = np.diff(np.append(begin, len(kv)))
        add("total", g * (groups + 1), n)
        add("unique", (g * (groups + 1))[n == 1], 1)
        holders = np.repeat(size, size)
        after = np.repeat(begin + size, size) - np.arange(len(kv)) - 1  # rows of the same k-mer that follow
        at, step = np.flatnonzero(after > 0), 1
        while len(at):
            kept = at if first is None else at[(g[at] < first) & (g[at + step] >= first)]
            i, j, a, b = g[kept], g[kept + step], n[kept], n[kept + step]
            less = np.minimum(a, b)
            add("shared", i * groups + j, less)
            if "exclusive" in self.out:
                two = holders[kept] == 2
                add("exclusive", (i * groups + j)[two], less[two])
            for x, y, own in ((i, j, a), (j, i, b)):
                if "unique" in self.out:
                    add("unique", (x * groups + y)[own == 1], 1)
                add("cross_mass", x * groups + y, own)
            step += 1
            at = at[after[at] >= step]

    def rows(self) -> pa.RecordBatch:
        hit = np.flatnonzero(sum(np.abs(x) for x in self.out.values()))
        return pa.RecordBatch.from_arrays([pa.array(hit // self.groups), pa.array(hit % self.groups), *[pa.array(x[hit]) for x in self.out.values()]], names=["i", "j", *self.out])


def _pairs(groups: int, first: int | None, sums: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(groups, first, sums)
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("kv", "g", "n")])
            rows += batch.num_rows
            if rows >= CHUNK:
                kv, g, n = (np.concatenate(x) for x in zip(*held, strict=True))
                # The last k-mer may go on in the next batch.
                cut = int(np.searchsorted(kv, kv[-1]))
                table.pair(kv[:cut], g[:cut], n[:cut])
                kv, g, n = kv[cut:], g[cut:], n[cut:]
                if len(kv) >= CHUNK:  # a k-mer that fills a chunk: its rows of one group are added up
                    new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                    kv, g, n = kv[new], g[new], np.add.reduceat(n, new)
                held, rows = [[kv, g, n]], len(kv)
        if held:
            table.pair(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield table.rows()

    return run


def _packed_pairs(lay: packed.Layout, groups: int, first: int | None, sums: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(groups, first, sums)
        for kv, g, n in packed.buckets(batches, lay):
            lo = 0
            while lo < len(kv):
                # A chunk ends with a k-mer.
                hi = len(kv) if lo + CHUNK >= len(kv) else max(int(np.searchsorted(kv, kv[lo + CHUNK])), int(np.searchsorted(kv, kv[lo], "right")))
                table.pair(kv[lo:hi], g[lo:hi], n[lo:hi])
                lo = hi
        yield table.rows()

    return run


def pair_sums(rows: DataFrame, groups: int, first: int | None = None, sums: tuple[str, ...] = SUMS) -> DataFrame:
    """i, j and sums over k-mers that both groups have. rows: kv, g (from 0) and n, copies; rows of one k-mer and group are added up.

    i = j: total, all copies, and unique, k-mers that it has once. i < j: shared, the lesser copies, and exclusive, the same of k-mers that no third group has. i and j in either order: unique, k-mers that i has once, and cross_mass, i's copies.
    """
    if not fits(groups, sums):
        raise EngineError(f"{groups:,} groups are too many for a table of pairs.")
    dealt = rows.select("kv", F.col("g").cast("long").alias("g"), "n").repartition("kv").sortWithinPartitions("kv", "g")
    each = dealt.mapInArrow(_pairs(groups, first, sums), "i long, j long, " + ", ".join(f"{s} long" for s in sums))
    return each.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])


def packed_sums(rows: DataFrame, lay: packed.Layout, groups: int, first: int | None = None, sums: tuple[str, ...] = SUMS) -> DataFrame:
    """pair_sums() of packed rows."""
    if not fits(groups, sums):
        raise EngineError(f"{groups:,} groups are too many for a table of pairs.")
    each = packed.dealt(rows).mapInArrow(_packed_pairs(lay, groups, first, sums), "i long, j long, " + ", ".join(f"{s} long" for s in sums))
    return each.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
