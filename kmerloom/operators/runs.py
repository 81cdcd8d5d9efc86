"""Runs of a query's pieces against an index that every task holds: looked up and put together where the pieces are enumerated, so that no anchor is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kmerloom.model import MatchOptions
from kmerloom.operators.kmers import _checked, _known, _windows

#: Anchors that are put together at a time. A piece that has more is cut.
CHUNK = 1 << 21
RUN = "strand int, qrec long, trec long, diag long, t long, first long, last long, missing long, border boolean"


class Index:
    """The entries of an index by k-mer: kv (distinct, sorted), where the entries of each begin, how many they are, and t and trec of the entries."""

    def __init__(self, kv: np.ndarray, t: np.ndarray, trec: np.ndarray):
        order = np.lexsort((t, kv))
        self.kv, self.begin, self.count = np.unique(kv[order], return_index=True, return_counts=True)
        self.t, self.trec = t[order], trec[order]


def _chunks(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of hits that have about CHUNK entries each."""
    total = np.cumsum(count)
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, "right")))
        yield a, b
        a = b


def _put_together(row: np.ndarray, p: np.ndarray, t: np.ndarray, trec: np.ndarray, options: MatchOptions) -> tuple[np.ndarray, ...]:
    """Row, trec, t, first, last and missing of runs. Anchors of a row come with rising p."""
    diag = p - t
    order = np.lexsort((diag, row))  # stable: p still rises on a diagonal
    row, p, t, trec, diag = row[order], p[order], t[order], trec[order], diag[order]
    gap = p[1:] - p[:-1] - 1
    same = (row[1:] == row[:-1]) & (diag[1:] == diag[:-1]) & (trec[1:] == trec[:-1]) & (gap <= options.max_gap + options.hole)
    begin = np.flatnonzero(np.append(True, ~same))
    end = np.append(begin[1:], len(p)) - 1
    missing = np.add.reduceat(np.append(0, np.where(same, np.maximum(0, gap - options.hole), 0)), begin)
    return row[begin], trec[begin], t[begin], p[begin], p[end], missing


def _runs(shared, options: MatchOptions, q_total: int, q_window: tuple[int, int] | None):
    k, reach = options.k, options.max_gap + options.hole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        known = _known(index.kv)
        for batch, rows, places, kv, rc in _windows(batches, k, 1, 1, True, False):
            start, size, recs, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "len", "rec", "parts"))
            for strand in (0, 1):
                own = rc if strand else kv
                at = np.flatnonzero(known(own))
                p = q_total - places[at] - k if strand else places[at]
                keep = p % options.q_sample == 0
                if q_window:
                    lo, hi = (q_total - q_window[1], q_total - q_window[0]) if strand else q_window
                    keep &= (p >= lo) & (p < hi)
                at, p = at[keep], p[keep]
                entry = np.searchsorted(index.kv, own[at])
                count = index.count[entry]
                for a, b in _chunks(count):
                    # Of each row the places that lie in this chunk; a row that another chunk or piece goes on with is open.
                    first, last, row = start.copy(), start + size - 1, rows[at[a:b]]
                    open_ = parts > 1
                    if a and rows[at[a - 1]] == row[0]:
                        first[row[0]], open_[row[0]] = places[at[a - 1]] + 1, True
                    if b < len(at) and rows[at[b]] == row[-1]:
                        last[row[-1]], open_[row[-1]] = places[at[b - 1]], True
                    n = count[a:b]
                    hit = np.repeat(np.arange(a, b), n)
                    of = np.repeat(index.begin[entry[a:b]] - (np.cumsum(n) - n), n) + np.arange(len(hit))
                    if strand:  # places fall as p rises
                        hit, of = hit[::-1], of[::-1]
                    row, trec, t, lo, hi, missing = _put_together(rows[at[hit]], p[hit], index.t[of], index.trec[of], options)
                    low, high = (q_total - k - last, q_total - k - first) if strand else (first, last)
                    border = open_[row] & ((lo - low[row] <= reach) | (high[row] - hi <= reach))
                    keep = border | (hi - lo + k >= options.least_run)
                    row, trec, t, lo, hi, missing, border = (x[keep] for x in (row, trec, t, lo, hi, missing, border))
                    columns = [pa.array(np.full(len(row), strand, np.int32)), *[pa.array(x, pa.int64()) for x in (recs[row], trec, lo - t, t, lo, hi, missing)], pa.array(border)]
                    yield pa.RecordBatch.from_arrays(columns, names=["strand", "qrec", "trec", "diag", "t", "first", "last", "missing", "border"])

    return run


def piece_runs(index: DataFrame, pieces: DataFrame, options: MatchOptions, q_total: int, q_window: tuple[int, int] | None = None) -> DataFrame:
    """Runs of each piece (RUN) against an index of bounded size, which goes to all tasks. Runs shorter than the least are left out, but for those with `border`: they come so near to where a piece or chunk is cut that another's may go on with them."""
    _checked(options.k)
    held = index.select("kv", "t", "trec").toArrow()
    sent = pieces.sparkSession.sparkContext.broadcast(Index(*[held.column(c).to_numpy() for c in ("kv", "t", "trec")]))
    return pieces.select("rec", "start", "len", "parts", "seq").mapInArrow(_runs(sent, options, q_total, q_window), RUN)
