"""Matches of a query axis on a target axis, both strands: an equi-join on k-mers, then neighbouring anchors of a diagonal merged into runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.model import SEGMENT_WALL_HARD, EngineError, MatchOptions
from kmerloom.operators.kmers import kmers, spread, total_length
from kmerloom.operators.runs import piece_runs
from kmerloom.plans.tables import stored

#: Starts of a range in which the anchors of a diagonal are put together; rows of an index that may be sent to all tasks (some 30 MB).
RANGE, BROADCAST_ROWS = 1 << 20, 400_000


def occurrence_cap(index: DataFrame, cap: int | None) -> DataFrame:
    """Index entries whose k-mer has at most `cap` of them. Counted before the join, so a repeat never multiplies. The k-mers above the cap are the few: entries are held against those."""
    if cap is None:
        return index
    many = index.groupBy("kv").count().filter(F.col("count") > cap).select("kv")
    return index.join(many, "kv", "left_anti")


def probes(query: DataFrame, options: MatchOptions, q_total: int, window: tuple[int, int] | None = None) -> DataFrame:
    """Query k-mers of both strands: qrec, strand, p (place in the strand's own direction), kv. Sampling counts places of that direction, also on the reverse strand.

    window: k-mer starts in the strand's own direction. For the reverse strand that are forward starts from lo-k+1 to hi-k: the two strands differ.
    """
    both = kmers(query, options.k, both=True)
    strands = both.select("rec", F.explode(F.array(
        F.struct(F.lit(0).alias("strand"), F.col("pos").alias("p"), F.col("kv").alias("kv")),
        F.struct(F.lit(1).alias("strand"), (F.lit(q_total) - F.col("pos") - options.k).alias("p"), F.col("rc").alias("kv")),
    )).alias("s")).select(F.col("rec").alias("qrec"), "s.*")
    if options.q_sample > 1:
        strands = strands.filter(F.col("p") % options.q_sample == 0)
    if window:
        lo, hi = window
        strands = strands.filter(F.when(F.col("strand") == 0, (F.col("p") >= lo) & (F.col("p") < hi)).otherwise((F.col("p") >= q_total - hi) & (F.col("p") < q_total - lo)))
    return strands


def target_index(target: DataFrame, options: MatchOptions) -> DataFrame:
    """trec, t, kv of a target axis."""
    return kmers(target, options.k, options.stride).select(F.col("rec").alias("trec"), F.col("pos").alias("t"), "kv")


def stored_index(target: DataFrame, options: MatchOptions) -> DataFrame:
    """The index of a target axis, enumerated once: it is stored and counted."""
    index = stored(target_index(target, options), "index")
    index._kmerloom_rows = index.count()
    return index


def anchors(index: DataFrame, query: DataFrame, options: MatchOptions, q_total: int, t_window: tuple[int, int] | None = None, q_window: tuple[int, int] | None = None) -> DataFrame:
    """strand, qrec, trec, p, t: one row for each pair of equal k-mers of the index and the query axis. An index that was counted (stored_index) and has few rows goes to the probes, which then aren't shuffled."""
    if t_window:
        index = index.filter((F.col("t") >= t_window[0]) & (F.col("t") < t_window[1]))
    known = occurrence_cap(index, options.cap)
    if getattr(index, "_kmerloom_rows", BROADCAST_ROWS + 1) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return probes(query, options, q_total, q_window).join(known, "kv").select("strand", "qrec", "trec", "p", "t")


def _runs(rows: DataFrame, keys: list[str], first: str, last: str, missing: Column, options: MatchOptions) -> DataFrame:
    """Stretches first..last of each key put together where at most max_gap starts lie between, in the order of `first`; `run` counts from 1."""
    order = Window.partitionBy(*keys).orderBy(first)
    gap = F.col(first) - F.lag(last).over(order) - 1
    breaks = F.col("__gap").isNull() | (F.col("__gap") > options.max_gap + options.hole)
    rows = rows.withColumn("__gap", gap).withColumns({"run": F.sum(F.when(breaks, 1).otherwise(0)).over(order), "__missing": missing + F.when(breaks, 0).otherwise(F.greatest(F.lit(0), F.col("__gap") - options.hole))})
    return rows.groupBy(*keys, "run").agg(F.min("t").alias("t"), F.min(first).alias("first"), F.max(last).alias("last"), F.sum("__missing").cast("long").alias("missing"))


def merge_runs(found: DataFrame, options: MatchOptions, q_total: int) -> DataFrame:
    """Runs: on one diagonal of one pair of records an anchor goes on with the run if at most max_gap starts are missing between, those that sampling leaves out not counted. The gap is in k-mer starts: one substitution costs k of them.

    A diagonal may hold as many anchors as a record has bases, so runs are formed in ranges of RANGE starts first. A run may go on in another range only if it comes as near to the range's border as a gap may be wide: these alone, of many runs a few, are put together by diagonal. The runs are stored in between, so they are formed once.
    """
    line, reach = ["strand", "qrec", "trec", "diag"], options.max_gap + options.hole
    rows = found.withColumns({"diag": F.col("p") - F.col("t"), "part": F.floor(F.col("p") / RANGE)})
    runs = stored(_runs(rows, [*line, "part"], "p", "p", F.lit(0), options).drop("run"), "runs")
    border = (F.col("first") - F.col("part") * RANGE <= reach) | ((F.col("part") + 1) * RANGE - 1 - F.col("last") <= reach)
    return _joined(runs, border, options, q_total)


def _joined(runs: DataFrame, border: Column, options: MatchOptions, q_total: int) -> DataFrame:
    """Segments of runs, those with `border` put together by diagonal first."""
    k, line = options.k, ["strand", "qrec", "trec", "diag"]
    near = _runs(runs.filter(border), line, "first", "last", F.col("missing"), options)
    columns = [*line, "t", "first", "last", "missing"]
    runs = runs.filter(~border).select(columns).unionByName(near.select(columns))
    length = F.col("last") - F.col("first") + k
    y = F.when(F.col("strand") == 0, F.col("first")).otherwise(F.lit(q_total) - F.col("last") - k)
    runs = runs.select(F.col("t").alias("x"), y.cast("long").alias("y"), length.cast("long").alias("dx"), length.cast("long").alias("dy"), "strand", "qrec", "trec", F.col("missing").alias("gap_bases"), ((length - F.col("missing")) / length).alias("identity"))
    return runs.filter(F.col("dx") >= options.least_run)


def match(target: DataFrame, query: DataFrame, options: MatchOptions = MatchOptions(), t_window: tuple[int, int] | None = None, q_window: tuple[int, int] | None = None) -> DataFrame:
    """Segments of two axes. A self comparison is match(axis, axis): the diagonal and both mirror images stay.

    An index of few rows goes to all tasks, which put runs together where they enumerate the query: no anchor is a row, and only runs at the borders of pieces are shuffled. With a larger one anchors are joined.

    Windows are in starts of k-mers. Only pieces that a window touches are enumerated: of the query those for the forward strand's starts and, up to k-1 before them, the reverse strand's.
    """
    q_total = total_length(query)
    index = stored_index(spread(target, window=t_window), options)
    probed = spread(query, window=(q_window[0] - options.k + 1, q_window[1]) if q_window else None)
    if index._kmerloom_rows <= BROADCAST_ROWS:
        if t_window:
            index = index.filter((F.col("t") >= t_window[0]) & (F.col("t") < t_window[1]))
        runs = stored(piece_runs(occurrence_cap(index, options.cap), probed, options, q_total, q_window), "runs")
        return _joined(runs, F.col("border"), options, q_total)
    return merge_runs(anchors(index, probed, options, q_total, t_window, q_window), options, q_total)


def guarded(segments: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """The segments, or an error with remedies if there are more than the wall. They are counted, so they should be stored."""
    wall = min(options.max_segments, SEGMENT_WALL_HARD)
    if segments.count() > wall:
        raise EngineError(f"Too many segments: more than {wall:,}.", {"min_run": max(300, 2 * options.min_run), "q_sample": 4, "max_segments": min(2 * wall, SEGMENT_WALL_HARD)})
    return segments


def inside(window: tuple[int, int, int, int]):
    """A segment lies wholly within x0..x1 and y0..y1."""
    x0, x1, y0, y1 = window
    return (F.col("x") >= x0) & (F.col("x") + F.col("dx") <= x1) & (F.col("y") >= y0) & (F.col("y") + F.col("dy") <= y1)


def refine(old: DataFrame, new: DataFrame, window: tuple[int, int, int, int]) -> DataFrame:
    """Put new segments in the place of those that lie inside the window; 100 bases on each side at least."""
    x0, x1, y0, y1 = window
    if min(x1 - x0, y1 - y0) < 100:
        raise EngineError("The window is too small: 100 bases on each side are needed.")
    return old.filter(~inside(window)).unionByName(new)
