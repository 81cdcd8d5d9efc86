"""A comparison from start to end: density, cutoff and cost are settled from the data first, then the plan is built.

The target's index is made once, dealt out by k-mer and kept on the executors' disks: the spectrum, the saturated intervals and the matches read it there, and none of them shuffles it again. Lost parts are made anew.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.model import ANCHOR_BUDGET, SATURATION_TILE, MatchOptions
from kmerloom.operators import match, profile
from kmerloom.operators.kmers import spread, total_length
from kmerloom.plans import density
from kmerloom.plans.index_store import kept_index


@dataclass
class Comparison:
    """Segments and what was settled: effective options, expected anchors, notes, saturated intervals and the spectrum. close() frees what is kept on disk."""

    segments: DataFrame
    options: MatchOptions
    anchors: float
    notes: list[str]
    saturated: DataFrame
    spectrum: DataFrame
    index: DataFrame

    def close(self) -> None:
        for df in (self.segments, self.index):
            df.unpersist()


def run_notes(options: MatchOptions, stride: int, q_sample: int, cutoff: float | None, t_len: int, saturated_bp: int, warnings: DataFrame | None = None) -> list[str]:
    """What a reader of the result should know: warnings of the parsers, sampling, a lowered cutoff, a cap that a strided index can only keep roughly, and repeats that were not searched."""
    notes = [f"{r['count']} records: {r['kind']}" for r in warnings.groupBy("kind").count().orderBy("kind").collect()] if warnings is not None else []
    own = replace(options, stride=stride, q_sample=q_sample)
    if stride > 1 or q_sample > 1:
        notes.append(f"sampled: 1 in {stride} target and 1 in {q_sample} query starts")
    if cutoff is not None and own.cap is not None and cutoff < own.cap:
        notes.append(f"repeat cutoff lowered from {own.cap} to {cutoff:g} to stay in the anchor budget")
    elif stride > 1 and own.cap is not None and own.cap * stride != options.max_occ:
        notes.append(f"the occurrence cap {options.max_occ} counts as {own.cap * stride}: the index holds 1 in {stride} starts")
    if saturated_bp > 0.01 * t_len:
        notes.append(f"{100 * saturated_bp / t_len:.0f}% of the target are repeats above the cutoff, which were not searched")
    return notes


def compare(target: DataFrame, query: DataFrame, options: MatchOptions = MatchOptions(max_gap=64), sample: str | int = "auto", budget: float | None = 1.0, exact_bp: int | None = None, confirm: bool = False, warnings: DataFrame | None = None, keep: str | None = None) -> Comparison:
    """Compare two axes. budget: multiple of the anchor budget, None for none; sample: see pick_density; warnings: of the sources (fasta.warnings), for the notes; keep: a shared folder in which the target's index stays for later comparisons (index_store). More segments than the wall are an error with remedies."""
    t_len, q_len = total_length(target), total_length(query)
    stride, q_sample = density.pick_density(sample, options.stride, t_len, q_len, exact_bp)
    asked, options = options, replace(options, stride=stride, q_sample=q_sample)
    index = kept_index(target, options, keep) if keep else match.target_index(spread(target), options).repartition("kv").persist(StorageLevel.DISK_ONLY)
    spectrum = profile.spectrum(index)
    _, sumsq = density.histogram(spectrum)
    scale = density.anchor_scale(q_len, t_len, stride, q_sample)
    cutoff = density.pick_cutoff(sumsq, scale, options.cap, float("inf") if budget is None else budget * ANCHOR_BUDGET)
    anchors = density.estimate_anchors(sumsq, float("inf") if cutoff is None else cutoff, scale)
    density.check_volume(anchors, t_len, q_len, confirm)
    effective = replace(options, max_occ=None if cutoff is None else int(cutoff) * stride)
    tiles = index.groupBy("kv", F.floor(F.col("t") / SATURATION_TILE).alias("tile")).agg(F.count(F.lit(1)).alias("n"))
    hot = profile.saturated(tiles, t_len, int(cutoff) if cutoff is not None else 1 << 62)
    hot_bp = hot.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()[0]
    notes = run_notes(asked, stride, q_sample, cutoff, t_len, hot_bp, warnings)
    segments = match.merge_runs(match.anchors(index, spread(query), effective, q_len), effective, q_len).persist(StorageLevel.DISK_ONLY)
    try:
        match.guarded(segments, effective)
    except Exception:
        segments.unpersist()
        index.unpersist()
        raise
    return Comparison(segments, effective, anchors, notes, hot, spectrum, index)
