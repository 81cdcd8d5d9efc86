"""Totals and distributions of segments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.formatting import format_bp_column
from kmerloom.operators.intervals import locate

#: Rungs of a ladder, and the least lengths that a dense result may be shown from.
RUNGS = (1, 2, 5)
DENSE, DENSE_SHOWN, DENSE_LENGTHS = 2_000_000, 500_000, (100, 500, 2_000, 10_000, 50_000)


def segment_totals(segments: DataFrame) -> DataFrame:
    """strand, n and bp."""
    return segments.groupBy("strand").agg(F.count(F.lit(1)).alias("n"), F.sum("dx").cast("long").alias("bp"))


def described(segments: DataFrame, target: DataFrame, query: DataFrame) -> DataFrame:
    """The segments with labels of where they lie: target and query (`name : first–last`, or `name:first → other:last` over several records; 1-based, with the records' offsets; ? outside), direction, length and percent."""
    out = segments
    for side, at, size, catalog in (("target", "x", "dx", target), ("query", "y", "dy", query)):
        total = catalog.agg(F.max("end")).first()[0] or 0
        for end, place in (("0", F.col(at)), ("1", F.least(F.col(at) + F.col(size) - 1, F.lit(total - 1)))):
            out = locate(out.withColumn("__g", place), catalog, "__g").withColumnsRenamed({"name": f"__n{end}", "shown": f"__s{end}"}).drop("__g", "rec", "local")
        first, last = (F.format_number(F.col(f"__s{i}") + 1, 0) for i in "01")
        one = F.concat("__n0", F.lit(" : "), first, F.lit("–"), last)
        two = F.concat("__n0", F.lit(":"), first, F.lit(" → "), "__n1", F.lit(":"), last)
        out = out.withColumn(side, F.when(F.col("__n0").isNull() | F.col("__n1").isNull(), "?").when(F.col("__n0") == F.col("__n1"), one).otherwise(two)).drop("__n0", "__n1", "__s0", "__s1")
    percent = F.when(F.col("identity") >= 0.999, F.format_string("%.0f%%", 100 * F.col("identity"))).otherwise(F.format_string("%.1f%%", 100 * F.col("identity")))
    return out.withColumns({"direction": F.when(F.col("strand") == 1, "reverse").otherwise("forward"), "length": format_bp_column(F.col("dx").cast("double")), "percent": percent})


def ladder(lo: float, hi: float) -> list[int]:
    """Upper edges 1, 2, 5, 10, ... from the first not below lo to the first not below hi."""
    lo = max(1, lo)
    power, edges = 10 ** math.floor(math.log10(lo)), []
    while True:
        for rung in RUNGS:
            if (v := power * rung) >= lo:
                edges.append(v)
                if v >= hi:
                    return edges
        power *= 10


def length_distribution(segments: DataFrame) -> DataFrame:
    """edge, strand, n: segments up to each edge of the ladder between the least and the greatest length. Edges follow from the length alone: the ladder's rung that is not below it."""
    dx = F.col("dx").cast("double")
    power = F.pow(F.lit(10.0), F.floor(F.log10(dx)))
    edge = F.when(dx <= power, power).when(dx <= 2 * power, 2 * power).when(dx <= 5 * power, 5 * power).otherwise(10 * power)
    return segments.groupBy(F.round(edge).cast("long").alias("edge"), "strand").agg(F.count(F.lit(1)).alias("n"))


def identity_bins(least: float) -> tuple[float, int]:
    """Lower end and number of bins of identities down to `least`."""
    lo = min(0.99, math.floor(least * 100) / 100)
    return lo, max(8, min(40, math.floor((1 - lo) * 100 + 0.5) * 2))


def identity_distribution(segments: DataFrame) -> DataFrame:
    """bin, strand, n: identities in even bins from the least (to the hundredth, 0.99 at most) to 1."""
    least = segments.agg(F.min("identity")).first()[0]
    lo, n = identity_bins(1.0 if least is None else least)
    at = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col("identity") - lo) / ((1 - lo) / n)).cast("int")))
    return segments.groupBy(at.alias("bin"), "strand").agg(F.count(F.lit(1)).alias("n"))


def identity_floor(least: float) -> float:
    """Where an identity scale begins."""
    return 0.9 if least >= 0.999 else math.floor(least * 100) / 100


def dense_length(segments: DataFrame, dense: int = DENSE, shown: int = DENSE_SHOWN) -> int | None:
    """For more than `dense` segments the least length of the choices that leaves `shown` at most, or the last; else none. One pass counts all choices exactly, so nothing is sampled."""
    row = segments.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("dx") >= c).alias(f"n{c}") for c in DENSE_LENGTHS]).first()
    if row["n"] <= dense:
        return None
    return next((c for c in DENSE_LENGTHS if row[f"n{c}"] <= shown), DENSE_LENGTHS[-1])


def composition(spectrum: DataFrame, cap: int | None) -> DataFrame:
    """One row: distinct k-mers, windows, and the share of windows of k-mers above the cap (classes end at 1024)."""
    windows = F.col("occ_count") * F.col("cls").cast("double")
    over = F.lit(False) if cap is None else F.col("cls") > cap
    return spectrum.agg(F.sum("occ_count").alias("distinct_kmers"), F.sum(windows).alias("windows"), (F.sum(F.when(over, windows).otherwise(0.0)) / F.sum(windows)).alias("capped_share"))
