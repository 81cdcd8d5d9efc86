"""Interval joins on catalogs: places to records, bands in a range, annotations on an axis, and jumps to where a region maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.model import EngineError
from kmerloom.plans.ordering import with_group

#: Width of the bins that turn an interval join into an equi-join.
BIN = 1 << 16


def bins(start: Column, end: Column, width: int = BIN) -> Column:
    """The bins that a half-open interval touches."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width))


def overlap_join(left: DataFrame, right: DataFrame, on: tuple[str, ...] = (), width: int = BIN) -> DataFrame:
    """Pairs of rows whose intervals (l0, l1) and (r0, r1) overlap, with equal columns `on`: an equi-join on bins, each pair in the bin of its first common base only."""
    a = left.withColumn("__bin", F.explode(bins(F.col("l0"), F.col("l1"), width)))
    b = right.withColumn("__bin", F.explode(bins(F.col("r0"), F.col("r1"), width)))
    pairs = a.join(b, [*on, "__bin"]).filter((F.col("l0") < F.col("r1")) & (F.col("r0") < F.col("l1")))
    return pairs.filter(F.col("__bin") == F.floor(F.greatest("l0", "r0") / width)).drop("__bin")


def locate(points: DataFrame, catalog: DataFrame, at: str = "g") -> DataFrame:
    """Records of places on an axis: the columns of `points`, rec, name, local and shown (local plus the record's offset); null outside. Records without bases hold no place."""
    # Records don't overlap, so a place has one record at most, and the bin of a place has a row for each record that touches it.
    right = catalog.filter("end > start").select("rec", "name", F.col("start").alias("__r0"), F.col("end").alias("__r1"), F.col("offset").alias("__offset")).withColumn("__bin", F.explode(bins(F.col("__r0"), F.col("__r1"))))
    here = (F.floor(F.col(at) / BIN) == F.col("__bin")) & (F.col(at) >= F.col("__r0")) & (F.col(at) < F.col("__r1"))
    local = F.col(at) - F.col("__r0")
    return points.join(right, here, "left").select(*points.columns, "rec", "name", local.alias("local"), (local + F.col("__offset")).alias("shown"))


def bands(catalog: DataFrame, w0: float, w1: float) -> DataFrame:
    """Records that a range of the axis touches."""
    return catalog.filter((F.col("end") > w0) & (F.col("start") < w1))


def resolve_names(names: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """names with chrom: the catalog's name for it, as it stands, without an arm's p or q, or up to the first underscore; the first that the other side knows. catalog: one column, chrom."""
    known = catalog.select("chrom").distinct()
    ways = [F.col(name), F.regexp_replace(F.col(name), "[pq]$", ""), F.split_part(F.col(name), F.lit("_"), F.lit(1))]
    out = names
    for i, way in enumerate(ways):
        out = out.join(known.select(F.col("chrom").alias(f"__c{i}")), way == F.col(f"__c{i}"), "left")
    return out.withColumn("chrom", F.coalesce(*[f"__c{i}" for i in range(len(ways))])).drop(*[f"__c{i}" for i in range(len(ways))])


def annotate(items: DataFrame, visible: DataFrame) -> DataFrame:
    """BED items on visible records, clipped: rec, w0, w1 (on the axis), item_name, strand, rgb. Items that occur twice (by start, end and name) count once."""
    named = resolve_names(visible, items).filter(F.col("chrom").isNotNull())
    left = named.select("rec", "chrom", F.col("start").alias("axis0"), "offset", F.col("offset").alias("l0"), (F.col("offset") + F.col("end") - F.col("start")).alias("l1"))
    right = items.dropDuplicates(["chrom", "start", "end", "name"]).select("chrom", F.col("start").alias("r0"), F.col("end").alias("r1"), F.col("name").alias("item_name"), "strand", "rgb")
    shift = F.col("axis0") - F.col("offset")
    return overlap_join(left, right, ("chrom",)).select("rec", (F.greatest("l0", "r0") + shift).alias("w0"), (F.least("l1", "r1") + shift).alias("w1"), "item_name", "strand", "rgb")


def lane_rects(lane: DataFrame, w0: float, w1: float, px: float, colored: bool = False, accent: str = "accent") -> DataFrame:
    """a and b (pixels), fill, item_name and strand of what a view of w0 to w1 on px pixels shows of each lane item; slivers under three quarters of a pixel are not drawn."""
    scale = px / max(w1 - w0, 1e-9)
    a, b = F.greatest(F.lit(0.0), (F.greatest(F.col("w0"), F.lit(float(w0))) - w0) * scale), F.least(F.lit(float(px)), (F.least(F.col("w1"), F.lit(float(w1))) - w0) * scale)
    fill = F.when(F.lit(colored) & F.col("rgb").isNotNull(), F.concat(F.lit("rgb("), "rgb", F.lit(")"))).otherwise(accent)
    return lane.select(a.alias("a"), b.alias("b"), fill.alias("fill"), "item_name", "strand").filter(F.col("b") - F.col("a") >= 0.75)


def boundary_lines(catalog: DataFrame, w0: float, w1: float, px: float) -> DataFrame:
    """g, where a record begins, for the records that a range touches, all but the axis's first; none if there are so many that one has six pixels or less."""
    seen = bands(catalog, w0, w1)
    if px / max(1, seen.count()) <= 6:
        return seen.filter(F.lit(False)).select(F.col("start").alias("g"))
    return seen.filter("rec > 0").select(F.col("start").alias("g"))


def hit(lane: DataFrame, world: float) -> DataFrame:
    """The first lane item at a place."""
    return lane.filter((F.col("w0") <= world) & (F.col("w1") > world)).orderBy("w0", "item_name").limit(1)


def cluster(intervals: DataFrame, gap: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Intervals a, b of weight w in clusters: a new one begins where an interval starts more than `gap` after all before it end. Adds `place`, by weight."""
    out = with_group(intervals, "a", "b", gap, keys, "cluster").groupBy(*keys, "cluster").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("w").alias("w"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*(keys or (F.lit(0),))).orderBy(F.desc("w"), "a"))).drop("cluster")


def clipped(segments: DataFrame, x0: float, x1: float, least: float) -> DataFrame:
    """Query-side intervals of what the x-range shows of segments that have `least` bases, along their direction."""
    at = lambda edge: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(float(edge)) - F.col("x")) / F.col("dx")))
    t0, t1 = at(x0), at(x1)
    y = lambda t: F.col("y") + F.when(F.col("strand") == 1, 1 - t).otherwise(t) * F.col("dy")
    near = segments.filter((F.col("dx") >= least) & (F.col("x") + F.col("dx") >= x0) & (F.col("x") <= x1))
    return near.select(F.least(y(t0), y(t1)).alias("a"), F.greatest(y(t0), y(t1)).alias("b"), ((t1 - t0) * F.col("dx")).alias("w"))


def jump(segments: DataFrame, x0: float, x1: float, q_total: int) -> DataFrame:
    """Where a target range maps on the query axis: clusters a, b, w and place, the heaviest first. Segments below a hundredth of the range count only if there are no others."""
    span = x1 - x0
    found = clipped(segments, x0, x1, span * 0.01)
    if not found.limit(1).count():
        found = clipped(segments, x0, x1, 0)
    return cluster(found, max(3 * span, min(2e6, q_total * 0.05)))


def arm_ranges(cytobands: DataFrame, sizes: DataFrame) -> DataFrame:
    """chrom, p_end and q_start from cytobands (chrom, start, end, band): p reaches from 0 to its last band's end, q from its first band to the size."""
    p, q = F.col("band").startswith("p"), F.col("band").startswith("q")
    arms = cytobands.groupBy("chrom").agg(F.max(F.when(p, F.col("end"))).alias("p_end"), F.min(F.when(q, F.col("start"))).alias("q_start"))
    return arms.join(sizes, "chrom").select("chrom", "p_end", "q_start", "size")


def check_windows(total_bp: int, confirm: bool = False, most: int = 1_000_000_000, ask: int = 300_000_000) -> None:
    """Regions asked for: 1 Gb at most, 300 Mb without being confirmed."""
    if total_bp > most or (total_bp > ask and not confirm):
        raise EngineError(f"{total_bp:,} bases are asked for.", {"confirm": True} if total_bp <= most else {})
