"""Segments as cells of a grid, and what is near a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.plans.tables import stored

#: Sides of a grid of segments, and its most entries.
SIDE_LEAST, SIDE_MOST, MOST_ENTRIES = 64, 1024, 16_000_000
#: Segments of a cell from which narrower cells are tried first, and points of a width that are sent to all tasks instead of shuffling the segments.
BUSY, FEW = 256, 50_000


def endpoints(df: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 along the strand's direction."""
    forward = F.col("strand") == 0
    return df.withColumns({"x0": F.col("x"), "y0": F.when(forward, F.col("y")).otherwise(F.col("y") + F.col("dy")), "x1": F.col("x") + F.col("dx"), "y1": F.when(forward, F.col("y") + F.col("dy")).otherwise(F.col("y"))})


def visible(identity_least: float = 0.0, length_least: float = 0.0, forward: bool = True, reverse: bool = True) -> Column:
    shown = F.when(F.col("strand") == 0, F.lit(forward)).otherwise(F.lit(reverse))
    return shown & (F.col("identity") + 1e-6 >= identity_least) & (F.col("dx") + 0.5 >= length_least)


def in_rect(x0: float, x1: float, y0: float, y1: float) -> Column:
    """A segment's box meets a rectangle: no index is needed, the predicate goes to the scan."""
    return (F.col("x") < x1) & (F.col("x") + F.col("dx") > x0) & (F.col("y") < y1) & (F.col("y") + F.col("dy") > y0)


def identity_heatmap(segments: DataFrame, bounds: tuple[float, float, float, float], nx: int, ny: int, forward: bool = True, reverse: bool = True) -> DataFrame:
    """cx, cy and v, the best identity of segments that cross the cell; cells that none crosses have no row.

    Segments are clipped to the grid before they are walked, so a long one costs as many steps as it has cells in view.
    """
    bx0, bx1, by0, by1 = (float(b) for b in bounds)
    fx, fy = nx / max(bx1 - bx0, 1e-9), ny / max(by1 - by0, 1e-9)
    rows = endpoints(segments.filter(visible(0, 0, forward, reverse) & in_rect(bx0, bx1, by0, by1)))
    rows = rows.select("identity", *[((F.col(c) - b) * f).alias(a) for c, b, f, a in (("x0", bx0, fx, "ax"), ("y0", by0, fy, "ay"), ("x1", bx0, fx, "ex"), ("y1", by0, fy, "ey"))])
    rows = rows.withColumns({"dx": F.col("ex") - F.col("ax"), "dy": F.col("ey") - F.col("ay")})

    def enter_leave(a: str, d: str, n: int) -> tuple[Column, Column, Column]:
        """The parameters at which a line is inside 0..n on one axis; whether a line that does not move there is."""
        lo, hi = -F.col(a) / F.col(d), (F.lit(float(n)) - F.col(a)) / F.col(d)
        still = F.col(d) == 0
        return F.when(still, 0.0).otherwise(F.least(lo, hi)), F.when(still, 1.0).otherwise(F.greatest(lo, hi)), ~still | ((F.col(a) >= 0) & (F.col(a) <= n))

    (ix, ox, okx), (iy, oy, oky) = enter_leave("ax", "dx", nx), enter_leave("ay", "dy", ny)
    rows = rows.withColumns({"t0": F.greatest(F.lit(0.0), ix, iy), "t1": F.least(F.lit(1.0), ox, oy), "ok": okx & oky}).filter("ok AND t0 <= t1")
    rows = rows.select("identity", *[(F.col(a) + F.col(d) * F.col(t)).alias(o) for a, d, t, o in (("ax", "dx", "t0", "sx"), ("ay", "dy", "t0", "sy"), ("ax", "dx", "t1", "tx"), ("ay", "dy", "t1", "ty"))])
    far = F.greatest(F.abs(F.col("tx") - F.col("sx")), F.abs(F.col("ty") - F.col("sy")), F.lit(1.0))
    rows = rows.withColumn("steps", F.floor(far).cast("int") + 1).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    f = F.col("t").cast("double") / F.greatest(F.col("steps") - 1, F.lit(1))
    cells = rows.select(F.floor(F.col("sx") + (F.col("tx") - F.col("sx")) * f).cast("int").alias("cx"), F.floor(F.col("sy") + (F.col("ty") - F.col("sy")) * f).cast("int").alias("cy"), "identity")
    return cells.filter((F.col("cx") >= 0) & (F.col("cx") < nx) & (F.col("cy") >= 0) & (F.col("cy") < ny)).groupBy("cx", "cy").agg(F.max("identity").alias("v")).filter("v > 0")


def crossed(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The cells of width 1 that a line crosses, an array of structs cx, cy, each once, in its order.

    A line leaves a cell where it meets a grid line: the places at which it does, those of both directions merged in order, cut it into stretches, and the middle of a stretch lies in its cell. Where a line only touches a corner, no cell beside it counts.
    """

    def meets(a: Column, b: Column) -> Column:
        lo, hi = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
        at = F.transform(F.sequence(lo, hi), lambda g: (g.cast("double") - a) / (b - a))
        return F.when((a != b) & (lo <= hi), at).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.concat(meets(x0, x1), meets(y0, y1)), lambda t: (t > 0) & (t < 1)))))

    def cell(t: Column, i: Column) -> Column:
        mid = (t + F.element_at(cuts, (i + 2).cast("int"))) / 2
        return F.struct(F.floor(x0 + (x1 - x0) * mid).alias("cx"), F.floor(y0 + (y1 - y0) * mid).alias("cy"))

    return F.array_distinct(F.transform(F.slice(cuts, 1, F.size(cuts) - 1), cell))


def grid_cells(segments: DataFrame, cell_x: float, cell_y: float, keep: list[str]) -> DataFrame:
    """cx, cy and the columns `keep` of each segment for each cell that it crosses; segments have ends (endpoints). A segment without length has the cell it lies in."""
    ends = [F.col(c) / s for c, s in (("x0", cell_x), ("y0", cell_y), ("x1", cell_x), ("y1", cell_y))]
    own = F.array(F.struct(F.floor(ends[0]).alias("cx"), F.floor(ends[1]).alias("cy")))
    cells = F.when((F.floor(ends[0]) == F.floor(ends[2])) & (F.floor(ends[1]) == F.floor(ends[3])), own).otherwise(crossed(*ends))
    return segments.select(F.inline(cells), *keep)


def segment_grid(segments: DataFrame, width: float, height: float) -> tuple[DataFrame, int]:
    """The segments by cells, stored, and the cells on a side: a power of two near the root of their number, halved while the entries are more than MOST_ENTRIES. Columns: cx, cy, id and the segment's."""
    ends = endpoints(segments)
    n = segments.count()
    side = min(SIDE_MOST, max(SIDE_LEAST, 1 << round(math.log2(max(math.sqrt(n), 1)))))
    while side > SIDE_LEAST:
        across = [F.abs(F.floor(F.col(f"{c}1") * side / size) - F.floor(F.col(f"{c}0") * side / size)) for c, size in (("x", width), ("y", height))]
        if (ends.agg(F.sum(across[0] + across[1] + 1)).first()[0] or 0) <= MOST_ENTRIES:
            break
        side //= 2
    columns = ends.columns
    named = ends.withColumn("id", F.struct("x", "y", "dx", "dy", "strand"))
    return stored(grid_cells(named, width / side, height / side, ["id", *columns]), "grid", by="cx"), side


def in_view(grid: DataFrame, side: int, width: float, height: float, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Segments whose box meets a rectangle, each once, from the cells that the rectangle touches: other files and ranges of cells are not read."""
    lo_x, hi_x, lo_y, hi_y = (math.floor(v * side / s) for v, s in ((x0, width), (x1, width), (y0, height), (y1, height)))
    cells = grid.filter(F.col("cx").between(lo_x, hi_x) & F.col("cy").between(lo_y, hi_y))
    return cells.filter(in_rect(x0, x1, y0, y1)).dropDuplicates(["id"]).drop("cx", "cy", "id")


def nearest_join(points: DataFrame, segments: DataFrame, most: float, sx: float = 1.0, sy: float = 1.0, finest: float | None = None) -> DataFrame:
    """For each point (id, px, py) the segment nearest to it, nearer than `most`: the point, the segment's columns and distance. Of equally near ones the first by x, y and strand; points with none have no row.

    Cells have widths from `finest` up to `most`, each four times the one before. How far the nearest segment can be is known from one segment that starts in a point's own cell of each width. A point then looks for segments in the cells that lie within this reach, of the least width that is no less: nine at most, and narrow ones where segments lie close together. So each point is searched once, and what it is paired with grows with what lies around it, not with the table.
    """
    ends = endpoints(segments)
    scaled = ends.select([F.col(c) for c in segments.columns] + [(F.col(c) * s).alias(c) for c, s in (("x0", sx), ("y0", sy), ("x1", sx), ("y1", sy))])
    starts = scaled.select("x0", "y0")
    if finest is None:
        # About a quarter of what lies between neighbours, narrower where a cell would be busy, while a segment crosses some eight cells at most.
        length, n, *box = scaled.agg(F.coalesce(F.sum(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))), F.lit(0.0)), F.count(F.lit(1)), *[f(c) for c in ("x0", "y0") for f in (F.min, F.max)]).first()
        area = (box[1] - box[0] + 1) * (box[3] - box[2] + 1) if n else 1.0
        finest = max(min(math.sqrt(area / max(1, n)) / 4, most), most / (1 << 20), 1e-9)
        while n > BUSY and float(length) * 4 / finest < 8 * n and starts.groupBy(*_cell("x0", "y0", finest)).count().agg(F.max("count")).first()[0] > BUSY:
            finest /= 4
    widths = [min(finest, most)]
    while widths[-1] < most:
        widths.append(min(4 * widths[-1], most))

    def by_width(x: str, y: str) -> Column:
        return F.inline(F.array(*[F.struct(F.lit(i).alias("level"), *_cell(x, y, w)) for i, w in enumerate(widths)]))

    known = starts.select("x0", "y0", by_width("x0", "y0")).groupBy("level", "cx", "cy").agg(F.min("x0").alias("x0"), F.min_by("y0", "x0").alias("y0"))
    spots = points.select("id", "px", "py", (F.col("px") * sx).alias("ux"), (F.col("py") * sy).alias("uy"))
    apart = F.hypot(F.col("x0") - F.col("ux"), F.col("y0") - F.col("uy"))
    reach = spots.select("*", by_width("ux", "uy")).join(known, ["level", "cx", "cy"], "left").groupBy("id", "px", "py", "ux", "uy").agg(F.least(F.coalesce(F.min(apart), F.lit(float(most))), F.lit(float(most))).alias("reach"))
    # Some slack, so that rounding leaves nothing out.
    reach = reach.withColumn("reach", F.col("reach") * (1 + 1e-9) + 1e-9)
    level = F.lit(len(widths) - 1)
    for i in range(len(widths) - 2, -1, -1):
        level = F.when(F.col("reach") <= widths[i], i).otherwise(level)
    spots = stored(reach.withColumn("level", level), "reach")
    many, near = {r["level"]: r["count"] for r in spots.groupBy("level").count().collect()}, None
    for i in sorted(many):
        w = widths[i]
        asked = spots.filter(F.col("level") == i).drop("level")
        for cell, u in (("cx", "ux"), ("cy", "uy")):
            asked = asked.withColumn(cell, F.explode(F.sequence(F.floor((F.col(u) - F.col("reach")) / w), F.floor((F.col(u) + F.col("reach")) / w))))
        beyond = [F.greatest(F.lit(0.0), F.col(c) * w - F.col(u), F.col(u) - (F.col(c) + 1) * w) for c, u in (("cx", "ux"), ("cy", "uy"))]
        asked = asked.filter(F.hypot(*beyond) <= F.col("reach") * (1 + 1e-6))
        seen = grid_cells(scaled, w, w, scaled.columns).join(F.broadcast(asked) if many[i] <= FEW else asked, ["cx", "cy"])
        seen = seen.withColumn("distance", _distance(F.col("ux"), F.col("uy"))).filter((F.col("distance") < most) & (F.col("distance") <= F.col("reach")))
        seen = seen.select("id", "px", "py", *segments.columns, "distance")
        near = seen if near is None else near.unionByName(seen)
    if near is None:
        near = points.select("id", "px", "py").join(segments.withColumn("distance", F.lit(0.0)), F.lit(False))
    best = near.groupBy("id", "px", "py").agg(F.min(F.struct("distance", *[F.col(c) for c in ("x", "y", "strand")], *[F.col(c) for c in segments.columns if c not in ("x", "y", "strand")])).alias("best"))
    return best.select("id", "px", "py", *[F.col(f"best.{c}").alias(c) for c in [*segments.columns, "distance"]])


def _cell(x: str, y: str, width: float) -> list[Column]:
    return [F.floor(F.col(x) / width).alias("cx"), F.floor(F.col(y) / width).alias("cy")]


def contrast(cells: DataFrame, v: str = "v") -> DataFrame:
    """lo and hi for a colour ramp: the value at the second hundredth and the largest; a narrow span is widened, no cells give 0 and 1."""
    ranked = cells.filter(F.col(v) > 0).select(v, (F.row_number().over(Window.orderBy(v)) - 1).alias("i"))
    total = cells.filter(F.col(v) > 0).agg(F.count(F.lit(1)).alias("n"), F.max(v).alias("hi"))
    low = ranked.join(F.broadcast(total.select(F.floor(F.col("n") * 0.02).alias("i"))), "i").agg(F.max(v).alias("lo"))
    both = total.join(F.broadcast(low), F.lit(True))
    narrow = F.col("hi") - F.col("lo") < 0.005
    return both.select(F.when(F.col("n") == 0, 0.0).when(narrow, F.greatest(F.lit(0.0), F.col("hi") - 0.05)).otherwise(F.col("lo")).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))


def saturation_mask(intervals: DataFrame, lo: float, hi: float, n: int) -> DataFrame:
    """Columns of a grid over [lo, hi) that saturated intervals (start, end) cover, whole or in part."""
    f = n / max(hi - lo, 1e-9)
    first = F.greatest(F.lit(0), F.floor((F.col("start") - lo) * f).cast("int"))
    last = F.least(F.lit(n), F.ceil((F.col("end") - lo) * f).cast("int"))
    return intervals.filter((F.col("end") > lo) & (F.col("start") < hi)).select(F.explode(F.sequence(first, last - 1)).alias("cell")).distinct()


def hatched(cells: DataFrame, mask_x: DataFrame, nx: int, ny: int, mask_y: DataFrame | None = None) -> DataFrame:
    """Empty cells to be hatched: in a saturated column (and row, on a self-plot), where (cx + cy) & 3 is below 2."""
    x = mask_x.select(F.col("cell").alias("cx"))
    y = mask_y.select(F.col("cell").alias("cy")) if mask_y is not None else x.sparkSession.range(ny).select(F.col("id").cast("int").alias("cy"))
    rows = x.withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).join(y, "cy", "left_semi")
    return rows.filter((F.col("cx") + F.col("cy")).bitwiseAND(3) < 2).join(cells, ["cx", "cy"], "left_anti").select("cx", "cy")


def _distance(px: Column, py: Column, sx: float = 1.0, sy: float = 1.0) -> Column:
    ax, ay = (F.col("x0") - px) * sx, (F.col("y0") - py) * sy
    dx, dy = (F.col("x1") - F.col("x0")) * sx, (F.col("y1") - F.col("y0")) * sy
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, F.lit(2.0)) + F.pow(ay + t * dy, F.lit(2.0)))


def distance(px: float, py: float, sx: float = 1.0, sy: float = 1.0) -> Column:
    """From a point to a segment, with both axes scaled (to pixels)."""
    return _distance(F.lit(px), F.lit(py), sx, sy)


def nearest(segments: DataFrame, px: float, py: float, most: float, sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """The segment nearest to a point, nearer than `most`; of equal ones the first by x, y and strand. A box around the point limits what is measured."""
    box = in_rect(px - most / sx, px + most / sx, py - most / sy, py + most / sy)
    near = endpoints(segments.filter(box)).withColumn("distance", distance(px, py, sx, sy)).filter(F.col("distance") < most)
    return near.orderBy("distance", "x", "y", "strand").limit(1)
