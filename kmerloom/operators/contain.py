"""Containment of tile pairs: how much of a tile's k-mers, counted with copies, another tile holds, and the identity that this stands for.

Copies are added up for each tile and k-mer, so a pair costs by tiles that a k-mer touches, not by its copies.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.model import EngineError
from kmerloom.operators import packed, pairs
from kmerloom.operators.kmers import kmers
from kmerloom.operators.profile import occurrences
from kmerloom.plans.density import grid_side
from kmerloom.plans.tables import stored


def tile_counts(axis: DataFrame, lo: int, hi: int, n: int, lay: packed.Layout, first: int = 0) -> DataFrame:
    """Packed k-mers of n equal tiles of [lo, hi), numbered from `first`; what falls past the last edge by rounding counts to the last tile."""
    if hi - lo < 100:
        raise EngineError("The window is too small: 100 bases on each side are needed.")
    return packed.packed(axis, [], lambda batch, row, place: np.where((place >= lo) & (place < hi), first + np.minimum(n - 1, np.floor((place - lo) * (n / (hi - lo))).astype(np.int64)), -1), lay)


def side_of(axis: DataFrame, k: int, asked: int | None = None, most: int = 512) -> int:
    """Tiles on a side: what is asked for within limits, or the finest grid whose expected cost for this axis is in bounds. The driver gets a row for each number of occurrences, up to 1,024."""
    if asked:
        return grid_side({}, asked)
    classes = occurrences(kmers(axis, k)).groupBy(F.least(F.col("occ"), F.lit(1024)).alias("o")).count().collect()
    return grid_side({r["o"]: r["count"] for r in classes}, None, most)


def containment_grid(x_axis: DataFrame, y_axis: DataFrame | None, x_range: tuple[int, int], y_range: tuple[int, int] | None, n: int, k: int) -> DataFrame:
    """tx, ty, shared, containment and identity = containment^(1/k) of tile pairs that share a k-mer; forward k-mers, no occurrence cap. Axes come in pieces (spread). Without a second axis, or with one that is the first, x_range is held against y_range of the same axis; without y_range against itself.

    Each axis is enumerated once, and its k-mers are dealt out once: pairs are added up where they meet (pairs.packed_sums), tiles of a second axis being numbered on. The sums are stored, a row for each pair of tiles.
    """
    sums, ranges = ("shared", "total"), (x_range, y_range or x_range)
    lay = packed.layout(k, 2 * n, sum(hi - lo for lo, hi in ranges))
    x = tile_counts(x_axis, *x_range, n, lay)
    if y_axis is None and y_range in (None, x_range):
        both = stored(pairs.packed_sums(x, lay, n, sums=sums), "grid")
        total_x = total_y = both.filter("i = j").select(F.col("i").alias("tile"), "total")
        half = both.filter("i < j").select("i", "j", "shared")
        found = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "shared")).unionByName(total_x.select(F.col("tile").alias("i"), F.col("tile").alias("j"), F.col("total").alias("shared")))
    else:
        y = tile_counts(x_axis if y_axis is None else y_axis, *ranges[1], n, lay, n)
        both = stored(pairs.packed_sums(x.unionByName(y), lay, 2 * n, n, sums), "grid")
        total_x, total_y = (both.filter(F.col("i") == F.col("j")).filter(half).select((F.col("i") - shift).alias("tile"), "total") for half, shift in ((F.col("i") < n, 0), (F.col("i") >= n, n)))
        found = both.filter("i < j").select("i", (F.col("j") - n).alias("j"), "shared")
    rows = found.select(F.col("i").alias("tx"), F.col("j").alias("ty"), "shared").join(total_x.select(F.col("tile").alias("tx"), F.col("total").alias("total_x")), "tx").join(total_y.select(F.col("tile").alias("ty"), F.col("total").alias("total_y")), "ty")
    c = F.col("shared") / F.least("total_x", "total_y")
    return rows.select(F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"), "shared", c.alias("containment"), F.pow(c, F.lit(1.0) / max(1, k)).alias("identity"))
