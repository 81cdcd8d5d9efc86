"""Repeat structure of an axis: how often k-mers occur, where repeats saturate it, and how many copies each tile has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.model import OCC_CLASSES, SATURATION_TILE
from kmerloom.operators import packed
from kmerloom.operators.kmers import PIECE
from kmerloom.plans.ordering import with_group
from kmerloom.plans.tables import stored

#: Sums of tiles that a task holds (64 MB), tiles of an axis up to which it has a place for each (128 MB), and tiles of a packed row of sums.
TILES_HELD, TILES_PLACED, TILES_ROW = 1 << 21, 1 << 24, 1 << 13
OVER = "part int, m int, tile binary, n binary, over binary"


def occurrences(index: DataFrame) -> DataFrame:
    """kv and occ, its index entries; of an index with a column n (kmers.counted_kmers), the sum of that."""
    return index.groupBy("kv").agg((F.sum("n") if "n" in index.columns else F.count(F.lit(1))).alias("occ"))


def spectrum(index: DataFrame) -> DataFrame:
    """cls (occurrences, 1024 for more), occ_count and occ_sumsq (of true occurrences)."""
    return occurrences(index).groupBy(F.least(F.col("occ"), F.lit(OCC_CLASSES)).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("occ_count"), F.sum(F.col("occ").cast("double") * F.col("occ")).alias("occ_sumsq"))


def occurrence_classes(index: DataFrame) -> DataFrame:
    """Distinct k-mers by class of occurrences: 1, 2, 3-4, 5-8, ..., 513-1023, 1024 and more. bucket b holds those up to 2^b."""
    bucket = F.when(F.col("occ") >= OCC_CLASSES, 11).otherwise(F.ceil(F.log2(F.col("occ").cast("double")))).cast("int")
    return occurrences(index).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("distinct_kmers"), F.sum("occ").cast("long").alias("windows"))


def islands(df: DataFrame, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Union of intervals: those that touch or overlap become one."""
    return with_group(df, start, end, 0, keys, "__island").groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def tile_occurrences(tiles: DataFrame) -> DataFrame:
    """tile, kv, n with occ, the k-mer's entries in all tiles. A k-mer has a row for each of its tiles, not for each of its places."""
    return tiles.withColumn("occ", F.sum("n").over(Window.partitionBy("kv")))


def _over(lay: packed.Layout, cap: int, tiles: int):
    """Packed rows of what a task's k-mers have in each tile: entries, and those of k-mers above the cap. Of an axis of more tiles than TILES_PLACED each bucket has its own rows."""

    def rows(tile: np.ndarray, n: np.ndarray, over: np.ndarray) -> pa.RecordBatch:
        part = tile // TILES_ROW
        first = packed._starts(part)
        step = np.diff(tile, prepend=0)
        step[first] = tile[first] % TILES_ROW
        cuts = list(zip(first.tolist(), np.append(first[1:], len(tile)).tolist(), strict=True)) if len(tile) else []
        columns = [pa.array(part[first], pa.int32()), pa.array([b - a for a, b in cuts], pa.int32())]
        columns += [pa.array([packed.squeeze(x[a:b]) for a, b in cuts], pa.binary()) for x in (step, n, over)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "m", "tile", "n", "over"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, tiles), np.int32) if tiles <= TILES_PLACED else None
        for kv, tile, n in packed.buckets(batches, lay):
            begin = packed._starts(kv)
            over = np.where(np.repeat(np.add.reduceat(n, begin) > cap, np.diff(np.append(begin, len(kv)))), n, 0) if len(kv) else n
            if sums is not None:
                np.add.at(sums[0], tile, n.astype(np.int32))
                np.add.at(sums[1], tile, over.astype(np.int32))
            else:
                own, at = np.unique(tile, return_inverse=True)
                yield rows(own, *[np.bincount(at, x, minlength=len(own)).astype(np.int64) for x in (n, over)])
        if sums is not None:
            own = np.flatnonzero(sums[0])
            yield rows(own, *sums[:, own].astype(np.int64))

    return run


def _tile_sums(width: int):
    """t, n and over of each tile that has entries, from packed rows of `width` tiles in order of `part`."""

    def told(part: int, sums: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(own + part * width), *[pa.array(x[own]) for x in sums]], names=["t", "n", "over"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros((2, width), np.int64)
        for batch in batches:
            for part, m, tile, n, over in zip(*(batch.column(c).to_pylist() for c in ("part", "m", "tile", "n", "over")), strict=True):
                if at not in (None, part):
                    yield told(at, sums)
                    sums[:] = 0
                at = part
                sums[:, np.cumsum(packed.unsqueeze(tile, m))] += [packed.unsqueeze(n, m), packed.unsqueeze(over, m)]
        if at is not None:
            yield told(at, sums)

    return run


def saturated(tiles: DataFrame, t_len: int, cap: int, tile: int = SATURATION_TILE, k: int | None = None) -> DataFrame:
    """start, end of runs of tiles in which half of the entries or more are of k-mers above the cap. The last tile ends with the axis. tiles: tile_kmers() of width `tile`, or with k the pieces of the axis, whose k-mers are dealt out packed, and so are the sums of tiles that come of them."""
    if k is not None:
        count = -(-t_len // tile)
        lay = packed.layout(k, max(1, count), t_len)
        over = packed.dealt(packed.packed(tiles, [], lambda batch, row, place: place // tile, lay, apart=PIECE)).mapInArrow(_over(lay, cap, count), OVER)
        each = over.repartition("part").sortWithinPartitions("part").mapInArrow(_tile_sums(TILES_ROW), "t long, n long, over long")
    else:
        each = tile_occurrences(tiles).groupBy(F.col("tile").alias("t")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("occ") > cap, F.col("n")).otherwise(0)).alias("over"))
    hot = each.filter(2 * F.col("over") >= F.col("n")).select((F.col("t") * tile).cast("long").alias("start"), F.least((F.col("t") + 1) * tile, F.lit(t_len)).cast("long").alias("end"))
    # Unions go over their rows several times: the axis is enumerated once, and what is left of it is a row for each tile.
    return stored(islands(stored(hot, "hot"), "start", "end"), "saturated")


def splice(old: DataFrame, new: DataFrame, lo: int, hi: int) -> DataFrame:
    """Intervals with what lies in [lo, hi) replaced; pieces that touch are merged."""
    left = old.select("start", F.least("end", F.lit(lo)).alias("end"))
    right = old.select(F.greatest("start", F.lit(hi)).alias("start"), "end")
    mid = new.select(F.greatest("start", F.lit(lo)).alias("start"), F.least("end", F.lit(hi)).alias("end"))
    return islands(stored(left.unionByName(right).unionByName(mid).filter("start < end"), "splice"), "start", "end")


def _copies(lay: packed.Layout, stride: int):
    """tile, n, lg and single: sums over the entries that a task's k-mers have in each tile, put together over a number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def put(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
            tile, *sums = (np.concatenate(x) for x in zip(*rows, strict=True))
            tiles, at = np.unique(tile, return_inverse=True)
            return [tiles, *[np.bincount(at, x, minlength=len(tiles)) for x in sums]]

        def batch_of(tile: np.ndarray, n: np.ndarray, lg: np.ndarray, single: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(tile), pa.array(n.astype(np.int64)), pa.array(lg), pa.array(single.astype(np.int64))], names=["tile", "n", "lg", "single"])

        for kv, tile, n in packed.buckets(batches, lay):
            begin = packed._starts(kv)
            occ = np.repeat(np.add.reduceat(n, begin), np.diff(np.append(begin, len(kv)))) if len(kv) else n
            held.append(put([[tile, n, n * np.log2((occ - 1) * stride + 1.0), np.where(occ == 1, n, 0)]]))
            if sum(len(x[0]) for x in held) > TILES_HELD:
                held = [put(held)]
                if len(held[0][0]) > TILES_HELD // 2:
                    yield batch_of(*held.pop())
        if held:
            yield batch_of(*put(held))

    return run


def multiplicity(tiles: DataFrame, t_len: int, tile_bp: int, stride: int = 1, k: int | None = None) -> DataFrame:
    """tile, mult (geometric mean of copies, 0 without entries) and uniq_frac (share of entries that occur once), a row for each tile of the axis. tiles: tile_kmers() of width tile_bp, or with k the pieces of the axis, whose k-mers are dealt out packed."""
    spark = tiles.sparkSession
    if k is not None:
        lay = packed.layout(k, t_len // tile_bp + 1, t_len // stride)
        dealt = packed.dealt(packed.packed(tiles, [], lambda batch, row, place: place // tile_bp, lay, stride))
        sums = dealt.mapInArrow(_copies(lay, stride), "tile long, n long, lg double, single long")
        own = sums.groupBy("tile").agg((F.sum("lg") / F.sum("n")).alias("lg"), (F.sum("single") / F.sum("n")).alias("uniq_frac"))
    else:
        copies, n = ((F.col("occ") - 1) * stride + 1).cast("double"), F.sum("n")
        own = tile_occurrences(tiles).groupBy("tile").agg((F.sum(F.col("n") * F.log2(copies)) / n).alias("lg"), (F.sum(F.when(F.col("occ") == 1, F.col("n")).otherwise(0)) / n).alias("uniq_frac"))
    every = spark.range((t_len + tile_bp - 1) // tile_bp).withColumnRenamed("id", "tile")
    return every.join(own, "tile", "left").select("tile", F.coalesce(F.pow(F.lit(2.0), "lg"), F.lit(0.0)).alias("mult"), F.coalesce("uniq_frac", F.lit(0.0)).alias("uniq_frac"))


def strength(mult: Column) -> Column:
    """0 to 1 for drawing: a full tone at 10^2.5 copies."""
    return F.least(F.lit(1.0), F.log10(F.greatest(mult, F.lit(1.0))) / 2.5)


def multiplicity_lane(profile: DataFrame, tile_bp: int, bp_per_px: float, least: float = 0.03) -> DataFrame:
    """The profile in buckets of a tile or two pixels: start, mult (geometric mean over tiles with entries), uniq_frac, tone; tones below `least` are not drawn."""
    width = max(tile_bp, int(2 * bp_per_px))
    lane = profile.filter("mult > 0").groupBy(F.floor(F.col("tile") * tile_bp / width).cast("long").alias("bucket")).agg(F.pow(F.lit(2.0), F.avg(F.log2("mult"))).alias("mult"), F.avg("uniq_frac").alias("uniq_frac"))
    return lane.select((F.col("bucket") * width).cast("long").alias("start"), "mult", "uniq_frac", strength(F.col("mult")).alias("tone")).filter(F.col("tone") >= least)


def multiplicity_texture(profile: DataFrame, n_tiles: int, width: int = 8192) -> DataFrame:
    """texel and value (0 to 255): the tone of the geometric mean over the tiles that a texel stands for, 0 without entries. With more texels asked for than there are tiles a texel is a tile."""
    w = max(1, min(width, n_tiles))
    # Tile t lies in texel x if floor(x * n / w) <= t < floor((x + 1) * n / w): the last x whose first tile is not above t.
    at = (F.floor((F.col("tile") * w + w - 1) / n_tiles)).cast("long")
    at = F.when(F.floor(at * n_tiles / w) > F.col("tile"), at - 1).otherwise(at)
    own = profile.withColumn("texel", at).groupBy("texel").agg(F.avg(F.when(F.col("mult") > 0, F.log10("mult"))).alias("lg"))
    every = profile.sparkSession.range(w).withColumnRenamed("id", "texel")
    value = F.floor(strength(F.pow(F.lit(10.0), "lg")) * 255 + 0.5)
    return every.join(own, "texel", "left").select("texel", F.coalesce(value, F.lit(0)).cast("int").alias("value"))
