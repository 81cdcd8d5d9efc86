"""Annotations by tiles: what one view has read of a source, the next ones don't read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.model import EngineError
from kmerloom.plans.tables import release, scratch

#: Bases of a tile, and tiles that are held.
TILE_BP, TILES = 1_000_000, 400


class TileCache:
    """Items of a source (chrom, start, end, name, strand, rgb) by tile. `read` gives the items in a list of windows (chrom, start, end), as read_bigbed does.

    Tiles that a view lacks are read at once and stored in the shared folder, a directory for each tile of each chromosome. With more than `most` tiles those that came first go, but never one that the view has just asked for; a table goes with its last tile, so a view is to be read before later ones have pushed its tiles out.
    """

    def __init__(self, read: Callable[[list[tuple[str, int, int]]], DataFrame], tile_bp: int = TILE_BP, most: int = TILES):
        if tile_bp < 1 or most < 1:
            raise EngineError("A tile has at least one base, and at least one is held.")
        self.read, self.tile_bp, self.most = read, tile_bp, most
        #: The table of each tile, in the order in which they came.
        self.held: dict[tuple[str, int], DataFrame] = {}

    def _fetch(self, chrom: str, tiles: list[int]) -> None:
        """Neighbouring tiles are one window."""
        windows: list[tuple[str, int, int]] = []
        for t in tiles:
            lo, hi = t * self.tile_bp, (t + 1) * self.tile_bp
            if windows and windows[-1][2] == lo:
                lo = windows.pop()[1]
            windows.append((chrom, lo, hi))
        items = self.read(windows)
        first, last = F.floor(F.col("start") / self.tile_bp), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / self.tile_bp)
        items = items.withColumn("tile", F.explode(F.sequence(F.greatest(first, F.lit(tiles[0])).cast("long"), F.least(last, F.lit(tiles[-1])).cast("long")))).filter(F.col("tile").isin(tiles))
        path = scratch(items.sparkSession, "tiles")
        items.repartitionByRange("tile", "start").write.partitionBy("tile").parquet(path)
        table = items.sparkSession.read.schema(items.schema).parquet(path)
        table._kmerloom_path = path
        for t in tiles:
            self.held[chrom, t] = table

    def view(self, chrom: str, lo: int, hi: int) -> DataFrame:
        """chrom, start, end, name, strand, rgb of items that reach into [lo, hi). Items equal in start, end and name are one, whatever tiles they come from: the one of the least strand and colour, null first. An item without length on the border of two tiles is in neither, as in no window of the source."""
        first = max(0, lo // self.tile_bp)
        asked = range(first, max(first, max(lo, hi - 1) // self.tile_bp) + 1)
        lacking = [t for t in asked if (chrom, t) not in self.held]
        if lacking:
            self._fetch(chrom, lacking)
        tables: dict[str, tuple[DataFrame, list[int]]] = {}
        for t in asked:
            table = self.held[chrom, t]
            tables.setdefault(table._kmerloom_path, (table, []))[1].append(t)
        self._drop({(chrom, t) for t in asked})
        parts = [table.filter(F.col("tile").isin(tiles) & (F.col("end") > lo) & (F.col("start") < hi)) for table, tiles in tables.values()]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        kept = F.min(F.struct("strand", "rgb")).alias("kept")
        return rows.groupBy("chrom", "start", "end", "name").agg(kept).select("chrom", "start", "end", "name", "kept.strand", "kept.rgb")

    def _drop(self, asked: set[tuple[str, int]]) -> None:
        old = [x for x in self.held if x not in asked][: max(0, len(self.held) - self.most)]
        gone = [self.held.pop(x) for x in old]
        left = {table._kmerloom_path for table in self.held.values()}
        for path in {table._kmerloom_path for table in gone} - left:
            release(path)
