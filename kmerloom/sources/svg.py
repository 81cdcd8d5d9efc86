"""Visible segments as an SVG file: a picture of bounded size, written whole or not at all."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from kmerloom.model import EngineError
from kmerloom.operators import raster
from kmerloom.operators.profile import strength
from kmerloom.plans.tables import release, stored
from kmerloom.sources.sinks import FolderWriter, Written

#: Fixed value: the most lines of a picture.
MOST_LINES = 60_000
#: Ends of the colour ramps, for forward and reverse segments.
RAMPS = (((203, 213, 232), (16, 44, 110)), ((250, 214, 190), (150, 44, 12)))


def tone(by: str, identity_low: float = 0.0) -> Column:
    """0 to 255: how strong a segment is drawn, by its identity (from identity_low on), its strand, or the copies `mult` of its place."""
    if by == "strand":
        t = F.lit(1.0)
    elif by == "multiplicity":
        t = strength(F.coalesce(F.col("mult"), F.lit(1.0)))
    elif by == "identity":
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("identity") - identity_low) / max(1 - identity_low, 1e-6)))
    else:
        raise EngineError(f"Segments are coloured by identity, strand or multiplicity, not by {by}.")
    return F.floor(t * 255 + 0.5).cast("int")


def svg_lines(segments: DataFrame, view: tuple[float, float, float, float], width: float, height: float, by: str = "identity", identity_low: float = 0.0, profile: DataFrame | None = None, tile_bp: int | None = None) -> DataFrame:
    """A row for each segment that meets the view (x0, x1, y0, y1): x, y, strand, the line's ends in pixels with two decimals (x1, y1, x2, y2; y grows downwards) and tone. profile: multiplicity() of tiles of tile_bp bases of the target."""
    vx0, vx1, vy0, vy1 = view
    rows = segments.filter(raster.in_rect(vx0, vx1, vy0, vy1))
    if by == "multiplicity":
        if profile is None or not tile_bp:
            raise EngineError("Colours by multiplicity need the target's profile and its tile.")
        rows = rows.withColumn("tile", F.floor((F.col("x") + F.col("dx") / 2) / tile_bp).cast("long")).join(profile.select("tile", "mult"), "tile", "left")
    fx, fy = width / max(vx1 - vx0, 1e-9), height / max(vy1 - vy0, 1e-9)
    ends = raster.endpoints(rows.withColumn("tone", tone(by, identity_low)))
    across, down = (lambda c: F.round((F.col(c) - vx0) * fx, 2)), (lambda c: F.round((F.lit(vy1) - F.col(c)) * fy, 2))
    return ends.select("x", "y", "strand", across("x0").alias("x1"), down("y0").alias("y1"), across("x1").alias("x2"), down("y1").alias("y2"), "tone")


class SvgWriter(FolderWriter):
    """Tasks write lines; the file is made of them, between its head and its end, when all are done."""

    SUFFIX = ".part"

    def content(self, rows: Iterator) -> Iterator[bytes]:
        for x1, y1, x2, y2, strand, level in rows:
            lo, hi = RAMPS[strand]
            colour = ",".join(str(round(a + (b - a) * level / 255)) for a, b in zip(lo, hi, strict=True))
            yield f'<line x1="{x1:.2f}" y1="{y1:.2f}" x2="{x2:.2f}" y2="{y2:.2f}" stroke="rgb({colour})"/>\n'.encode()

    def put(self, files: arrow_fs.FileSystem, place: str, written: list[Written]) -> None:
        if sum(m.rows for m in written) > MOST_LINES:
            raise EngineError(f"A picture has {MOST_LINES:,} lines at most.")
        width, height, title = (self.options[k] for k in ("width", "height", "title"))
        head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}" aria-label={quoteattr(title)}>\n<rect width="100%" height="100%" fill="white"/>\n<g stroke-width="1.2" stroke-linecap="round">\n'
        with files.open_output_stream(f"{place}.{self.run}/whole", compression=None) as out:
            out.write(head.encode())
            for m in sorted(written, key=lambda m: m.path):
                with files.open_input_stream(m.path, compression=None) as part:
                    out.write(part.read())
            out.write(b"</g>\n</svg>\n")
        files.move(f"{place}.{self.run}/whole", place)


class SvgSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svg_sink"

    def writer(self, schema, overwrite: bool) -> SvgWriter:  # noqa: ANN001
        return SvgWriter(self.options, overwrite)


def write_svg(lines: DataFrame, path: str, width: float, height: float, title: str = "", overwrite: bool = False) -> int:
    """svg_lines() as a file; the number of lines. More than MOST_LINES are an error, before anything is written."""
    rows = stored(lines, "svg")
    n = rows.count()
    if n > MOST_LINES:
        release(rows)
        raise EngineError(f"{n:,} segments are in view: a picture has {MOST_LINES:,} at most.", {"length_least": 1000, "view": "a smaller one"})
    lines.sparkSession.dataSource.register(SvgSink)
    own = rows.orderBy("x", "y", "strand").select("x1", "y1", "x2", "y2", "strand", "tone")
    own.write.format("svg_sink").options(width=str(width), height=str(height), title=title).mode("overwrite" if overwrite else "append").save(path)
    release(rows)
    return n
