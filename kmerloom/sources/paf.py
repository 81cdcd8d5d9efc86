"""PAF alignments: checked lines, standalone axes, and segments on axes that are loaded already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.model import EngineError
from kmerloom.sources import bgzf
from kmerloom.sources.heads import is_bgzf

#: The 12 columns of a line, and those among the first 11 that are unsigned numbers.
COLUMNS = ("qname", "qlen", "qs", "qe", "strand", "tname", "tlen", "ts", "te", "nmatch", "alnlen", "mapq")
NUMBERS = ("qlen", "qs", "qe", "tlen", "ts", "te", "nmatch", "alnlen")


def read_lines(spark: SparkSession, path: str, split: int = bgzf.SPLIT) -> DataFrame:
    """line_no (from 0) and value, in the order of files and of places in them. split: compressed bytes of a BGZF file for a task.

    Inside a split of a file Spark numbers rows as it reads them; what comes before is added up from one row for each split, so no task sorts the lines.
    """
    if is_bgzf(spark, path):
        lines = bgzf.read_bgzf(spark, path, split=split).select("value", F.col("file").alias("f"), F.col("block").alias("b"), F.monotonically_increasing_id().alias("m"))
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    splits = lines.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"))
    earlier = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("f", "b", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(splits, ["f", "b"]).select((F.col("m") + F.col("shift")).cast("long").alias("line_no"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """All data lines: line_no, the columns, tags, valid and identity. Comments and blank lines are no data; a line is valid if it has 12 columns, numbers where they belong, a strand, and spans that are not empty."""
    # What is split and cast goes through generators: a predicate on what they give, such as `valid`, is not pushed below them, which would have a line split again for each field that it looks at.
    cr, value = F.lit("\r"), F.col("value")
    text = F.when(F.contains(value, cr), F.regexp_replace(value, "\r$", "")).otherwise(value)
    rows = lines.filter(~value.startswith("#") & (F.btrim(value, F.lit(" \r\t")) != "")).select("line_no", F.explode(F.array(F.split(text, "\t", -1))).alias("p"))
    number = lambda i: F.when(F.get("p", F.lit(i)).rlike("^[0-9]+$"), F.get("p", F.lit(i))).try_cast("long")
    fields = [F.size("p").alias("n"), *[(number(i) if c in NUMBERS else F.get("p", F.lit(i))).alias(c) for i, c in enumerate(COLUMNS)], F.when(F.size("p") > 12, F.slice("p", F.lit(13), F.greatest(F.size("p") - 12, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("tags")]
    rows = rows.select("line_no", F.inline(F.array(F.struct(*fields))))
    good = (F.col("n") >= 12) & F.col("strand").isin("+", "-") & (F.col("qe") > F.col("qs")) & (F.col("te") > F.col("ts"))
    for c in NUMBERS:
        good = good & F.col(c).isNotNull()
    identity = F.when(F.col("alnlen") > 0, F.least(F.lit(1.0), F.col("nmatch") / F.nullif("alnlen", F.lit(0)))).otherwise(0.0)
    return rows.withColumns({"valid": F.coalesce(good, F.lit(False)), "identity": identity}).drop("n")


def paf_catalog(valid: DataFrame, name: str, length: str) -> DataFrame:
    """rec, name, start, end: names with the length they come with first, longest first, then as they come."""
    first = valid.groupBy(F.col(name).alias("name")).agg(F.min_by(length, "line_no").alias("len"), F.min("line_no").alias("first"))
    order = Window.orderBy(F.desc("len"), "first", "name")
    rows = first.withColumns({"rec": (F.row_number().over(order) - 1).cast("long"), "end": F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")})
    return rows.select("rec", "name", (F.col("end") - F.col("len")).alias("start"), "end")


def _segments(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    return rows.select("line_no", x.alias("x"), y.alias("y"), (F.col("te") - F.col("ts")).alias("dx"), (F.col("qe") - F.col("qs")).alias("dy"), F.when(F.col("strand") == "+", 0).otherwise(1).alias("strand"), "identity")


def standalone(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, target catalog and query catalog of a PAF file by itself."""
    valid = parsed.filter("valid")
    target, query = paf_catalog(valid, "tname", "tlen"), paf_catalog(valid, "qname", "qlen")
    rows = valid.join(target.select(F.col("name").alias("tname"), F.col("start").alias("t0")), "tname").join(query.select(F.col("name").alias("qname"), F.col("start").alias("q0")), "qname")
    return _segments(rows, F.col("t0") + F.col("ts"), F.col("q0") + F.col("qs")), target, query


def _local(start: str, end: str, length: str, width: str, offset: str) -> Column:
    """Where a side's start lies in its record; null where the coordinates are of another extent."""
    s, e, w, o = (F.col(c) for c in (start, end, width, offset))
    return F.when(F.col(length) == w, F.when(e <= w, s)).when((o > 0) & (s >= o) & (e <= o + w), s - o)


def overlay(parsed: DataFrame, target: DataFrame, query: DataFrame) -> DataFrame:
    """Lines on loaded axes (catalogs): line_no, status (kept, remapped, unknown, mismatch, skipped), and the segment where kept or remapped. Names count in their case; of equal names the last record."""
    last = lambda c, p: c.groupBy(F.col("name").alias(f"{p}name")).agg(F.max_by(F.struct("start", "end", "offset"), "rec").alias("c")).select(f"{p}name", F.col("c.start").alias(f"{p}0"), (F.col("c.end") - F.col("c.start")).alias(f"{p}w"), F.col("c.offset").alias(f"{p}o"))
    rows = parsed.join(last(target, "t"), "tname", "left").join(last(query, "q"), "qname", "left")
    rows = rows.withColumns({"tl": _local("ts", "te", "tlen", "tw", "to"), "ql": _local("qs", "qe", "qlen", "qw", "qo")})
    status = (
        F.when(~F.col("valid"), "skipped").when(F.col("t0").isNull() | F.col("q0").isNull(), "unknown").when(F.col("tl").isNull() | F.col("ql").isNull(), "mismatch")
        .when((F.col("tlen") != F.col("tw")) | (F.col("qlen") != F.col("qw")), "remapped").otherwise("kept")
    )
    rows = rows.withColumn("status", status)
    on = F.col("status").isin("kept", "remapped")
    segments = _segments(rows.filter(on), F.col("t0") + F.col("tl"), F.col("q0") + F.col("ql"))
    return rows.select("line_no", "status").join(segments, "line_no", "left")


def overlay_counts(overlaid: DataFrame) -> DataFrame:
    """One row: kept (with remapped), remapped, unknown, mismatch, skipped, identity_min."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return overlaid.agg(n("kept", "remapped").alias("kept"), n("remapped").alias("remapped"), n("unknown").alias("unknown"), n("mismatch").alias("mismatch"), n("skipped").alias("skipped"), F.min("identity").alias("identity_min"))


def check_overlay(counts: DataFrame) -> dict:
    """The counts; an error that names the main cause if nothing is kept."""
    c = counts.first().asDict()
    if not c["kept"]:
        cause = "carry coordinates of another sequence extent" if c["mismatch"] else "name other sequences" if c["unknown"] else "are malformed" if c["skipped"] else ""
        raise EngineError(f"No alignment can be used: {c['mismatch'] or c['unknown'] or c['skipped']} lines {cause}." if cause else "The PAF file is empty.")
    return c


def looks_like_paf(head: bytes) -> bool:
    """The first data line, within 64 KB, has 11 tabs or more."""
    lines = (x for x in head[: 64 * 1024].split(b"\n") if x.strip() and not x.startswith(b"#"))
    return next(lines, b"").count(b"\t") >= 11
