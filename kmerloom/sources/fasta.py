"""FASTA files as records. Files are split where a line begins with '>', so that a large one is read by many tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.model import EngineError
from kmerloom.plans.ordering import with_running_total
from kmerloom.plans.tables import stored
from kmerloom.sources import bgzf
from kmerloom.sources.heads import is_bgzf

OFFSET = re.compile(r"(?:^|\s)@offset=(\d+)(?=\s|$)")
BLANKS = re.compile(r"[ \t\r\n\f\v]+")
PARSED = "file string, block long, idx long, name string, named boolean, offset long, seq string, n_gt long"


def parse_record(text: str, header: bool) -> tuple[str | None, int, str, int]:
    """Name (None where there is none), offset, sequence and number of '>' inside it of one record's text, whose first line is its header or not."""
    head, _, body = text.partition("\n") if header else ("", "", text)
    words = head.strip("\r").split(None, 1) if head[:1] not in " \t" else [""]
    name = words[0] if words else ""
    found = OFFSET.search(head[len(name) :])
    seq = BLANKS.sub("", "\n".join(line for line in body.split("\n") if not line.startswith(";")))
    return name or None, int(found[1]) if found else 0, seq, seq.count(">")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        rows = []
        for file, block, text in batch.itertuples(index=False):
            first = (file, block) not in seen
            idx = seen.setdefault((file, block), 0)
            header = True
            if block == 0 and first:  # what comes before the first header: comments, or a sequence without one
                lead, sep, rest = ("", ">", text[1:]) if text.startswith(">") else (text, "", "")
                if sep:
                    text = rest
                else:
                    text, header = lead, False
            name, offset, seq, n_gt = parse_record(text, header)
            if header or seq:
                rows.append((file, block, idx, name, header, offset, seq, n_gt))
                seen[file, block] = idx + 1
        yield pd.DataFrame(rows, columns=["file", "block", "idx", "name", "named", "offset", "seq", "n_gt"])


def read_records(spark: SparkSession, *paths: str, split: int = bgzf.SPLIT) -> DataFrame:
    """Records of FASTA files (plain, gzip or BGZF) in their order: file_ord, rec_ord, name, offset, seq, n_gt. split: compressed bytes of a BGZF file for a task.

    Files are parsed once, and stored. Records are numbered where they are parsed, from 0 in each split; what comes before is added up from one row for each split.
    """
    parts = []
    for i, path in enumerate(paths):
        if is_bgzf(spark, path):
            lines = bgzf.read_bgzf(spark, path, "\n>", split)
        else:
            lines = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        rows = stored(lines.mapInPandas(_parse, PARSED), "records")
        earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
        splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) + 1).alias("before"))
        rows = rows.join(F.broadcast(splits), ["file", "block"]).withColumn("rec_ord", F.col("idx") + F.col("before"))
        parts.append(rows.select(F.lit(i).alias("file_ord"), "rec_ord", F.coalesce("name", F.concat(F.lit("seq"), F.col("rec_ord"))).alias("name"), "offset", "seq", "n_gt"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_axis(spark: SparkSession, *paths: str, split: int = bgzf.SPLIT) -> DataFrame:
    """Files stacked on one axis: rec (from 0), name, start, len, offset, seq (in upper case, other than A, C, G, T, U as N)."""
    from kmerloom.functions.sequence import normalise

    rows = read_records(spark, *paths, split=split)
    earlier = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file_ord").agg(F.count(F.lit(1)).alias("n")).select("file_ord", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - 1).alias("before"))
    rows = rows.join(F.broadcast(files), "file_ord").withColumn("rec", (F.col("rec_ord") + F.col("before")).cast("long"))
    placed = stored(with_running_total(rows.select("rec", F.length("seq").cast("long").alias("len")), "rec", "len", "start"), "axis")
    axis = rows.select("rec", "name", "offset", "seq").join(placed, "rec").select("rec", "name", "start", "len", "offset", normalise(F.col("seq")).alias("seq"))
    if placed.filter("len > 0").isEmpty():
        raise EngineError("No sequence found.")
    return axis


def warnings(records: DataFrame) -> DataFrame:
    """kind and name: `mid_line_gt` and `empty` records, `duplicate` names."""
    each = records.select(F.explode(F.array_compact(F.array(F.when(F.col("n_gt") > 0, "mid_line_gt"), F.when(F.length("seq") == 0, "empty")))).alias("kind"), "name")
    double = records.groupBy("name").count().filter("count > 1").select(F.lit("duplicate").alias("kind"), "name")
    return each.unionByName(double)


def looks_like_fasta(head: bytes) -> bool:
    """The first byte that is not white space, of up to 4 KB, is '>' or ';'."""
    return head[:4096].lstrip()[:1] in (b">", b";")


def region_as_fasta(name: str, start: int, seq: str, width: int = 60) -> str:
    """A region as a FASTA record that says where it lies."""
    lines = [seq[i : i + width] for i in range(0, len(seq), width)]
    return "\n".join([f">{name} @offset={start}", *lines, ""])
