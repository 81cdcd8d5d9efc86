"""Records held against each other, and one record explained by the others: guards, the rate of sampling and the k-mer tables are settled here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.sequence import scaled_for
from kmerloom.model import BELONGS_MAX, SKETCH_CAP, EngineError
from kmerloom.operators import belongs, gather
from kmerloom.operators.kmers import canonical_kmers, spread, total_length


def sampling(axis: DataFrame, scaled: int | None) -> int:
    """1 in how many distinct k-mers is taken: what is asked for (1: all of them), or as many as keep the axis within SKETCH_CAP."""
    if scaled is not None and scaled < 1:
        raise EngineError("scaled must be 1 or more")
    return scaled or scaled_for(total_length(axis), SKETCH_CAP)


def compare_records(axis: DataFrame, k: int = 15, most: int | None = BELONGS_MAX, scaled: int | None = None) -> DataFrame:
    """Metrics of each ordered pair of records that share a k-mer (belongs.with_metrics). Fewer than two records, or more than `most`, are an error. Long axes are sampled by value unless `scaled` is 1."""
    belongs.check_records(axis, most)
    found, masses = belongs.between(spread(axis), k, "rec", sampling(axis, scaled))
    return belongs.with_metrics(found, masses, k)


@dataclass
class Explained:
    """Components by mass, the report of the heaviest, and what explains each slice of the record."""

    components: DataFrame
    report: DataFrame
    strip: DataFrame
    truncated: bool


def explain_record(axis: DataFrame, rec: int, k: int = 15, tile_bp: int | None = None, top: int = 8, scaled: int | None = None) -> Explained:
    """One record as a cover by windows of the others. Long axes are sampled by value unless `scaled` is 1; the rounds need memory for the record's k-mers that are taken."""
    belongs.check_records(axis, None)
    table = canonical_kmers(spread(axis), k, sampling(axis, scaled))
    rows, width, slice_bp = gather.gather(table, axis, rec, tile_bp)
    rows = rows.cache()
    total = rows.filter("kind = 'total'").first()
    found = gather.components(rows, axis, width)
    own = table.filter(F.col("rec") == rec).join(axis.select("rec", "start"), "rec").groupBy(F.floor((F.col("pos") - F.col("start")) / slice_bp).cast("long").alias("slice")).agg(F.count(F.lit(1)).alias("total"))
    return Explained(found, gather.summary(found, total["mass"], top), gather.strip(rows, own), bool(total["place"]))
