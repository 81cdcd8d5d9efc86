"""K-mer counts over a stream of records: an addition to the batch engine, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.kmers import canonical_kmers


def stream_counts(records: DataFrame, k: int, scaled: int = 1) -> DataFrame:
    """kv and n of a streaming axis (rec, start, seq), to be written in update or complete mode. State is a row for each k-mer; value sampling bounds it."""
    return canonical_kmers(records, k, scaled).groupBy("kv").agg(F.count(F.lit(1)).alias("n"))
