"""Which records' k-mers belong to which: containment of records with copies counted, both strands as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.model import BELONGS_MAX, BELONGS_MIN, EngineError
from kmerloom.operators import packed, pairs
from kmerloom.operators.kmers import record_kmers
from kmerloom.plans.tables import stored


def species_counts(kmers: DataFrame) -> DataFrame:
    """rec, kv, n: copies of each canonical k-mer in each record, of a k-mer table; record_kmers() makes the same of an axis."""
    return kmers.groupBy("rec", "kv").agg(F.count(F.lit(1)).alias("n"))


def check_records(axis: DataFrame, most: int | None = BELONGS_MAX) -> None:
    """2 to 64 records; `most` None lifts the upper bound."""
    n = axis.limit((most or BELONGS_MIN) + 1).count()
    if n < BELONGS_MIN or (most and n > most):
        raise EngineError(f"{BELONGS_MIN} to {most or 'any number of'} records are needed.")


def masses(counts: DataFrame) -> DataFrame:
    """rec, total (windows), unique_total (k-mers that the record holds once)."""
    return counts.groupBy("rec").agg(F.sum("n").cast("long").alias("total"), F.count_if(F.col("n") == 1).alias("unique_total"))


def belongs(counts: DataFrame) -> DataFrame:
    """A row for each ordered pair of records i, j that share a k-mer: shared (sum of the lesser copies), exclusive (the same over k-mers of just these two records), unique (k-mers that i holds once and j holds), cross_mass (i's copies of shared k-mers)."""
    common = counts.withColumn("n_rec", F.count(F.lit(1)).over(Window.partitionBy("kv"))).filter("n_rec > 1")
    a, b = (common.select("kv", "n_rec", F.col("rec").alias(i), F.col("n").alias(f"n_{i}")) for i in "ij")
    pairs = a.join(b.drop("n_rec"), "kv").filter("NOT i <=> j")
    less = F.least("n_i", "n_j")
    return pairs.groupBy("i", "j").agg(
        F.sum(less).cast("long").alias("shared"), F.sum(F.when(F.col("n_rec") == 2, less).otherwise(0)).cast("long").alias("exclusive"),
        F.count_if(F.col("n_i") == 1).alias("unique"), F.sum("n_i").cast("long").alias("cross_mass"),
    )


def between(pieces: DataFrame, k: int, by: str = "rec", scaled: int = 1) -> tuple[DataFrame, DataFrame]:
    """belongs() and masses() of the groups `by` of an axis in pieces (spread), whose k-mers are enumerated and dealt out once: pairs of groups are added up where k-mers meet, and stored. With more groups than that takes, by joins."""
    names = stored(pieces.groupBy(by).agg(F.sum("len").alias("bases")), "groups")
    n, bases = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("bases"), F.lit(0))).first()
    if not pairs.fits(n):
        counts = stored(record_kmers(pieces, k, scaled, by).withColumnRenamed(by, "rec"), "records", by="kv")
        return belongs(counts), masses(counts)
    # So few names are numbered in one task, and sent to all.
    names = stored(names.select(by).withColumn("g", (F.row_number().over(Window.orderBy(by)) - 1).cast("long")), "numbered")
    coded = pieces.join(F.broadcast(names), pieces[by].eqNullSafe(names[by])).drop(names[by])
    lay = packed.layout(k, n, bases // scaled)
    rows = packed.packed(coded, ["g"], lambda batch, row, place: batch.column("g").to_numpy()[row], lay, scaled=scaled, least=True)
    sums = stored(pairs.packed_sums(rows, lay, n), "belongs")
    i, j = (names.select(F.col("g").alias(x), F.col(by).alias(f"{x}_name")) for x in "ij")
    totals = sums.filter("i = j").join(F.broadcast(i), "i").select(F.col("i_name").alias("rec"), "total", F.col("unique").alias("unique_total"))
    both = sums.filter("i <> j")
    half = both.select("i", "j", "shared", "exclusive").filter("i < j")
    common = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "shared", "exclusive"))
    rows = both.select("i", "j", "unique", "cross_mass").join(F.broadcast(common), ["i", "j"]).join(F.broadcast(i), "i").join(F.broadcast(j), "j")
    return rows.select(F.col("i_name").alias("i"), F.col("j_name").alias("j"), "shared", "exclusive", "unique", "cross_mass"), totals


def with_metrics(pairs: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """containment (of i in j), back (of j in i), identity, exclusive_share, unique_share (null if i has no single k-mer) and copy_ratio (of j's copies to i's, null within 15 per cent of 1)."""
    i, j = (totals.select(F.col("rec").alias(x), F.col("total").alias(f"total_{x}"), F.col("unique_total").alias(f"unique_{x}")) for x in "ij")
    back = pairs.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("cross_mass").alias("cross_back"))
    ratio: Column = F.col("cross_back") / F.col("cross_mass")
    rows = pairs.join(i, "i").join(j, "j").join(back, ["i", "j"])
    return rows.select(
        "i", "j", (F.col("shared") / F.col("total_i")).alias("containment"), (F.col("shared") / F.col("total_j")).alias("back"),
        F.pow(F.col("shared") / F.least("total_i", "total_j"), F.lit(1.0) / k).alias("identity"), (F.col("exclusive") / F.col("total_i")).alias("exclusive_share"),
        (F.col("unique") / F.nullif("unique_i", F.lit(0))).alias("unique_share"), F.when((ratio >= 1.15) | (ratio <= 1 / 1.15), ratio).alias("copy_ratio"),
    )


def contamination(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item, doc, shared and containment (of the item in the document), from species counts of both."""
    a = items.select(F.col("rec").alias("item"), "kv", F.col("n").alias("n_item"))
    b = docs.select(F.col("rec").alias("doc"), "kv", F.col("n").alias("n_doc"))
    total = a.groupBy("item").agg(F.sum("n_item").alias("total"))
    shared = a.join(b, "kv").groupBy("item", "doc").agg(F.sum(F.least("n_item", "n_doc")).cast("long").alias("shared"))
    return shared.join(total, "item").select("item", "doc", "shared", (F.col("shared") / F.col("total")).alias("containment"))
