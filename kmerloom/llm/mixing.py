"""Mixing sources to target weights: hash-random keys, ranges sorted within each source, distributed prefix sums of word counts and a cut at each source's exact budget, with repeated epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.llm.common import WORD, documents, join_small, key_range, materialize, only, random_key, range_bits, running_total

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most times that a source's words may be repeated.
EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: n_rows, source_size, weight and target.

    The targets share `share` of all sizes by weight; none is above `epochs` times its source's size, and what that leaves over is shared by weight among the others. In closed form: target = least(level * weight, epochs * size), where the level is found in order of epochs * size / weight.
    Sources are sorted in one task: it gets one row for each source, not for each document.
    """
    stats = sized.groupBy("__source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("source_size"))
    rank = Window.partitionBy(F.lit(0)).orderBy("__source")
    everything = Window.partitionBy(F.lit(0))
    stats = stats.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")))
    stats = stats.withColumn("cap", F.col("source_size") * epochs)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap").cast("double") / F.col("weight"), "__source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumns({"free": F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)), "place": F.row_number().over(order)})
    stats = stats.withColumn("level", F.col("free").cast("double") / F.col("rest").cast("double"))
    fits = F.when(F.col("level") <= F.col("cap").cast("double") / F.col("weight"), F.struct("place", "level"))
    stats = stats.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return stats.select("__source", "n_rows", "source_size", "weight", target.alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, epochs: int = EPOCHS, mark: Column | None = None) -> DataFrame:
    """One row for each row of df: key, source, size (words), source_size, target (of its source), taken (words that the mix takes from it, repeats counted); and `mark`, a column expression that tells rows apart, if given.

    In each source rows lie in the order of a random key made from the row's key. A source's budget is its target, rounded; the mix takes every row as often as the source's size goes into the budget, then rows from the start until the rest is used up, the last of them in part.
    A null source is a source of its own and comes last. A null text has no words and is taken 0 times; texts of any length count whole. Rows with equal keys lie side by side; wholly equal rows share what falls on them in any order. Other columns are not read. Empty tables give empty ones.
    """
    df = only(df, [key, source, text])
    code = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    marks = [] if mark is None else [mark.alias("mark")]
    sized = materialize(df.select(F.col(key).alias("__id"), F.col(source).alias("__name"), code.alias("__source"), word_count(F.col(text)).alias("size"), random_key(F.col(key)).alias("__key"), *marks), "mix-sized")
    targets = materialize(source_targets(sized, weights, share, epochs), "mix-targets")
    budget = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * epochs)
    size = F.greatest(F.col("source_size"), F.lit(1))
    targets = targets.withColumns({"__times": F.floor(budget / size).cast("long"), "__rest": F.pmod(budget, size), "__bits": range_bits(F.col("n_rows"))})
    rows = join_small(sized, targets, ["__source"], salt=["__key"]).withColumn("__range", key_range(F.col("__key"), F.col("__bits")))
    tie = ["mark"] if marks else []
    rows = running_total(rows, ["__source"], "__range", [F.col(c) for c in ("__key", "__id", "size", *tie)], F.col("size"), "__before")
    taken = F.col("__times") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("__rest") - F.col("__before")))
    return rows.select(F.col("__id").alias(key), F.col("__name").alias(source), "size", "source_size", "target", taken.alias("taken"), *tie)


def copies(taken: Column, size: Column) -> Column:
    """Whole copies of a row that hold the words taken; the row that a budget cuts counts whole."""
    return F.ceil(taken / F.greatest(size, F.lit(1))).cast("int")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS k
  FROM documents),
stats AS (
  SELECT s, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS BIGINT) AS w
  FROM sized GROUP BY s),
ordered AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS place,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM stats WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, s)),
lev AS (SELECT arg_min(level, place) AS level FROM ordered WHERE level <= CAST(cap AS DOUBLE) / w),
targets AS (
  SELECT s, source_size, least(coalesce(lev.level * w, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target, greatest(source_size, 1) AS one
  FROM ordered CROSS JOIN lev),
budgets AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS budget FROM targets),
rows_ AS (
  SELECT doc_id, size, source_size, target, budget // one AS times, budget % one AS rest,
         CAST(sum(size) OVER (PARTITION BY s ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
  FROM sized JOIN budgets USING (s))
SELECT doc_id, size, source_size, target, CAST(times * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken
FROM rows_
"""
