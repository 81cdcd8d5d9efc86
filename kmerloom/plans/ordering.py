"""Running totals, and unions of intervals, over rows in order, in two levels: over ranges of the order, then inside each, so that no task sorts the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = 4096
#: Width of the ranges of an axis in which intervals are put together.
SPAN = 1 << 20


def with_running_total(df: DataFrame, order: str, value: str, out: str, width: int = RANGE, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add, in `out`, the sum of `value` over rows (of equal keys, if any) with smaller `order` (an integer that no two rows share)."""
    ranged = df.withColumn("__range", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*(keys or (F.lit(0),))).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum")).select(*keys, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__earlier"))
    own = ranged.withColumn(out, F.sum(value).over(inside) - F.col(value))
    return own.join(sums, [*keys, "__range"]).withColumn(out, (F.col(out) + F.col("__earlier")).cast("long")).drop("__range", "__earlier")


def with_group(df: DataFrame, start: str, end: str, gap: float = 0, keys: tuple[str, ...] = (), out: str = "group", width: int = SPAN) -> DataFrame:
    """Add, in `out`, the start of the group that an interval belongs to: a group begins where an interval starts more than `gap` after all before it end.

    How far the intervals of earlier ranges reach, and where the last group before a range begins, are found from one row for each range.
    """
    own = [F.col(c) for c in keys]
    earlier = Window.partitionBy(*(own or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*own, "__part").orderBy(start, end)
    rows = df.withColumn("__part", F.floor(F.col(start) / width))
    reach = rows.groupBy(*keys, "__part").agg(F.max(end).alias("__end")).select(*keys, "__part", F.max("__end").over(earlier).alias("__reach"))
    rows = rows.join(reach, [*keys, "__part"])
    before = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    rows = rows.withColumn("__new", F.when(F.col(start) - before <= gap, None).otherwise(F.col(start)))
    last = rows.groupBy(*keys, "__part").agg(F.max("__new").alias("__last")).select(*keys, "__part", F.max("__last").over(earlier).alias("__from"))
    rows = rows.join(last, [*keys, "__part"])
    begun = F.max("__new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(out, F.coalesce(begun, "__from")).drop("__part", "__reach", "__new", "__from")
