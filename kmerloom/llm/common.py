"""What the corpus operators share: tables in the shared folder, joins with small sides, running totals over any number of tasks."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of every operator: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast. Tables beyond it are joined by a salted shuffle.
BROADCAST_ROWS = 20_000

_written: dict[str, SparkSession] = {}
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local application gets a folder of its own and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _folders:
            _folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        folder = _folders[context.applicationId]
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kmerloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    # Shuffle files of steps that are over stay until the driver's JVM collects what refers to them.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._kmerloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later step reads."""
    for df in tables:
        path = getattr(df, "_kmerloom_path", None)
        if path in _written:
            _delete(_written.pop(path), path)


def written() -> set[str]:
    """The tables that materialize() has written and that are still there."""
    return set(_written)


def discard_since(before: set[str], keep: DataFrame) -> None:
    """Delete the tables written since, but for the one that is read on."""
    for path in set(_written) - before - {getattr(keep, "_kmerloom_path", None)}:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM has gone before us
            return


def only(df: DataFrame, needed: Sequence[str], reserved: Sequence[str] = ()) -> DataFrame:
    """df without columns whose names, in any case, are an operator's own. A name that occurs twice is dropped unless it is needed; a needed one counts in its exact case, once."""
    taken = {x.lower() for x in (*needed, *reserved)}
    names = [x.lower() for x in df.columns]
    place = {}
    for i, c in enumerate(df.columns):
        if c in needed and c not in place:
            place[c] = i
    for c in needed:
        if c not in place:
            if names.count(c.lower()) != 1:
                raise ValueError(f"no column {c}")
            place[c] = names.index(c.lower())
    rest = [i for i, n in enumerate(names) if i not in place.values() and n not in taken and names.count(n) == 1]
    unique = df.toDF(*[f"c{i}" for i in range(len(names))])
    return unique.select(*[F.col(f"c{i}").alias(c) for c, i in place.items()], *[F.col(f"c{i}").alias(df.columns[i]) for i in rest])


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salt: Sequence[str] = (), limit: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join with a side that is small as a rule: broadcast up to `limit` rows, which are counted, else a shuffle in which each key of the big side is spread over `salts` tasks by the columns `salt`."""
    if small.count() <= limit:
        return big.join(F.broadcast(small), list(on), how)
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt or big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.hint("shuffle_merge").join(right, [*on, "__salt"], how).drop("__salt")


def random_key(*columns: Column) -> Column:
    """60 bits that depend on the columns alone: the first 15 hex digits of an MD5."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def range_bits(rows: Column) -> Column:
    """Bits of a random key that cut `rows` rows into about as many ranges as each range has rows."""
    return F.least(F.lit(24), F.greatest(F.lit(0), F.round(F.log2(F.greatest(rows, F.lit(1)).cast("double")) / 2).cast("int")))


def key_range(key: Column, bits: Column) -> Column:
    """The range of a 60-bit key: its first bits."""
    return F.floor(key / F.pow(F.lit(2.0), F.lit(60) - bits)).cast("long")


def running_total(df: DataFrame, group: Sequence[str], part: str, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Add, in `out`, the sum of `value` over the rows of the group that come earlier in `order`.

    `part` cuts each group into ranges that follow `order`. Sums of the ranges are added up first, so that no task sorts more than a range: that holds for a group with a third of all rows too.
    """
    keys = [*group, part]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    sums = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__earlier"))
    own = df.withColumn(out, F.sum(value).over(inside) - value)
    return own.join(sums, keys).withColumn(out, (F.col(out) + F.col("__earlier")).cast("long")).drop("__earlier")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table `documents`. Where its scan has fewer tasks than there are cores, as that of one small file, its rows are dealt out."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)
