"""Indexes that outlive a comparison: bucketed and sorted by k-mer, under a name made of what they were built from.

A later comparison with the same target, k and stride finds the index by that name and enumerates nothing; because the table is dealt out by k-mer already, joins and counts by k-mer need no exchange on its side. Another target, or the same with one base changed, has another name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.model import MatchOptions
from kmerloom.operators.kmers import spread
from kmerloom.operators.match import target_index

COLUMNS = "trec long, t long, kv long"


def fingerprint(axis: DataFrame, options: MatchOptions) -> str:
    """What an index depends on: the records, their order and their bases, k and stride. One pass over the bases, which are hashed and not enumerated."""
    each = F.xxhash64("rec", "start", "len", "seq")
    sums = axis.agg(F.count(F.lit(1)), F.sum("len"), F.bit_xor(each), F.bit_xor(F.xxhash64(F.lit(1), "rec", "start", "len", F.reverse("seq")))).first()
    return hashlib.sha256(repr((tuple(sums), options.k, options.stride)).encode()).hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def kept_index(target: DataFrame, options: MatchOptions, folder: str, buckets: int | None = None) -> DataFrame:
    """trec, t, kv of a target axis, from `folder` if it is there, else made and left there. A run that breaks off leaves nothing that counts as an index: the mark of a finished write comes last."""
    spark = target.sparkSession
    key = fingerprint(target, options)
    name, path = f"kmerloom_index_{key}", f"{folder.rstrip('/')}/index-{key}"
    if _exists(spark, path):
        n = spark.read.text(f"{path}-buckets").first()[0]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (trec BIGINT, t BIGINT, kv BIGINT) USING parquet CLUSTERED BY (kv) SORTED BY (kv) INTO {int(n)} BUCKETS LOCATION '{path}'")
        return spark.table(name)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([(str(n),)], "n string").coalesce(1).write.mode("overwrite").text(f"{path}-buckets")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    target_index(spread(target), options).repartition(n, "kv").write.mode("overwrite").bucketBy(n, "kv").sortBy("kv").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
