"""Tables and files that the engine writes for itself, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from kmerloom.model import EngineError

_local: dict[str, str] = {}
_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local application gets a folder of its own, and a cluster an error: what an executor writes to its own disk the others don't see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master.partition("[")[0] != "local":
        raise EngineError("Set spark.checkpoint.dir to a folder that all executors share.")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
        _made[_local[context.applicationId]] = spark
    return _local[context.applicationId]


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses. What is written there goes when the application ends, or by release()."""
    path = f"{shared_folder(spark)}/kmerloom/{label}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df written as Parquet and read again: made once however often it is used, and a lost executor costs nothing that came before. by: a column that rows are sorted by inside each file, so that its ranges can be skipped."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    (df.sortWithinPartitions(by) if by else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kmerloom_path = path
    return out


def release(*what: DataFrame | str) -> None:
    """Delete stored tables, or scratch paths, that nothing reads any more."""
    for x in what:
        path = x if isinstance(x, str) else getattr(x, "_kmerloom_path", None)
        if path in _made:
            delete(_made.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            delete(spark, path)
        except Exception:  # the JVM has gone before us
            return
