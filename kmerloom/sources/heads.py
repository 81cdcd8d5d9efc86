"""The first bytes of files, by the file system that Spark knows."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession

from kmerloom.model import EngineError
from kmerloom.sources import bgzf
from kmerloom.sources.ranges import locate

#: Bytes that are looked at to tell what a file is.
HEAD = 64 * 1024


def head_of(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file, of its content if it is gzip; the file system that Spark knows opens it, and no more is read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        data = bytes(stream.readNBytes(size))
    finally:
        stream.close()
    return zlib.decompressobj(31).decompress(data, size) if data[:2] == b"\x1f\x8b" else data


def is_bgzf(spark: SparkSession, path: str) -> bool:
    """Whether a file, or the first file of a folder, is BGZF and can be read by ranges. Only names that end in .gz, .bgz or .bgzf are looked into; patterns of names are not. What only Spark's readers reach is left to them: they read a file in one task."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isDirectory():
        inside = sorted(str(x.getPath()) for x in files.listStatus(place) if x.isFile() and x.getPath().getName()[0] not in "._")
        path = inside[0] if inside else ""
    if not path.lower().endswith((".gz", ".bgz", ".bgzf")):
        return False
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.exists(place):
        return False
    try:
        locate(path if "://" in path or path.startswith("/") else str(files.makeQualified(place)))
    except EngineError:
        return False
    stream = files.open(place)
    try:
        return bgzf.is_bgzf(bytes(stream.readNBytes(HEAD)))
    finally:
        stream.close()
