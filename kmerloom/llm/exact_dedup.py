"""Exact dedup by content sort: sampled splitters deal normalised content into ranges, each range is sorted so that equal texts lie side by side, and neighbours are compared in full.

The order is that of the first bytes of the normalised text and, among texts that begin alike, of its digest. Spark samples whole keys for its splitters and sends them to the driver, some dozens for each partition, so keys must be of bounded length: the digest stands for the content beyond the first bytes. It is equal for equal contents and spreads those that begin alike. Whether neighbours are equal is settled by their contents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import documents, field, materialize, only
from kmerloom.llm.textkit import give_back, parts

#: Bytes of the normalised text that lead the sort key; its digest follows, so that texts with a common start are dealt out as well.
LEAD = 32
ROWS_OUT = 512


def _keyed(text: str, schema: pa.Schema):
    """Adds the sort key. Texts count as equal when they are so after A-Z is lower-cased, null as empty: bytes.lower() does just that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            norm = [(x or b"").lower() for x in batch.column(text).cast(pa.binary()).to_pylist()]
            lead, digest = pa.array([x[:LEAD] for x in norm], pa.binary()), pa.array([hashlib.sha256(x).digest() for x in norm], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, lead, digest], names=[*batch.schema.names, "__lead", "__digest"])
        give_back()

    return run


def _runs(key: str, text: str, carried: list[str], heads_only: bool):
    """Runs of equal neighbours in a sorted partition. The first row of a run is the one with the largest key.

    Of the rows that are not heads only keys are held until the run ends. The first and the last run of a partition may go on in the next one: their heads carry their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        out: list[tuple] = []
        run_no, last, head, keys = -1, None, None, []

        def close(edge: bool) -> None:
            if head is None:
                return
            n, keep = len(keys), keys[0]
            bound = last if edge else None
            for i, k in enumerate(keys[:1] if heads_only else keys):
                out.append((k, keep, n, i == 0, head[0], pid, run_no, edge, bound if i == 0 else None, *(head[1] if heads_only else ())))

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal out
            while len(out) >= max(least, 1):
                part, out = out[:ROWS_OUT], out[ROWS_OUT:]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part), kinds, strict=True)], names=names)

        names = ["__id", "keep_id", "group_size", "kept", "__digest", "__pid", "__run", "__edge", "__text", *(carried if heads_only else [])]
        kinds = None
        for batch in parts(batches):
            if kinds is None:
                kind = batch.schema.field(key).type
                kinds = [kind, kind, pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), *([batch.schema.field(c).type for c in carried] if heads_only else [])]
            ids, digests = batch.column(key).to_pylist(), batch.column("__digest").to_pylist()
            texts = batch.column(text).cast(pa.binary())
            rest = [batch.column(c) for c in carried] if heads_only else []
            for i, digest in enumerate(digests):
                norm = (texts[i].as_py() or b"").lower()
                if head is None or digest != head[0] or norm != last:
                    close(run_no == 0)
                    run_no, last, keys = run_no + 1, norm, []
                    head = (digest, tuple(c[i].as_py() for c in rest))
                if heads_only and keys:
                    keys.append(None)
                else:
                    keys.append(ids[i])
            yield from flush(ROWS_OUT)
        close(True)
        yield from flush(1)
        give_back()

    return run


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", heads_only: bool = False) -> DataFrame:
    """Of rows with equal texts (A-Z lower-cased, null as empty) the one with the largest key stays; a null key is below all others.

    Returned is a row for each row of df: key, keep_id (key of the row that stays), group_size, kept, text_sha256 (hex, of the normalised text). Of rows that repeat with the same key, one stays.
    With `heads_only` the rows that stay come with all columns of df, and nothing else. Columns of df with names of the operator's own (any case) or a name that occurs twice are left out. Empty tables give empty ones.
    Texts of any length are compared whole. A group of copies may be of any size: the sort ends with the key, so splitters cut the group, and what lies in neighbouring partitions is put together from one row for each, two for a partition at most.
    """
    own = ["__id", "keep_id", "group_size", "kept", "text_sha256", "__lead", "__digest", "__pid", "__run", "__edge", "__text"]
    df = only(df, [key, text], own)
    carried = [c for c in df.columns if c != key] if heads_only else []
    df = df.select(key, text, *[c for c in carried if c != text])
    keyed = df.mapInArrow(_keyed(text, None), T.StructType([*df.schema.fields, field("__lead", "binary"), field("__digest", "binary")]))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("__lead"), F.col("__digest"), F.col(key).desc_nulls_last()]
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = df.schema[key].dataType
    schema = T.StructType([
        T.StructField("__id", kind), T.StructField("keep_id", kind), field("group_size", "long"), field("kept", "boolean"), field("__digest", "binary"),
        field("__pid", "int"), field("__run", "long"), field("__edge", "boolean"), field("__text", "binary"), *[df.schema[c] for c in carried],
    ])
    runs = materialize(sorted_.mapInArrow(_runs(key, text, carried, heads_only), schema), "dedup-runs")
    # A row for the first and the last run of each partition, two for each partition at most: without texts, some dozens of bytes a row.
    edges = runs.filter("__edge AND kept").select("__digest", "__text", "__pid", "__run", "keep_id", "group_size")
    whole = Window.partitionBy("__digest", "__text")
    fixes = edges.select("__pid", "__run", F.sum("group_size").over(whole).alias("__n"), F.min(F.struct("__pid", "__run", "keep_id")).over(whole).alias("__first"))
    out = runs.join(F.broadcast(fixes), ["__pid", "__run"], "left")
    fixed = F.col("__first").isNotNull()
    out = out.withColumns({
        "keep_id": F.when(fixed, F.col("__first.keep_id")).otherwise(F.col("keep_id")), "group_size": F.coalesce("__n", "group_size"),
        "kept": F.col("kept") & (~fixed | ((F.col("__first.__pid") == F.col("__pid")) & (F.col("__first.__run") == F.col("__run")))),
    })
    if heads_only:
        return out.filter("kept").select(F.col("__id").alias(key), *carried)
    return out.select(F.col("__id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP7_SQL = """
WITH norm AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER g AS place
  FROM norm WINDOW g AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""
