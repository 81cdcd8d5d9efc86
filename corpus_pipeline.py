"""A corpus from raw documents to token ids in five stages, each one operator over all that the stage before has kept.

Stages write Parquet and read it again, so a lost executor never costs more than the stage that runs.

What holds for every stage: `docs` has the columns doc_id, text, lang and source, and any others. Inside a stage columns go by number, so no name of the caller's can meet one of an operator's: extra columns of any name come out as they went in. Null keys and sources are values like any other. Texts are read whole. Repeated rows are rows of their own. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.bpe import decode, encode
from kmerloom.llm.common import discard_since, documents, join_small, materialize, written
from kmerloom.llm.exact_dedup import exact_dedup
from kmerloom.llm.language_id import LETTER, UNDETERMINED, identify
from kmerloom.llm.mixing import copies, mix
from kmerloom.llm.near_dedup import near_dedup
from kmerloom.llm.textkit import give_back, parts


class Numbered:
    """The rows of docs with columns c0, c1, ..., and the way back."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.key, self.text, self.lang, self.source = (f"c{self.names.index(c)}" for c in ("doc_id", "text", "lang", "source"))

    def named(self, rows: DataFrame) -> DataFrame:
        return rows.select([F.col(f"c{i}").alias(c) for i, c in enumerate(self.names)])

    def mark(self) -> list[Column]:
        """What tells rows apart: the id, null made comparable, and a hash of the text."""
        return [F.coalesce(F.col(self.key).cast("string"), F.lit("")).alias("__at"), F.xxhash64(F.col(self.text)).alias("__hash")]


def _lettered(text: str):
    """Rows whose text has a letter, by the rule of identify()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array([x is not None and bool(LETTER.search(x)) for x in batch.column(text).to_pylist()], pa.bool_()))
        give_back()

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: a null or empty text, and one without a letter. A missing lang is filled in, or stays null where no row has one to learn from."""
    own = Numbered(docs)
    if own.rows.filter(F.col(own.text).isNotNull() & F.col(own.lang).isNotNull()).isEmpty():
        return own.named(own.rows.mapInArrow(_lettered(own.text), own.rows.schema))
    known = identify(own.rows, own.rows, own.key, own.text, own.lang)
    return own.named(known.filter(F.col("lang_pred") != UNDETERMINED).withColumn(own.lang, F.coalesce(own.lang, "lang_pred")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the document with the largest id stays; a null id is below all others."""
    own = Numbered(docs)
    return own.named(exact_dedup(own.rows, own.key, own.text, heads_only=True))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8) the document with the least id stays. Texts without words are near to nothing and stay."""
    own = Numbered(docs)
    gone = near_dedup(own.rows, own.key, own.text, shingle=5, percent=80).filter("NOT kept").select(F.coalesce(F.col(own.key).cast("string"), F.lit("")).alias("__at"), "__hash").distinct()
    gone = materialize(gone, "pipeline-near")
    return own.named(join_small(own.rows.select("*", *own.mark()), gone, ["__at", "__hash"], "left_anti", salt=["__hash"], salts=1))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to weights 1, 2, 3, repeating: a document stands as many times as the mix takes it. The one that a source's budget cuts stands whole; texts without words are taken 0 times and go."""
    own = Numbered(docs)
    taken = mix(own.rows, own.key, own.source, own.text, mark=F.xxhash64(F.col(own.text))).filter("taken > 0")
    taken = taken.select(F.coalesce(F.col(own.key).cast("string"), F.lit("")).alias("__at"), F.col("mark").alias("__hash"), copies(F.col("taken"), F.col("size")).alias("__n")).groupBy("__at", "__hash").agg(F.max("__n").alias("__n"))
    rows = own.rows.select("*", *own.mark()).join(taken, ["__at", "__hash"])
    return own.named(rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with n_tokens and ids, the token ids of each text, and the text as the ids decode to it (empty for null). Extra columns named n_tokens or ids, in any case, are replaced."""
    own = Numbered(docs)
    coded = decode(encode(own.rows, own.text, "ids").drop(own.text), "ids", "decoded")
    keep = [(f"c{i}", c) for i, c in enumerate(own.names) if c.lower() not in ("n_tokens", "ids")]
    return coded.select(*[(F.col("decoded").cast("string") if c == own.text else F.col(c)).alias(name) for c, name in keep], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixture", mixture), ("byte_bpe", tokens)]

#: Expectation-maximisation, MinHash and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        before = written() - {getattr(docs, "_kmerloom_path", None)}
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_since(before, docs)
    return docs
