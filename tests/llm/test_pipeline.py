"""The pipeline's stages, each against a plain version of it."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import rows
from test_operators import encoding, lower, near_by_hand, words

import corpus_pipeline as P

#: Names that the operators and the stages use themselves, or that Spark takes for the same.
NAMES = ["score", "Lang_Pred", "lang_set", "kept", "keep_id", "GROUP_SIZE", "text_sha256", "__lead", "__digest", "__id", "__text", "__hash", "__at", "__n", "__copy", "c0", "C1", "mark", "taken", "size", "n_shingles", "component_id", "decoded", "__salt"]


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def test_stages(spark, docs, data):
    assert [n for n, _ in P.STAGES] == ["language", "exact_dedup", "near_dedup", "mixture", "byte_bpe"]
    one = P.language(spark, docs, data)
    assert one.columns == docs.columns
    assert Counter(r.doc_id for r in one.collect()) == Counter(i for i, t, *_ in rows() if any(c.isalpha() for c in t or ""))
    two = P.exact(spark, docs, data)
    assert two.columns == docs.columns and two.count() == len({lower(t) for _, t, *_ in rows()})
    three = P.near(spark, two, data)
    kept = {i for (i, _, c), _ in near_by_hand([(r.doc_id, r.text) for r in two.collect()], 5, 80).items() if i == c}
    assert {r.doc_id for r in three.collect()} == kept and three.columns == docs.columns
    four = P.mixture(spark, two, data)
    assert four.columns == docs.columns
    most = Counter(r.doc_id for r in four.collect())
    assert max(most.values()) <= 3 and set(most) <= {r.doc_id for r in two.collect() if words(r.text)}
    enc = encoding()
    for r in P.tokens(spark, docs, data).collect():
        assert r.ids == enc.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_extra_columns_of_any_name(spark, docs, data, name):
    """Extra columns come out with the values that they had; what is kept is the same with and without them."""
    from pyspark.sql import functions as F

    stage = dict(P.STAGES)[name]
    wide = docs.select("*", *[F.concat_ws("/", F.lit(c), "doc_id", F.xxhash64("text")).alias(c) for c in NAMES])
    out = stage(spark, wide, data)
    assert out.columns[: len(wide.columns)] == wide.columns
    got, want = out.collect(), stage(spark, docs, data).collect()
    mark = lambda r: (str(r.doc_id), r.text or "", str(r.source))
    assert Counter(map(mark, got)) == Counter(map(mark, want))
    known = {tuple(r[c] for c in NAMES) for r in wide.collect()}
    assert got and all(tuple(r[c] for c in NAMES) in known for r in got)


def test_empty_table(spark, empty, data):
    for _, stage in P.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_run(spark, data):
    out = P.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    known = {r.doc_id: r.text for r in docs.collect()}
    got = out.collect()
    assert got and all(known[r.doc_id] == r.text for r in got) and P.ORACLE_SQL is None


def test_language_without_labels(spark, docs, data):
    from pyspark.sql import functions as F

    out = P.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), data)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and Counter(r.doc_id for r in got) == Counter(i for i, t, *_ in rows() if any(c.isalpha() for c in t or "")) and all(r.lang is None for r in got)
