"""Language identification by a mixture of languages.

Each language has a model of byte trigrams inside words. A text is a mixture: each word comes from one of the languages. Expectation-maximisation estimates the proportions from the words' n-gram likelihoods; of nested sets of languages the one with the best penalised likelihood (BIC) is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import documents, field, only, random_key
from kmerloom.llm.textkit import Slice, give_back, parts, slices, words

#: Trigrams are hashed into so many cells.
CELLS = 1 << 16
#: Of each language's labelled texts about so many are learned from: each text is in or out by a random key of its id.
SAMPLE = 4000
#: Steps of expectation-maximisation from all languages; half as many after a language goes.
ROUNDS = 6
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def cells(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells of a slice's words (each word between two blanks), where each word's cells start, and each text's first word."""
    w = words(s)
    if not len(w.begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.first
    lengths = w.ends - w.begins
    starts = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    mid = w.data[w.letters].astype(np.uint32)
    left, right = np.empty_like(mid), np.empty_like(mid)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[starts], right[starts + lengths - 1] = 32, 32
    gram = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    return ((gram * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), starts, w.first


def _counts(text: str, lang: str):
    """Trigram counts of each language in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            tags = np.array(batch.column(lang).to_pylist(), object)
            for s in slices(batch.column(text)):
                gram, starts, first = cells(s)
                sizes = np.diff(np.append(starts, len(gram))[first])
                for tag in set(tags[s.lo : s.hi]):
                    own = gram[np.repeat(tags[s.lo : s.hi] == tag, sizes)]
                    found[tag] = found.get(tag, 0) + np.bincount(own, minlength=CELLS)
        for tag, n in found.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], names=["lang", "cell", "n"])

    return run


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """The languages in order and log-probabilities, a row for each language, of the trigram cells (add 1/2). Rows without text or language are left out; the driver gets as many rows as there are languages times cells at most."""
    labelled = labelled.select(key, text, lang).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, CELLS), np.float32)
    share = F.element_at(F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, sample / sizes[k])))]), F.col(lang))
    taken = labelled.filter((random_key(F.col(key)) / float(1 << 60)) <= share)
    schema = T.StructType([field("lang", "string"), field("cell", "int"), field("n", "long")])
    table = taken.select(text, lang).mapInArrow(_counts(text, lang), schema).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((len(names), CELLS), 0.5)
    place = {k: i for i, k in enumerate(names)}
    np.add.at(counts, (table["lang"].map(place).to_numpy(int), table["cell"].to_numpy(int)), table["n"].to_numpy(float))
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def proportions(logs: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of the languages in each text, 0 for those outside the set that is kept.

    logs: for each language a row of its log-likelihoods of the words. first: each text's first word, and the end; texts have words.
    Starting from all languages, the one with the least proportion goes until one is left. Of these sets the one with the least -2 log-likelihood + (languages - 1) log(words) counts.
    """
    n = np.diff(first)
    doc, at = np.repeat(np.arange(len(n)), n), first[:-1]
    top = logs.max(0)
    p = np.exp(logs - top)
    base = np.add.reduceat(top, at, dtype=float)
    langs = len(logs)
    pi = np.full((langs, len(n)), 1 / langs, np.float32)
    best, kept = np.full(len(n), np.inf), np.zeros((langs, len(n)))
    for k in range(langs, 0, -1):
        for step in range((rounds if k == langs else rounds // 2) + 1):
            parts = p * pi[:, doc]
            total = np.maximum(parts.sum(0), np.float32(1e-30))
            if step == rounds or k == 1 or (k < langs and step == rounds // 2):
                break
            parts /= total
            pi = (np.add.reduceat(parts, at, axis=1) / n).astype(np.float32)
        cost = -2 * (base + np.add.reduceat(np.log(total), at, dtype=float)) + (k - 1) * np.log(n)
        better = cost < best
        best[better], kept[:, better] = cost[better], pi[:, better]
        least = np.where(pi > 0, pi, np.inf).argmin(0)
        pi[least, np.arange(len(n))] = 0
        pi /= np.maximum(pi.sum(0), np.float32(1e-30))
    return kept.T


def _predict(text: str, names: list[str], shared):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in parts(batches):
            tags, scores, sets = [], [], []
            column = batch.column(text)
            for s in slices(column):
                gram, starts, first = cells(s)
                some = np.array([bool(names) and x is not None and bool(LETTER.search(x)) for x in column[s.lo : s.hi].to_pylist()])
                pi = np.zeros((s.hi - s.lo, max(1, len(names))))
                if some.any():
                    n = np.diff(first)
                    wanted = np.repeat(some, n)
                    logs = np.stack([np.add.reduceat(row[gram], starts)[wanted] for row in model])
                    pi[some] = proportions(logs, np.concatenate([[0], np.cumsum(n[some])]))
                pick = pi.argmax(1)
                tags += [names[j] if ok else UNDETERMINED for j, ok in zip(pick, some, strict=True)]
                scores.append(np.clip(pi[np.arange(len(pick)), pick], 0, 1))
                sets += [",".join(names[j] for j in np.argsort(-row, kind="stable") if row[j] > 0) if ok else "" for row, ok in zip(pi, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(sets, pa.string())], names=[*batch.schema.names, "lang_pred", "score", "lang_set"])
        give_back()

    return run


def identify(df: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """df with lang_pred, score (its proportion, 0 to 1) and lang_set (languages kept, most first), learned from `labelled`.

    Only the text counts, and all of it, however long. `und` with score 0 stands for a text that is null or has no letter, and for any text where nothing was learned. Columns of df with the names added are replaced. Repeated rows are predicted alike; empty tables give empty ones.
    """
    names, model = fit(labelled, key, text, lang, sample)
    df = only(df, [text], ["lang_pred", "score", "lang_set"])
    # The model has CELLS numbers for each language: a quarter of a megabyte.
    return df.mapInArrow(_predict(text, names, df.sparkSession.sparkContext.broadcast(model)), T.StructType([*df.schema.fields, field("lang_pred", "string"), field("score", "double"), field("lang_set", "string")]))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, mod `by`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    return identify(docs.select("doc_id", "held_out", "text"), docs.filter(~F.col("held_out"))).select("doc_id", "held_out", "lang_pred", "score", "lang_set")
