"""Quality rules: counts inside each text, and cross-document line frequency. Normalised lines are hashed, distinct documents are counted for each host and line, lines above the limit are removed, and documents that this depletes are rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import documents, field, join_small, materialize, only
from kmerloom.llm.textkit import Slice, mix, slices, words

#: A line goes if it stands in more than the fraction LINE_SHARE of a host's documents, and in more than FEW_DOCS: a rule for hosts of any size.
LINE_SHARE, FEW_DOCS = 0.02, 3
#: A document is depleted if less than this fraction of its words is left, or fewer words than the base rules ask for.
LEFT = 0.3
#: Base rules: fewest words, most words in repeated windows in a hundred, words in a window.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
ODD = np.uint64(0x9E3779B97F4A7C15)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between one offset and the next."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words inside windows of `window` words that the text has twice or more."""
    n, count = len(hashes), np.diff(first)
    out = np.zeros(len(count), np.int64)
    if n < window:
        return out
    key = np.zeros(n - window + 1, np.uint64)
    for j, step in enumerate(ODD * np.arange(window, dtype=np.uint64)):
        key += mix(hashes[j : n - window + 1 + j] + step)
    doc = np.repeat(np.arange(len(count)), count)
    key = mix(key + ODD * doc[: len(key)].astype(np.uint64))
    at = np.flatnonzero(doc[: len(key)] == doc[window - 1 :])  # windows inside one text
    if not len(at):
        return out
    order = np.argsort(key[at], kind="stable")
    same = key[at][order]
    again = np.zeros(len(at), bool)
    again[1:] = same[1:] == same[:-1]
    again[:-1] |= again[1:]
    hit = at[order[again]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return per_text(np.cumsum(cover[:-1]) > 0, first)


def lines(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lines with a word, normalised (A-Z lower-cased, white space as one blank): hash of each, the words that it has in its text (all of its occurrences), and each text's first line."""
    w = words(s)
    if not len(w.begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), w.first
    breaks = np.union1d(np.flatnonzero(s.data == 10) + 1, s.offsets)
    line = np.searchsorted(breaks, w.begins, "right")
    start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    size = np.diff(np.append(start, len(line)))
    place = np.arange(len(line)) - np.repeat(start, size)
    hashes = mix(np.add.reduceat(mix(w.hashes() + ODD * place.astype(np.uint64)), start))
    text = np.repeat(np.arange(s.hi - s.lo), np.diff(np.searchsorted(w.begins[start], s.offsets)))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])))
    return hashes[new], np.add.reduceat(size[order], new), np.searchsorted(text[new], np.arange(s.hi - s.lo + 1))


def _measure(text: str, names: list[str]):
    kinds = [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(c) for c in batch.schema.names if c != text]
            for s in slices(batch.column(text)):
                raw = words(s, lower=False)
                ink = np.zeros(len(s.data), bool)
                ink[raw.letters] = True
                chars = per_text(ink & ((s.data & 0xC0) != 0x80), s.offsets)
                symbols = per_text(SYMBOL[s.data], s.offsets)
                again = repeated_words(raw.hashes(), raw.first)
                hashes, size, first = lines(s)
                dup = np.zeros(s.hi - s.lo, np.int64)
                data = s.data.tobytes()
                for i in np.flatnonzero(np.diff(raw.first) > 1):
                    own = [x for x in data[s.offsets[i] : s.offsets[i + 1]].split(b"\n") if x.strip()]
                    dup[i] = len(own) - len(set(own))
                counts = [np.diff(raw.first), chars, symbols, dup, again]
                columns = [c.slice(s.lo, s.hi - s.lo) for c in rest] + [pa.array(x, k) for x, k in zip(counts, kinds, strict=True)]
                at = pa.array(first, pa.int32())
                columns += [pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(size.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", line_share: float = LINE_SHARE, few_docs: int = FEW_DOCS, left: float = LEFT) -> DataFrame:
    """One row for each row of df: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept.

    n_removed_words: words in lines that stand in more than line_share of the documents of the same host and in more than few_docs of them; each row is a document. kept: not base_failed, and at least the fraction `left` of the words, and MIN_WORDS of them, are left.
    A null text has no words and fails. Null is a host of its own. Texts of any length are read whole. Repeated rows are judged alike, each counts as a document. Other columns, whatever their names, are not read. Empty tables give empty ones.
    """
    df = only(df, [key, text, host]).select(F.col(key).alias("__id"), F.when(F.col(host).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(host))).alias("__host"), F.col(text).alias("__text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([df.schema["__id"], df.schema["__host"], *[field(c, "long") for c in counts], field("__lines", "array<long>"), field("__sizes", "array<int>")])
    rows = materialize(df.mapInArrow(_measure("__text", schema.names), schema).withColumn("__row", F.monotonically_increasing_id()), "quality-rows")
    each = rows.select("__row", "__host", F.explode(F.arrays_zip("__lines", "__sizes")).alias("x")).select("__row", "__host", F.col("x.__lines").alias("line"), F.col("x.__sizes").alias("size"))
    hosts = rows.groupBy("__host").agg(F.count(F.lit(1)).alias("docs"))
    # A text has each of its lines once, so rows are documents.
    often = each.groupBy("__host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few_docs)
    often = materialize(join_small(often, hosts, ["__host"], salt=["line"]).filter(F.col("n") > line_share * F.col("docs")).select("__host", "line"), "quality-lines")
    removed = join_small(each, often, ["__host", "line"], salt=["__row"]).groupBy("__row").agg(F.sum("size").cast("long").alias("n_removed_words"))
    out = rows.drop("__lines", "__sizes").join(removed, "__row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed: Column = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rest = F.col("n_words") - F.col("n_removed_words")
    return out.select(F.col("__id").alias(key), *counts, failed.alias("base_failed"), "n_removed_words", (~failed & (rest >= left * F.col("n_words")) & (rest >= MIN_WORDS)).alias("kept"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


OP6_SQL = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
split AS (SELECT doc_id, source, UNNEST(string_split(text, chr(10))) AS line FROM docs),
worded AS (
  SELECT doc_id, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY 1),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS x FROM docs, UNNEST(range(1, greatest(len(w) - {WINDOW} + 2, 1))) t(i)),
twice AS (SELECT doc_id, i FROM windows SEMI JOIN (SELECT doc_id, x FROM windows GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, x)),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, {WINDOW}) r(j) GROUP BY 1),
lines AS (SELECT doc_id, source, array_to_string(w, ' ') AS x, sum(len(w)) AS n FROM worded GROUP BY 1, 2, 3),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1),
often AS (SELECT l.source, x FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source GROUP BY 1, 2 HAVING count(*) > {FEW_DOCS} AND count(*) > {LINE_SHARE} * any_value(docs)),
removed AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM lines l JOIN often o ON l.x = o.x AND l.source IS NOT DISTINCT FROM o.source GROUP BY 1),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS n_removed_words
  FROM docs LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN removed USING (doc_id)),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {LEFT}::DOUBLE * n_words AND n_words - n_removed_words >= {MIN_WORDS} AS kept FROM base"""
