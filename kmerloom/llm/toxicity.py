"""Toxicity by a weighted pattern grammar. Small transducers read a clause word by word: insults and threats, targets, negation, reported speech. Their composition says what kind of clause an insult or threat stands in, and clauses of each kind are scored, not words alone.

The insults' arcs are learned from labelled texts: whole words, and beginnings of words, that are in more toxic texts than chance explains. What a clause of each kind counts is learned from the same texts, around the values of KINDS.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import discard, documents, field, join_small, materialize, only, random_key
from kmerloom.llm.language_id import remainder
from kmerloom.llm.textkit import give_back, mix, parts, slices, words

#: Of the toxic and of the clean labelled texts about so many are learned from: each text is in or out by a random key of its id.
SAMPLE = 8000
#: Beginnings of words that patterns may be, in letters; texts that a pattern must be in; the share of the lexicon's patterns that may be in it by accident; the least log-odds of an insult.
STEMS, LEAST_TEXTS, FALSE_PATTERNS, LEAST_WEIGHT = range(3, 9), 3, 0.01, 1.5
#: Likelihood ratios from here on are looked at: a chance of 0.001.
LEAST_RATIO = 9.55
#: Words that a negation reaches.
REACH = 3
#: Log-odds of a threat; threats aren't learned.
THREAT_WEIGHT = 3.0
#: Characters of a line that are split at a time, and tokens that a worker remembers.
SEGMENT, REMEMBERED = 1 << 16, 1 << 18

#: Words of the transducers, in English, German, French and Spanish.
TARGETS = "you your yours yourself ya u he she him her they them du dich dir dein deine ihr euch euer sie er tu te toi ton ta vous votre vos il elle ils elles tú tu ti usted ustedes vosotros os él ella ellos ellas"
NEGATIONS = "not no never none nobody isn't aren't wasn't don't doesn't didn't won't can't cannot nicht kein keine keinen nie niemals niemand pas jamais aucun aucune ni nunca jamás nadie ningún ninguna"
REPORTS = "said says say wrote writes called calls claimed claims quoted quote alleged reportedly according sagte sagt schrieb schreibt nannte nennt behauptet laut dit disait écrit écrivait appelle appelait selon dijo dice escribió escribe llamó llama según"
THREATS = "kill hurt destroy shoot stab murder töten umbringen töte erschießen schlagen tuer tuerai frapper détruire matar mataré golpear destruir"
QUOTES = '"“”„«»'
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, COLON, END = range(9)

#: Kinds of clauses, by what their transducers have found, and what the log-odds of an insult or threat count there before anything is learned.
KINDS = [
    ("insult", False, False, False, 1.0), ("insult", False, False, True, 1.2), ("insult", True, False, False, 0.3), ("insult", True, False, True, 0.3), ("insult", False, True, False, 0.4), ("insult", False, True, True, 0.4), ("insult", True, True, False, 0.2), ("insult", True, True, True, 0.2),
    ("threat", False, False, True, 1.0), ("threat", True, False, True, 0.2), ("threat", False, True, True, 0.3), ("threat", True, True, True, 0.1),
]
PLACE = {kind[:4]: i for i, kind in enumerate(KINDS)}
#: Start of the other weights: of no clause at all, and of the logarithm of the number of words.
PRIOR = np.array([k[4] for k in KINDS] + [-3.0, 0.0])
#: How firmly the learned weights are held to PRIOR: the variance of each.
LOOSE = np.array([0.5] * len(KINDS) + [9.0, 0.25])


class Transducer:
    """States from 0 and, for each, where a symbol leads; symbols that aren't named lead where `rest` says."""

    def __init__(self, arcs: list[dict[int, int]], rest: Callable[[int], int]):
        self.table = [[arcs[s].get(x, rest(s)) for x in range(END + 1)] for s in range(len(arcs))]


#: Negation reaches the REACH words after it, or the clause's end.
NEGATED = Transducer([{NEGATION: REACH}] + [{NEGATION: REACH, QUOTE: s, END: 0, COLON: 0} for s in range(1, REACH + 1)], lambda s: max(0, s - 1))
#: Speech is reported from a verb of saying to the clause's end (a colon hands it on to the next clause), and between quotes.
REPORTED = Transducer([{REPORT: 1, QUOTE: 2}, {END: 0, QUOTE: 2}, {QUOTE: 0}], lambda s: s)
#: A target counts for its whole clause.
TARGETED = Transducer([{TARGET: 1}, {END: 0, COLON: 0}], lambda s: s)


def compose(*machines: Transducer) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """The machines as one: its states, each a state of every machine, and where the symbols lead."""
    states = list(product(*[range(len(m.table)) for m in machines]))
    place = {s: i for i, s in enumerate(states)}
    return states, [[place[tuple(m.table[q][x] for m, q in zip(machines, s, strict=True))] for x in range(END + 1)] for s in states]


STATES, ARCS = compose(NEGATED, REPORTED, TARGETED)


def edges(token: str) -> tuple[int, int]:
    """Where a token's letters begin and end."""
    lo, hi = 0, len(token)
    while lo < hi and not token[lo].isalpha():
        lo += 1
    while hi > lo and not token[hi - 1].isalpha():
        hi -= 1
    return lo, hi


def bare(token: str) -> str:
    """A token in lower case without what is no letter at its ends."""
    lo, hi = edges(token)
    return token[lo:hi].lower()


def patterns(word: str) -> Iterator[str]:
    """The whole word, marked by $, and its beginnings."""
    yield word + "$"
    for n in STEMS:
        if n > len(word):
            return
        yield word[:n]


class Lexicon(dict):
    """Tokens as the grammar reads them: token -> 0 (nothing), 1 (symbols), 2 (an insult or a threat among them). insults: pattern -> (how sure, log-odds); of a word's patterns the surest counts, of equally sure ones the longest."""

    def __init__(self, insults: dict[str, tuple[float, float]]):
        super().__init__()
        self.insults, self.symbols = insults, {}
        self.fixed = {w: s for s, text in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in text.split()}
        least = min(STEMS)
        self.starts = {p[:least] for p in insults}
        self.short = {p[:-1] for p in insults if len(p) <= least}

    def insult(self, word: str) -> str | None:
        """The word's pattern."""
        if word[: min(STEMS)] not in self.starts and word not in self.short:
            return None
        return max((p for p in patterns(word) if p in self.insults), key=lambda p: (self.insults[p][0], len(p)), default=None)

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self.symbols.clear()
        lo, hi = edges(token)
        word = token[lo:hi].lower()
        out = [(QUOTE, 0.0) for c in token[:lo] if c in QUOTES]
        pattern = self.insult(word)
        out.append((INSULT, self.insults[pattern][1]) if pattern is not None else (self.fixed.get(word, OTHER), THREAT_WEIGHT))
        for c in token[hi:]:
            if c in QUOTES:
                out.append((QUOTE, 0.0))
            elif c == ":":
                out.append((COLON, 0.0))
            elif c in ".!?;…":
                out.append((END, 0.0))
        kind = 2 if out and any(s in (INSULT, THREAT) for s, _ in out) else int(out != [(OTHER, THREAT_WEIGHT)])
        if kind:
            self.symbols[token] = out
        self[token] = kind
        return kind


def lines(text: str) -> Iterator[tuple[bool, list[str]]]:
    """Tokens of each line, a long line in segments cut at blanks; whether a segment goes on with the line before."""
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        goes_on = False
        while end - at > SEGMENT:
            cut = text.rfind(" ", at, at + SEGMENT)
            cut = cut if cut > at else text.find(" ", at + SEGMENT, end)
            if cut < 0:
                break
            yield goes_on, text[at:cut].split()
            goes_on, at = True, cut + 1
        yield goes_on, text[at:end].split()
        at = end + 1


def features(text: str, lexicon: Lexicon) -> tuple[np.ndarray, int]:
    """Log-odds of the insults and threats in clauses of each kind, 1, the logarithm of the number of words; and the number of clauses that matched. The grammar starts anew with each line."""
    out, clauses, total = np.zeros(len(PRIOR)), 0, 0
    state, open_ = 0, []

    def close() -> int:
        targeted = bool(STATES[state][2])
        n = 0
        for what, negated, reported, weight in open_:
            at = PLACE.get((what, negated, reported, targeted))
            if at is not None:
                out[at] += weight
                n = 1
        open_.clear()
        return n

    for goes_on, tokens in lines(text):
        total += len(tokens)
        if not goes_on:
            clauses += close()
            state = 0
        kinds = list(map(lexicon.__getitem__, tokens))
        if not goes_on and len(kinds) < SEGMENT // 8 and 2 not in kinds:
            continue
        for token, kind in zip(tokens, kinds, strict=True):
            if not kind:
                state = ARCS[state][OTHER]
                continue
            for symbol, weight in lexicon.symbols.get(token) or (lexicon.__missing__(token), lexicon.symbols[token])[1]:
                if symbol in (INSULT, THREAT):
                    negated, reported, _ = STATES[state]
                    open_.append(("insult" if symbol == INSULT else "threat", negated > 0, reported > 0, weight))
                elif symbol in (END, COLON):
                    clauses += close()
                state = ARCS[state][symbol]
    clauses += close()
    out[-2:] = 1.0, math.log1p(total)
    return out, clauses


def _signed(text: str):
    """Adds `sign`: the least hash of three words in a row. Near copies have the same as a rule, other texts don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            signs = []
            for s in slices(batch.column(text)):
                w = words(s)
                h = w.hashes()
                for a, b in zip(w.first[:-1], w.first[1:], strict=True):
                    own = h[a:b]
                    three = mix(own[:-2] + mix(own[1:-1] + mix(own[2:]))) if len(own) > 2 else own
                    signs.append(int(three.min().astype(np.int64)) if len(three) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signs, pa.int64())], names=[*batch.schema.names, "sign"])

    return run


def _pattern_counts(insults: dict | None):
    """In how many clean and toxic texts patterns are: all that the words have, or of each word the one that counts in a lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults or {})
        for batch in parts(batches):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {w for _, tokens in lines(text or "") for w in map(bare, tokens) if w}
                found[toxic].update({p for w in own for p in patterns(w)} if insults is None else {lexicon.insult(w) for w in own} - {None})
            names = list(found[0] | found[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[p] for p in names], pa.int64()) for c in found]], names=["pattern", "clean", "toxic"])

    return run


def learn_insults(sample: DataFrame, clean: int, toxic: int) -> dict[str, tuple[float, float]]:
    """pattern -> (likelihood ratio, log-odds) of the patterns that texts labelled toxic have more often than chance explains, over all patterns tested. sample: text and toxic (0 or 1).

    They are counted twice: first each by itself, then each with those words only for which no surer one counts. So the beginning of an insult's stem is not one unless it is so in other words.
    """
    if not clean or not toxic:
        return {}
    share = toxic / (clean + toxic)
    n = F.col("clean") + F.col("toxic")

    def part(k, of, expected):
        return F.when(k > 0, k * F.log(k / (of * expected))).otherwise(0.0)

    def side(k, of):
        return part(k, of, F.lit(share)) + part(of - k, of, F.lit(1 - share))

    ratio = 2 * (side(F.col("toxic"), n) + side(F.lit(toxic) - F.col("toxic"), F.lit(clean + toxic) - n))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    insults, tested = None, 0
    for _ in range(2):
        counts = sample.select("text", "toxic").mapInArrow(_pattern_counts(insults), "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(n >= LEAST_TEXTS)
        counts = materialize(counts, "toxicity-patterns")
        tested = tested or counts.count()
        # The driver gets those patterns of the bounded sample's words that chance makes once in a thousand.
        found = counts.select("pattern", ratio.alias("ratio"), weight.alias("weight")).filter((F.col("ratio") > LEAST_RATIO) & (F.col("weight") > LEAST_WEIGHT)).orderBy(F.desc("ratio"), "pattern").collect()
        discard(counts)
        # False discovery control: the last place up to which chance explains no more than the share allowed.
        chance = [0.5 * math.erfc(math.sqrt(r["ratio"] / 2)) for r in found]
        passed = max((i for i, p in enumerate(chance, 1) if p <= FALSE_PATTERNS * i / tested), default=0)
        insults = {r["pattern"]: (r["ratio"], r["weight"]) for r in found[:passed]}
    return insults


def _featured(insults: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults)
        for batch in parts(batches):
            rows = [features(x or "", lexicon)[0].tolist() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "f"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of the features with the greatest posterior around PRIOR, by Newton steps that are halved where they don't gain."""
    b, hold = PRIOR.copy(), np.diag(1 / LOOSE)

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (b - PRIOR) @ hold @ (b - PRIOR)

    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -700, 700)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold, x.T @ (weight * (p - y)) + hold @ (b - PRIOR))
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > now:
            size /= 2
        b, before, now = b - size * step, now, loss(b - size * step)
        if before - now < 1e-9 * max(1, now):
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> tuple[dict, np.ndarray]:
    """Insults and the weights of clauses, from about `sample` texts of each label. labels: key and label; rows where either is null are left out, of several labels of a key the greatest counts. Of near copies with the same label one is learned from."""
    marks = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    sizes = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {}, PRIOR
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    taken = marks.filter(random_key(F.col("__key")) / float(1 << 60) <= share)
    texts = join_small(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")), taken, ["__key"], salts=1)
    signed = texts.mapInArrow(_signed("text"), T.StructType([*texts.schema.fields, field("sign", "long")]))
    chosen = materialize(signed.groupBy("toxic", "sign").agg(F.min_by("text", F.struct("__key", F.xxhash64("text"))).alias("text")), "toxicity-sample")
    own = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
    insults = learn_insults(chosen, own.get(0, 0), own.get(1, 0))
    # Some numbers for each text of the sample.
    rows = chosen.select("text", "toxic").mapInArrow(_featured(insults), "toxic int, f array<double>").orderBy("toxic", "f").toPandas()
    discard(chosen)
    if rows["toxic"].nunique() < 2:
        return insults, PRIOR
    y = rows["toxic"].to_numpy(float)
    weight = np.where(y == 1, sizes[1] / own[1], sizes[0] / own[0])
    return insults, logistic(np.stack(rows["f"].to_numpy()), y, weight * len(y) / weight.sum())


def _scored(text: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        insults, weights = shared.value
        lexicon = Lexicon(insults)
        for batch in parts(batches):
            scores, clauses = [], []
            for x in batch.column(text):
                f, n = features(x.as_py() or "", lexicon)
                z = float(f @ weights)
                scores.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                clauses.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(clauses, pa.int64())], names=[*batch.schema.names, "score", "predicted", "n_clauses"])
        give_back()

    return run


def score_toxicity(df: DataFrame, insults: dict, weights: np.ndarray, text: str = "text") -> DataFrame:
    """df with score (0 to 1), predicted (1 from 0.5 on) and n_clauses (clauses with an insult, or a threat at a target).

    Only the text counts, and all of it: it is read in lines and segments, so a text takes little more than its own memory. A null text is empty; the score of an empty text is the model's for no clause. Repeated rows score alike. Columns of df with the names added are replaced; an empty table gives an empty one.
    """
    df = only(df, [text], ["score", "predicted", "n_clauses"])
    # The lexicon holds patterns of a bounded sample.
    shared = df.sparkSession.sparkContext.broadcast((insults, weights))
    return df.mapInArrow(_scored(text, shared), T.StructType([*df.schema.fields, field("score", "double"), field("predicted", "int"), field("n_clauses", "long")]))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(F.col("doc_id"), 5) != 0)
    insults, weights = fit(docs, labels)
    return score_toxicity(docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0), insults, weights).select("doc_id", "held_out", "score", "predicted", "n_clauses")
