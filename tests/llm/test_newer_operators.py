"""Whitening, toxicity and the prefix trie against plain versions, and on tables with all that can go wrong in them."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from kmerloom.llm import prefix_trie, toxicity, whitening


# ------------------------------------------------------------------ whitening
def plain_whitening(vectors, most=16):
    """n, sums, x of each vector, eigenvalues and eigenvectors, by the covariance as it is defined."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), object)
    sums = fit.sum(0)
    y = np.array([[float(Fraction(int(len(fit) * c - s), len(fit))) for c, s in zip(r, sums, strict=True)] for r in fit])
    values, vectors_ = np.linalg.eigh(y.T @ y / len(fit))
    return len(fit), [int(s) for s in sums], x, values[::-1][:most], vectors_[:, ::-1][:, :most], np.trace(y.T @ y / len(fit))


@pytest.mark.parametrize("width, most", [(5, 16), (24, 7), (1, 16)])
def test_whitening(spark, width, most):
    rng = random.Random(width)
    spread = [3.0 / (i + 1) for i in range(width)]
    rows = [(i, [rng.gauss(5, s) for s in spread]) for i in range(300)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (-1, None), (-2, []), (-3, [float("nan")] * width), (-4, [float("inf")] * width), (-5, [*[1.0] * (width - 1), None]), (-6, [1.0] * (width + 3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS N", "'y' AS whitened", "1 AS x").repartition(5)
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    n, sums, x, values, vectors, trace = plain_whitening([v for _, v in good], most)
    out = whitening.whiten(df, components=most).collect()
    k = min(most, width)
    assert len(out) == k * len(good) and {r.n for r in out} == {n}
    by = defaultdict(list)
    for r in out:
        by[r.vec_id, r.deviation].append(r)
    for (i, _), own in zip(good, x, strict=True):
        deviation = sum((n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
        got = sorted((r for r in by[i, deviation]), key=lambda r: r.component)[:: 1]
        want = (np.array([float(Fraction(n * a - s, n)) for a, s in zip(own, sums, strict=True)]) @ vectors) / np.sqrt(values)
        assert {r.component for r in got} == set(range(1, k + 1))
        assert all(abs(abs(r.whitened) - abs(want[r.component - 1])) < 1e-6 for r in got)
        assert all(abs(r.explained * trace / values[r.component - 1] - 1) < 1e-8 and r.identity_error < 1e-9 for r in got)


def test_whitening_without_rank(spark):
    schema = "vec_id long, embedding array<double>"
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(40)], schema)).collect()
    assert {r.component for r in line} == {1} and len(line) == 40 and line[0].identity_error < 1e-9 and abs(line[0].explained - 1) < 1e-9
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    # Beside 1e36 an eigenvalue of 1e4 is within rounding.
    assert len(huge) == 3 and all(r.deviation is None or r.deviation >= 0 for r in huge) and huge[0].identity_error < 1e-6


def test_factor_and_rotations():
    rng = np.random.default_rng(3)
    for size, rank in ((1, 1), (2, 2), (9, 4), (33, 33)):
        a = rng.normal(size=(size, rank)) * np.logspace(0, -6, rank)
        v = a @ a.T
        g = whitening.cholesky(v)
        assert g.shape == (size, rank) and np.allclose(g @ g.T, v, atol=1e-14 * np.trace(v) * size)
        values, vectors = whitening.jacobi(g)
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12) and np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-15 * values[0])
        assert np.allclose((vectors * values) @ vectors.T, v, atol=1e-13 * values[0])


def test_sums_of_many_tasks(spark):
    rows = [(np.array([float(i), 1.0]).tobytes(),) for i in range(200)]
    total = whitening.add_up(spark.createDataFrame([(bytearray(r[0]),) for r in rows], "part binary").repartition(150), 2)
    assert total.tolist() == [19900.0, 200.0]


# ------------------------------------------------------------------ conversations
def plain_trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by[conv].append((turn is not None, turn or 0, int(digest[:15], 16), int(digest[15:30], 16), role, text))
    by = {c: [t[-2:] for t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = by.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def under(node):
        leaves, saved = int(not children[node]), (len(members[node]) - 1) * len((node[-1][1] if node else "").encode().split())
        for x in children[node]:
            a, b = under(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(rebuilt[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), *under(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, convs, most=7, texts=3):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randrange(most)):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "a", "b c", "d  e\tf", " "][: texts + 1])))
    rng.shuffle(rows)
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rows", [
    conversations(1, range(-25, 70)), conversations(2, range(0, 400, 20), 5, 1), [(c, t, "user", "same words here") for c in range(60) for t in range(4)],
    [(5, None, "user", "x"), (5, None, "user", "x"), (5, 1, None, None), (None, 1, "user", "lost"), (9, 3, "u", "y"), (9, -3, "u", "z"), (40, 0, "user", "only"), (41, 0, "user", "own"), (43, 7, "user", "far")],
    [(100, i, "user", "on and on") for i in range(900)] + [(101, i, "user", "on and on") for i in range(900)] + [(102, 5, "user", "w" * 70_000)],
], ids=["mixed", "bases", "copies", "odd", "long"])
def test_prefix_trie(spark, rows):
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "'x' AS DEPTH", "1 AS part", "2 AS k1", "'y' AS words").repartition(6)
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=str) == (plain_trie(rows) if len(rows) < 1000 else sorted((tuple(r) for r in prefix_trie.prefix_trie(df.coalesce(1)).collect()), key=str))


def test_prefix_trie_whatever_the_sketch_says(spark, monkeypatch):
    """With cells for a few prefixes only almost all are grouped exactly: the result is the same."""
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", 4)
    rows = conversations(4, range(120))
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS)).collect()), key=str) == plain_trie(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_trie_like_its_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    assert sorted((tuple(r) for r in prefix_trie.op13_prefix_trie(spark, data).collect()), key=str) == sorted(con.sql(prefix_trie.OP13_SQL).fetchall(), key=str)


def test_count_min_never_counts_less(spark):
    rows = [(i % 97, i % 89) for i in range(2000)]
    table = prefix_trie.count_min(spark.createDataFrame(rows, "k1 long, k2 long").repartition(7), 12)
    k1, k2 = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    least = np.min([row[at] for row, at in zip(table, prefix_trie._cells(k1, k2, 12), strict=True)], axis=0)
    assert table.max() == 2 and all(n >= min(2, rows.count(r)) for n, r in zip(least.tolist(), rows, strict=True))


# ------------------------------------------------------------------ toxicity
def plain_kinds(text, insults, threats):
    """Kinds of clauses with the weights in them, word by word."""
    out = defaultdict(float)
    fixed = {n: set(x.split()) for n, x in (("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS))}
    for line in text.split("\n"):
        negated, reported, quoted, targeted, found = 0, False, False, False, []

        def close():
            for what, n, r, weight in found:  # noqa: B023
                if what == "insult" or targeted:  # noqa: B023
                    out[what, n, r, targeted] += weight  # noqa: B023
            found.clear()  # noqa: B023

        for token in line.split():
            word = token.strip("\"“”„«».,:;!?…()'#*").lower()
            for c in token[: token.lower().find(word)]:
                quoted, reported = (not quoted, False) if c in toxicity.QUOTES else (quoted, reported)
            if word in insults or word in threats:
                found.append(("insult" if word in insults else "threat", negated > 0, reported or quoted, insults.get(word, toxicity.THREAT_WEIGHT)))
            negated = toxicity.REACH if word in fixed["negation"] else max(0, negated - 1)
            reported |= word in fixed["report"] and not quoted
            targeted |= word in fixed["target"]
            for c in token[token.lower().find(word) + len(word) :]:
                if c in toxicity.QUOTES:
                    quoted, reported = not quoted, False
                elif c in ":.!?;…":
                    close()
                    negated, targeted, reported = 0, False, reported and c == ":"
        close()
    return {k: v for k, v in out.items() if k in toxicity.PLACE}


def test_grammar(spark):
    rng = random.Random(5)
    insults = {"fool": 4.0, "rat": 2.5}
    lexicon = toxicity.Lexicon({f"{w}$": (9.0, v) for w, v in insults.items()})
    some = ["fool", "rat", "kill", "you", "not", "said", "never", "the", "house", "tu", "wrote", "Fool!", '"rat"', "kill.", "you:", "said:", "rat,", "red;", '"you', 'fool"', "blue"]
    for _ in range(3000):
        text = "".join(rng.choice(some) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.randrange(1, 25)))
        f, _ = toxicity.features(text, lexicon)
        want = plain_kinds(text, insults, {"kill"})
        assert {k: v for k, v in zip(toxicity.PLACE, f, strict=False) if v} == pytest.approx(want), text
        assert f[-1] == math.log1p(len(text.split()))


def test_kinds_differ():
    lexicon = toxicity.Lexicon({"fool$": (9.0, 6.0)})
    score = lambda t: float(toxicity.features(t, lexicon)[0] @ toxicity.PRIOR)
    assert score("you are a fool") > score("a fool came by") > score("") and score("you are not a fool") < 0 and score('he said: "you fool"') < 0 < score("you fool")
    assert score("they will kill you") > score("to kill time") == score("to pass time")


def test_long_lines_are_read_whole():
    lexicon = toxicity.Lexicon({"fool$": (9.0, 6.0)})
    f, n = toxicity.features("word " * 40_000 + "you are a fool. " + "word " * 40_000 + "fool" + "x" * 200_000 + " fool", lexicon)
    assert n == 2 and f[toxicity.PLACE["insult", False, False, True]] == 6 and f[toxicity.PLACE["insult", False, False, False]] == 6 and f[-1] == math.log1p(80_006)


def labelled(n, seed=11):
    """Texts of made-up words; a text with insults is toxic. One language has whole insults, the other insults that begin alike."""
    rng = random.Random(seed)
    make = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(2, 5)))
    one, two = ["ka", "lo", "mi", "ten", "ra"], ["gü", "ber", "stu", "ol", "en"]
    rows, marks = [], []
    for i in range(n):
        syllables = one if i % 2 else two
        text = [make(syllables) for _ in range(rng.randrange(30, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                text[rng.randrange(len(text))] = rng.choice(["zork", "plib", "dwamp"]) if i % 2 else "quäx" + make(syllables)
        rows.append((i, " ".join(text) + "."))
        marks.append((i, int(toxic)))
    return rows, marks


def test_toxicity(spark, clashing, docs, empty):
    rows, marks = labelled(1200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = spark.createDataFrame([m for m in marks if m[0] % 5] + [(3, None), (None, 1)], "doc_id long, toxic int")
    insults, weights = toxicity.fit(df, learn)
    out = {r.doc_id: r for r in toxicity.score_toxicity(df, insults, weights).collect()}
    held = [(out[i].predicted, t) for i, t in marks if i % 5 == 0]
    assert sum(p == t for p, t in held) >= 0.97 * len(held) and not any(p and not t for p, t in held)
    assert toxicity.fit(df, learn)[0] == insults and np.allclose(toxicity.fit(df, learn)[1], weights)
    for table in (docs, clashing):
        again = toxicity.score_toxicity(table, insults, weights)
        assert again.columns.count("score") == 1 and again.count() == table.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in again.select("score", "predicted").collect())
    assert toxicity.score_toxicity(empty, insults, weights).count() == 0


def test_toxicity_without_labels(spark, docs):
    for marks in ([], [(1, 0)], [(1, None)], [(6, 1)]):
        insults, weights = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert insults == {} and all(r.predicted == 0 for r in toxicity.score_toxicity(docs, insults, weights).collect())
