"""Secret scans in DataFrame functions alone.

Known forms are found by patterns. Every long token, those of known forms too, goes through a battery of randomness tests for the encoding that its characters suggest: chi-squared uniformity of the alphabet, runs about its middle, and serial correlation. The battery's p-value says how well a token passes for random.

How well words pass is measured: decoys are tokens made of the corpus's own words (and of a short fixed list, so that small tables have some), written in each encoding and in lengths of each class, and they go through the same battery. In each encoding and length class the share of decoys that pass as well as a token gives its false-discovery rate (q-value) over all tokens of that class. A free token is a secret if its q-value is at most `rate`: in short classes words pass more often, so short tokens have to pass better. Known forms stay whatever their q-value, which is given beside them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import documents, materialize, only

#: The known forms, kinds in the order in which spans are listed. Least lengths are part of the patterns of `access` and `hex`; of `assign` the value has 12 characters at least.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")
#: Tokens that are tested, and characters they have at least.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Characters that a token has at least when what sets its parts off is left out.
LEAST = 16
#: The share of tokens like words among those that are taken for secrets.
RATE = 0.05
#: P-values are counted in bins of a twentieth of a decade, the last for all that are smaller.
BINS_A_DECADE, LAST_BIN = 20, 400
#: Length classes: the least length of each. Decoys of the last are up to twice as long.
LENGTHS = (LEAST, 20, 24, 32, 48, 64)
#: Alphabets of the encodings in the order of their digits. `letters` is base64 without 0 to 9, `alpha` letters of one case.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "alpha": "abcdefghijklmnopqrstuvwxyz",
    "digits": "0123456789",
}
#: Kinds of characters: a short token has too few digits to say how even each one's share is, but enough for these.
CELLS = ("[AEIOU]", "[B-DF-HJ-NP-TV-Z]", "[aeiou]", "[b-df-hj-np-tv-z]", "[0-9]", "[+/]")
#: Encodings whose digits count in lower case.
ONE_CASE = ("hex", "base36", "alpha")
#: Decoys that the fixed list gives for each encoding and length class, and words of a decoy at most. Each document gives one decoy.
REFERENCE, DECOY_WORDS = 200, 64
#: Words of the fixed list.
COMMON = (
    "about account action after again air all also always amount and animal answer any area back base become before begin between body book both bring build business call care case change child city class clear close code come common company "
    "computer country course data day different do down each early earth end enough even example eye face family far feel field figure file find first follow food form found friend front game general give good government great group grow hand "
    "head help high history home house idea important index info interest into job just keep kind know language large last later law learn leave letter level life light line list little local long make market member might money month name"
).split()
#: Array functions copy an array to add to it, so running totals go block by block.
STRIDE = 128
SPAN = "array<struct<start:int,end:int,text:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value's expression once in the plan however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running total of an array of ints, each value included, under an operation with a neutral element; in blocks, and over the blocks' totals."""
    last = lambda x: F.element_at(x, -1)
    grow = lambda f: lambda found, x: F.concat(found, F.array(combine(last(found), f(x))))
    start = F.array(F.lit(zero))

    def cut(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRIDE).cast("int"))
        return F.transform(blocks, lambda b: F.slice(F.aggregate(F.slice(v, b * STRIDE + 1, F.lit(STRIDE)), start, grow(lambda x: x)), F.lit(2), F.lit(STRIDE)))

    def joined(blocks: Column) -> Column:
        before = F.slice(F.aggregate(blocks, start, grow(last)), F.lit(1), F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda block, t: F.transform(block, lambda x: combine(t, x))))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(cut(v), joined)).otherwise(F.array().cast("array<int>")))


def placed(text: Column, matches: Column, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's matches, in characters: what lies between them is got by splitting."""
    steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda gap, m: F.length(gap) + F.length(m))
    spans = F.zip_with(matches, running(steps, lambda a, b: a + b, 0), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPAN))


def clear_of(tokens: Column, known: Column) -> Column:
    """The tokens that touch no known span. In the order of starts a token is clear if no span before it ends, and none after it starts, inside it."""
    far = 2**31 - 1
    events = F.array_sort(F.concat(F.transform(known, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("token"))), F.transform(tokens, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), (i + 1).alias("token")))))

    def chosen(e: Column) -> Column:
        ends = running(F.transform(e, lambda x: F.when(x["token"] == 0, x["end"]).otherwise(0)), F.greatest, 0)
        starts = F.reverse(running(F.reverse(F.transform(e, lambda x: F.when(x["token"] == 0, x["start"]).otherwise(far))), F.least, far))
        free = F.filter(F.arrays_zip(e.alias("e"), ends.alias("before"), starts.alias("after")), lambda x: (x["e"]["token"] > 0) & (x["before"] <= x["e"]["start"]) & (x["after"] >= x["e"]["end"]))
        return F.transform(free, lambda x: F.element_at(tokens, x["e"]["token"]))

    return F.when((F.size(known) == 0) | (F.size(tokens) == 0), tokens).otherwise(bound(events, chosen))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable for z >= 0: formula 26.2.17 of Abramowitz and Stegun, good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * series


def digits_of(token: Column) -> Column:
    """The token's digits. With letters of both cases '-' and '_' are base64's last digits; with letters of one case '-', '_', '+' and '/' set parts off (UUIDs, prefixed keys) and are left out. '=' and '.' are left out."""
    mixed = token.rlike("[a-z]") & token.rlike("[A-Z]")
    return F.when(mixed, F.regexp_replace(F.translate(token, "-_", "+/"), "[^A-Za-z0-9+/]", "")).otherwise(F.regexp_replace(token, "[^A-Za-z0-9]", ""))


def encoding(digits: Column) -> Column:
    """What the characters suggest; null for fewer than LEAST of them."""
    is_ = lambda p: digits.rlike(f"^({p})$")
    mixed = F.when(digits.rlike("[0-9]"), "base64").otherwise("letters")
    with_letters = F.when(is_("[0-9a-f]+|[0-9A-F]+"), "hex").when(is_("[A-Z2-7]+"), "base32").when(is_("[a-z0-9]+|[A-Z0-9]+"), "base36").otherwise(mixed)
    return F.when(F.length(digits) >= LEAST, F.when(is_("[0-9]+"), "digits").when(is_("[a-z]+|[A-Z]+"), "alpha").otherwise(with_letters))


def battery(symbols: Column, size: Column, cells: Column, shares: Column) -> Column:
    """P-value that a run of symbols 0 to size-1 is uniformly random: of four tests the least, times four.

    Chi-squared of the symbols and of the kinds of characters (`cells`, counts, against the alphabet's `shares` of them), runs about the alphabet's middle, and serial correlation.
    """
    m = size.cast("double")
    pairs = F.zip_with(F.slice(symbols, F.lit(1), F.size(symbols) - 1), F.slice(symbols, F.lit(2), F.size(symbols) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high, mid = (lambda s: s.cast("double") >= m / 2), (m - 1) / 2
    # Squares of counts: the n-th of equal symbols adds 2n - 1.
    first = F.struct(F.lit(-1).alias("symbol"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def count(t: Column, s: Column) -> Column:
        n = F.when(s == t["symbol"], t["n"] + 1).otherwise(1)
        return F.struct(s.alias("symbol"), n.alias("n"), (t["sum"] + 2 * n - 1).alias("sum"))

    sums = F.struct(
        F.size(symbols).cast("double").alias("n"), F.aggregate(F.sort_array(symbols), first, count, lambda t: t["sum"]).alias("squares"),
        F.aggregate(pairs, F.lit(0.0), lambda t, p: t + F.when(high(p["a"]) != high(p["b"]), 1.0).otherwise(0.0)).alias("turns"),
        F.aggregate(pairs, F.lit(0.0), lambda t, p: t + (p["a"].cast("double") - mid) * (p["b"].cast("double") - mid)).alias("product"),
    )

    def tests(x: Column) -> Column:
        n = x["n"]
        # Mean m-1 and variance 2(m-1)(n-1)/n hold for short tokens as well.
        uneven = (m / n * x["squares"] - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        runs = (x["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = x["product"] / ((m * m - 1) / 12 * F.sqrt(n - 1))
        square = F.aggregate(F.zip_with(cells, shares, lambda o, e: F.when(e > 0, F.pow(o - n * e, F.lit(2.0)) / (n * e)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is about normal.
        free = F.greatest(F.lit(1), F.size(F.filter(shares, lambda e: e > 0)) - 1).cast("double")
        kinds = (F.pow(square / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        return F.array(F.greatest(uneven, F.lit(0.0)), F.greatest(kinds, F.lit(0.0)), F.abs(runs), F.abs(serial))

    tails = F.transform(bound(sums, tests), lambda z, i: F.when(i < 2, 1).otherwise(2) * upper_tail(z))
    return F.least(F.lit(1.0), 4 * F.array_min(tails))


def tested(text: Column) -> Column:
    """(group, p, bin) of a token, null without an encoding. group: the encoding and length class. Decoys of letters that stand for several encodings are of the one that their characters suggest."""
    def by_kind(kind: Column, values: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(kind == k, v) for k, v in values.items()])

    alphabets = {k: F.lit(v) for k, v in ALPHABETS.items()}
    shares = {k: F.array(*[F.lit(len(re.findall(c, v)) / len(v)) for c in CELLS]) for k, v in ALPHABETS.items()}

    def named(x: Column) -> Column:
        digits = F.when(x["kind"].isin(*ONE_CASE), F.lower(x["digits"])).otherwise(x["digits"])
        cells = lambda d: F.array(*[F.regexp_count(d, F.lit(c)).cast("double") for c in CELLS])
        # What each symbol asks for is bound, or it would be worked out for each symbol.
        symbols = lambda v: F.transform(F.split(v["digits"], ""), lambda c: F.instr(v["alphabet"], c) - 1)
        view = F.struct(digits.alias("digits"), by_kind(x["kind"], alphabets).alias("alphabet"), by_kind(x["kind"], shares).alias("shares"))
        p = bound(view, lambda v: bound(symbols(v), lambda s: battery(s, F.length(v["alphabet"]), cells(v["digits"]), v["shares"])))
        length = F.length(x["digits"])
        size = F.coalesce(*[F.when(length >= n, str(n)) for n in reversed(LENGTHS)])
        return F.struct(F.concat_ws("/", x["kind"], size).alias("group"), p.alias("p"))

    def binned(x: Column) -> Column:
        return F.struct(x["group"].alias("group"), x["p"].alias("p"), F.least(F.lit(LAST_BIN), F.floor(-BINS_A_DECADE * F.log10(F.greatest(x["p"], F.lit(1e-300)))).cast("int")).alias("bin"))

    return bound(bound(digits_of(text), lambda d: F.struct(d.alias("digits"), encoding(d).alias("kind"))), lambda x: F.when(x["kind"].isNotNull(), bound(named(x), binned)))


def decoy(words: Column, seed: Column) -> Column:
    """A token made of neighbouring words. The seed, a long, picks the place, the encoding and the length, of any class; null if the words are too few."""
    bits = lambda by, of: F.pmod(F.shiftrightunsigned(seed, by), F.lit(of)).cast("int")
    camel = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))
    number = lambda x, i: (i + F.length(x)).cast("string")
    third = lambda x, i, n: F.when(i % 3 == 2, F.concat(x, n)).otherwise(x)
    forms: tuple[Callable[[Column, Column], Column], ...] = (
        lambda x, i: F.concat(F.regexp_replace(x, "[g-z]", ""), number(x, i)), lambda x, i: third(F.upper(x), i, (i % 6 + 2).cast("string")), lambda x, i: third(x, i, number(x, i)),
        lambda x, i: third(camel(x), i, number(x, i)), lambda x, i: camel(x), lambda x, i: x, number,
    )

    def joined(v: Column) -> Column:
        own = F.slice(v["words"], v["place"] % F.size(v["words"]) + 1, F.lit(DECOY_WORDS))
        return F.coalesce(*[F.when(v["form"] == i, F.array_join(F.transform(own, lambda x, n: form(x, n)), "")) for i, form in enumerate(forms)])  # noqa: B023

    length = F.coalesce(*[F.when(bits(30, len(LENGTHS)) == i, bits(40, b - a) + a) for i, (a, b) in enumerate(pairwise((*LENGTHS, 2 * LENGTHS[-1])))])
    view = F.struct(words.alias("words"), bits(3, 1 << 20).alias("place"), bits(23, len(forms)).alias("form"), length.alias("length"))
    whole = lambda v: F.struct(F.when(F.size(v["words"]) > 0, joined(v)).alias("text"), v["length"].alias("length"))
    return bound(bound(view, whole), lambda x: F.when(F.length(x["text"]) >= x["length"], F.substring(x["text"], F.lit(1), x["length"])))


def q_values(tokens: dict[int, int], decoys_: dict[int, int]) -> dict[int, float]:
    """The q-value of each bin of a class's tokens: the least false-discovery rate of a cut at it or beyond. Of n tokens at a cut that a share s of decoys pass, and t tokens pass, n * s / t are expected to be words; the share counts one decoy more."""
    total, words, t, d, found = sum(tokens.values()), sum(decoys_.values()), 0, 0, {}
    for b in sorted({*tokens, *decoys_}):
        t, d = t + tokens.get(b, 0), d + decoys_.get(b, 0)
        if t:
            found[b] = min(1.0, total * (d + 1) / (words + 1) / t)
    least, out = 1.0, {}
    for b in sorted(found, reverse=True):
        least = out[b] = min(least, found[b])
    return {b: q for b, q in out.items() if b in tokens}


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row for each row of df: key and `spans`, an array of (start, place, end, kind, text, q) by start and then place (of the kind among KINDS); start and end (exclusive) count characters. q: the span's q-value, null for a known form with fewer than LEAST characters to test.

    Spans of kind `random` are tokens with a q-value up to `rate` that touch no known form. A null text is empty and has no spans. Texts of any length are scanned whole, with work in proportion to length. Repeated rows are scanned alike, and each counts for the false-discovery rate, as a token and as a source of decoys. Other columns are not read; an empty table gives an empty one.
    """
    df = only(df, [key, text]).select(F.col(key).alias("__id"), F.coalesce(text, F.lit("")).alias("__text"))
    t = F.col("__text")
    every = lambda pattern, group=0: F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    hits = df.select("__id", "__text", every(ASSIGN).alias("m_assign"), every(ASSIGN, 2).alias("values"), every(ACCESS).alias("m_access"), every(HEX).alias("m_hex"), every(TOKEN).alias("m_random"))
    spans = hits.select("__id", "__text", "values", *[placed(t, F.col(f"m_{k}"), p).alias(k) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)])

    def listed(spans: Column, kind: str, value: str = "text") -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text"), s[value].alias("value")))

    assign = F.filter(F.zip_with("assign", "values", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), v.alias("value"))), lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    known = spans.select("__id", "__text", F.concat(listed(assign, "assign", "value"), listed(F.col("access"), "access"), listed(F.col("hex"), "hex")).alias("known"), "random")
    false_one = lambda text: F.array(F.struct(F.lit(0).alias("start"), F.lit(len(KINDS)).alias("place"), F.lit(0).alias("end"), F.lit("decoy").alias("kind"), F.lit("").alias("text"), text.alias("value")))
    own = bound(F.xxhash64("__id", "__text"), lambda seed: decoy(F.split(F.trim(F.regexp_replace(F.lower(t), "[^a-z]+", " ")), " "), seed))
    own = known.select(F.lit(True).alias("__row"), "__id", F.concat("known", listed(clear_of(F.col("random"), F.col("known")), "random"), false_one(own)).alias("tokens"))
    fixed = F.array(*[F.lit(w) for w in COMMON])
    mixed = F.transform(F.sequence(F.lit(1), F.lit(DECOY_WORDS)), lambda i: F.element_at(fixed, (F.pmod(F.xxhash64(F.col("id"), i), F.lit(len(COMMON))) + 1).cast("int")))
    reference = df.sparkSession.range(REFERENCE * len(ALPHABETS) * len(LENGTHS)).select(F.lit(False).alias("__row"), F.lit(None).cast(df.schema["__id"].dataType).alias("__id"), false_one(bound(F.xxhash64("id"), lambda seed: decoy(mixed, seed))).alias("tokens"))
    test = F.transform("tokens", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "place", "end", "kind", "text")], tested(s["value"]).alias("test")))
    rows = materialize(own.unionByName(reference).select("__row", "__id", F.filter(test, lambda s: s["test"].isNotNull() | (s["place"] < KINDS.index("random"))).alias("tokens")), "secret-rows")
    side = F.when(F.col("x.kind").isin("random", "decoy"), F.col("x.kind")).otherwise("known")
    # A group is an encoding and a length class, so there are some dozens, each with LAST_BIN + 1 bins at most.
    counts = rows.select(F.explode("tokens").alias("x")).filter("x.test IS NOT NULL").groupBy(side.alias("side"), "x.test.group", "x.test.bin").count().collect()
    by: dict[tuple[str, str], dict[int, int]] = {}
    for side, group, b, n in counts:
        by.setdefault((side, group), {})[b] = n
    q = {f"{side}/{group}/{b}": v for (side, group), n in by.items() if side != "decoy" for b, v in q_values(n, by.get(("decoy", group), {})).items()}
    q_of = F.from_json(F.lit(json.dumps(q)), T.MapType(T.StringType(), T.DoubleType()))
    name = lambda s: F.concat_ws("/", F.when(s["kind"] == "random", "random").otherwise("known"), s["test"]["group"], s["test"]["bin"].cast("string"))
    marked = F.transform(F.filter("tokens", lambda s: s["kind"] != "decoy"), lambda s: F.struct(*[s[c].alias(c) for c in ("start", "place", "end", "kind", "text")], F.try_element_at(q_of, name(s)).alias("q")))
    return rows.filter("__row").select(F.col("__id").alias(key), F.array_sort(F.filter(marked, lambda s: (s["kind"] != "random") | (s["q"] <= rate))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_q(spans: Column) -> Column:
    """kind:start:end:q of spans, comma-joined; - for a span that is too short to be tested."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), F.coalesce(F.round(s["q"], 4).cast("string"), F.lit("-")))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[number(k) for k in KINDS[:3]], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), number("random"), with_q(F.col("spans")).alias("q_values"))
