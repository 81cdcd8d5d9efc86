"""Queries over the driver's tables and the SQL they are held against.

The tables hold no sequences: a text's letters stand in for bases (functions.sequence.letters_as_bases). Documents are the query axis, benchmark items the target axis, sources are records where few large ones are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions import formatting, grammar
from kmerloom.functions.sequence import HASH_HIGH, HASH_LOW, HASH_STEP, letters_as_bases, text_as_bases
from kmerloom.model import MatchOptions
from kmerloom.operators import belongs as B
from kmerloom.operators import contain, gather, intervals, kmers, match, profile, raster, summary
from kmerloom.plans import density
from kmerloom.plans.index_store import kept_index
from kmerloom.plans.ordering import with_running_total
from kmerloom.plans.tables import scratch, stored
from kmerloom.sources import bgzf, binary, fasta, paf, svg
from kmerloom.sources.tiles import TileCache

K = 15
SCALED = 16
TILE = 4096
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(spark: SparkSession) -> int:
    """Tasks, and files, that a table is dealt out to."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def document_axis(spark: SparkSession, sf_dir: str, bases=letters_as_bases) -> DataFrame:
    return kmers.as_axis(read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id")).alias("name"), bases(F.col("text")).alias("seq")), "doc_id", "name", "seq")


def benchmark_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.as_axis(read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("item"), F.col("item_id")).alias("name"), letters_as_bases(F.col("text")).alias("seq")), "item_id", "name", "seq")


# ---------------------------------------------------------------- SQL that the checks share
LETTERS = "translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
WITH_N = "translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '0', 'g')), 'abcdefghijklmnopqrstuvwxyz0', 'ACGTACGTACGTACGTACGTACGTACN')"


def sql_axis(name: str, table: str, key: str, bases: str = LETTERS) -> str:
    return f"""{name} AS (
  SELECT rec, seq, len, CAST(sum(len) OVER (ORDER BY rec) - len AS BIGINT) AS start
  FROM (SELECT {key} AS rec, seq, CAST(length(seq) AS BIGINT) AS len FROM (SELECT {key}, {bases} AS seq FROM {table})))"""


def sql_kmers(name: str, axis: str, k: int = K) -> str:
    """Windows, by way of pieces of 64 starts: taking a part of a long text costs its length."""
    return f"""{name} AS (
  SELECT rec, start + ofs + i AS pos, km FROM (
    SELECT rec, start, ofs, i, substr(piece, CAST(i + 1 AS INTEGER), {k}) AS km
    FROM (SELECT rec, start, ofs, substr(seq, CAST(ofs + 1 AS INTEGER), {63 + k}) AS piece FROM {axis}, UNNEST(range(0, len, 64)) c(ofs)), UNNEST(range(0, greatest(length(piece) - {k} + 1, 0))) u(i))
  WHERE NOT contains(km, 'N'))"""


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


DOC = sql_axis("doc", "documents", "doc_id")
ITEM = sql_axis("item", "benchmark", "item_id")
DOC_KM = f"{DOC}, {sql_kmers('dk', 'doc')}"
OCC = f"{DOC_KM}, occ AS (SELECT km, count(*) AS occ FROM dk GROUP BY km)"
SPECTRUM = f"{OCC}, spectrum AS (SELECT CAST(least(occ, 1024) AS INTEGER) AS cls, count(*) AS occ_count, sum(CAST(occ AS DOUBLE) * occ) AS occ_sumsq FROM occ GROUP BY 1)"


def digits(km: str, k: int = K) -> str:
    return f"CAST(list_sum(list_transform(range(0, {k}), lambda j: (instr('ACGT', substr({km}, CAST(j + 1 AS INTEGER), 1)) - 1) * CAST(pow(4, {k} - 1 - j) AS BIGINT))) AS BIGINT)"


def sql_match(o: MatchOptions, target: str = "item", query_: str = "doc", t_window=None, q_window=None) -> str:
    """CTEs up to `seg`: the segments of two axes."""
    k, total = o.k, f"(SELECT CAST(sum(len) AS BIGINT) FROM {query_})"
    cap = f"SEMI JOIN (SELECT km FROM t0 GROUP BY km HAVING count(*) <= {o.cap}) USING (km)" if o.cap is not None else ""
    t_in = f"AND pos >= {t_window[0]} AND pos < {t_window[1]}" if t_window else ""
    q_in = f"AND CASE WHEN strand = 0 THEN p >= {q_window[0]} AND p < {q_window[1]} ELSE p >= {total} - {q_window[1]} AND p < {total} - {q_window[0]} END" if q_window else ""
    least = f"WHERE dx >= {o.least_run}"
    return f"""{sql_kmers("tk", target, k)}, {sql_kmers("qk", query_, k)},
t0 AS (SELECT rec AS trec, pos AS t, km FROM tk WHERE pos % {o.stride} = 0 {t_in}),
tt AS (SELECT * FROM t0 {cap}),
q0 AS (SELECT 0 AS strand, rec AS qrec, pos AS p, km FROM qk UNION ALL SELECT 1, rec, {total} - pos - {k}, {rc("km")} FROM qk),
anchor AS (SELECT strand, qrec, trec, p, t, p - t AS diag FROM (SELECT * FROM q0 WHERE p % {o.q_sample} = 0 {q_in}) JOIN tt USING (km)),
gaps AS (SELECT *, p - lag(p) OVER (PARTITION BY strand, qrec, trec, diag ORDER BY p) - 1 AS gap FROM anchor),
runs AS (SELECT *, gap IS NULL OR gap > {o.max_gap + o.hole} AS brk FROM gaps),
numbered AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY strand, qrec, trec, diag ORDER BY p) AS run FROM runs),
seg0 AS (
  SELECT strand, qrec, trec, min(t) AS x, min(p) AS lo, max(p) AS hi, CAST(sum(CASE WHEN brk THEN 0 ELSE greatest(0, gap - {o.hole}) END) AS BIGINT) AS gap_bases
  FROM numbered GROUP BY strand, qrec, trec, diag, run),
seg AS (
  SELECT * FROM (SELECT x, CASE WHEN strand = 0 THEN lo ELSE {total} - hi - {k} END AS y, hi - lo + {k} AS dx, hi - lo + {k} AS dy, strand, qrec, trec, gap_bases,
    (hi - lo + {k} - gap_bases) / CAST(hi - lo + {k} AS DOUBLE) AS identity FROM seg0) {least})"""


SEG_OUT = "SELECT x, y, dx, dy, strand, qrec, trec, gap_bases, round(identity, 9) AS identity FROM seg"
#: The comparison that most queries start from.
OPTIONS = MatchOptions(k=K, max_gap=64)
SEG = f"{ITEM}, {DOC}, {sql_match(OPTIONS)}"


def segments(spark: SparkSession, sf_dir: str, options: MatchOptions = OPTIONS, **windows) -> DataFrame:
    return match.match(benchmark_axis(spark, sf_dir), document_axis(spark, sf_dir), options, **windows)


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("identity", F.round("identity", 9))


# ---------------------------------------------------------------- k-mers
@query(f"WITH {DOC_KM} SELECT rec, count(*) AS windows, CAST(sum(pos) AS BIGINT) AS pos_sum, count(DISTINCT km) AS distinct_kmers FROM dk GROUP BY rec")
def kmer_enumerate(spark, sf_dir):
    """Windows of each record."""
    return kmers.record_windows(kmers.spread(document_axis(spark, sf_dir)), K)


@query(f"WITH {sql_axis('doc', 'documents', 'doc_id', WITH_N)}, {sql_kmers('dk', 'doc', 5)} SELECT rec, count(*) AS windows, CAST(sum(pos) AS BIGINT) AS pos_sum FROM dk GROUP BY rec")
def kmer_breaks(spark, sf_dir):
    """No window crosses an N; here all that is not a letter is one."""
    return kmers.kmers(kmers.spread(document_axis(spark, sf_dir, text_as_bases)), 5).groupBy("rec").agg(F.count(F.lit(1)).alias("windows"), F.sum("pos").cast("long").alias("pos_sum"))


@query(f"WITH {DOC_KM} SELECT rec, count(DISTINCT least(km, {rc('km')})) AS species FROM dk GROUP BY rec")
def kmer_canonical(spark, sf_dir):
    """Distinct canonical k-mers of each record."""
    return kmers.distinct_kmers(kmers.spread(document_axis(spark, sf_dir)), K)


@query(f"WITH {ITEM}, {sql_kmers('ik', 'item')} SELECT rec, pos, km, {digits('km')} AS kv, {digits(rc('km'))} AS rc, least(km, {rc('km')}) AS canon FROM ik")
def kmer_packed(spark, sf_dir):
    """K-mers as text and as numbers, by expressions alone."""
    return kmers.kmers_by_expressions(benchmark_axis(spark, sf_dir), K)


HASH = f"""{DOC_KM}, canon AS (SELECT DISTINCT rec, least(km, {rc("km")}) AS c FROM dk),
packed AS (SELECT c, {digits("c")} AS v FROM (SELECT DISTINCT c FROM canon)),
h1 AS (SELECT c, xor(((v % 67108864) * {HASH_LOW}) & 4294967295, ((v // 67108864) * {HASH_HIGH}) & 4294967295) AS h FROM packed),
h2 AS (SELECT c, xor(h, h >> 15) AS h FROM h1), h3 AS (SELECT c, (h * {HASH_STEP}) & 4294967295 AS h FROM h2), h4 AS (SELECT c, xor(h, h >> 13) AS h FROM h3)"""


@query(f"WITH {HASH} SELECT rec, count(*) AS sampled FROM canon JOIN h4 USING (c) WHERE h < {(1 << 32) // SCALED} GROUP BY rec")
def fracminhash_sample(spark, sf_dir):
    """Canonical k-mers that pass the value sampling."""
    return kmers.distinct_kmers(kmers.spread(document_axis(spark, sf_dir)), K, SCALED).withColumnRenamed("species", "sampled")


# ---------------------------------------------------------------- occurrences, densities
def document_index(spark, sf_dir) -> DataFrame:
    return kmers.counted_kmers(kmers.spread(document_axis(spark, sf_dir)), K)


@query(f"WITH {SPECTRUM} SELECT * FROM spectrum")
def occurrence_spectrum(spark, sf_dir):
    """A1, A2."""
    return profile.spectrum(document_index(spark, sf_dir))


@query(f"WITH {OCC} SELECT CAST(CASE WHEN occ >= 1024 THEN 11 ELSE ceil(log2(occ)) END AS INTEGER) AS bucket, count(*) AS distinct_kmers, CAST(sum(occ) AS BIGINT) AS windows FROM occ GROUP BY 1")
def occurrence_classes(spark, sf_dir):
    """A17."""
    return profile.occurrence_classes(document_index(spark, sf_dir))


@query(f"WITH {SPECTRUM} SELECT CAST(sum(occ_count) AS BIGINT) AS distinct_kmers, sum(occ_count * CAST(cls AS DOUBLE)) AS windows, round(sum(CASE WHEN cls > 4 THEN occ_count * CAST(cls AS DOUBLE) ELSE 0 END) / sum(occ_count * CAST(cls AS DOUBLE)), 9) AS capped_share FROM spectrum")
def composition(spark, sf_dir):
    """K-mers, windows and the share above a cap of 4."""
    return summary.composition(profile.spectrum(document_index(spark, sf_dir)), 4).withColumn("capped_share", F.round("capped_share", 9))


BUDGETS = (1e4, 2e6, 2.5e6, 1e12)


@query(f"""WITH {SPECTRUM}, classes AS (SELECT CAST(o AS INTEGER) AS cls FROM range(1, 1025) r(o)),
cum AS (SELECT cls, sum(coalesce(occ_sumsq, 0)) OVER (ORDER BY cls) AS total FROM classes LEFT JOIN spectrum USING (cls))
SELECT budget, CAST(max(cls) AS DOUBLE) AS cutoff FROM cum, (VALUES {", ".join(f"(CAST({b} AS DOUBLE))" for b in BUDGETS)}) b(budget) WHERE cls <= 200 AND (cls <= 4 OR total <= budget) GROUP BY budget""")
def cutoff_pick(spark, sf_dir):
    """The cutoff that fits an anchor budget, for a self comparison with a cap of 200."""
    _, sumsq = density.histogram(profile.spectrum(document_index(spark, sf_dir)))
    return spark.createDataFrame([(b, float(density.pick_cutoff(sumsq, 1.0, 200, b))) for b in BUDGETS], "budget double, cutoff double")


CAPS = (1, 4, 16, 64, 200, 1024)


@query(f"WITH {SPECTRUM} SELECT cap, sum(occ_sumsq) AS anchors FROM spectrum, (VALUES {', '.join(f'({c})' for c in CAPS)}) c(cap) WHERE cls <= cap GROUP BY cap")
def anchor_estimate(spark, sf_dir):
    """A3: anchors of one strand by occurrence cap."""
    caps = spark.createDataFrame([(c,) for c in CAPS], "cap int")
    return profile.spectrum(document_index(spark, sf_dir)).join(F.broadcast(caps), F.col("cls") <= F.col("cap")).groupBy("cap").agg(F.sum("occ_sumsq").alias("anchors"))


# ---------------------------------------------------------------- matches
@query(f"WITH {SEG} {SEG_OUT} WHERE strand = 0")
def match_forward(spark, sf_dir):
    """Forward segments of benchmark items on documents."""
    return shown(segments(spark, sf_dir).filter("strand = 0"))


@query(f"WITH {SEG} {SEG_OUT} WHERE strand = 1")
def match_reverse(spark, sf_dir):
    """Reverse segments."""
    return shown(segments(spark, sf_dir).filter("strand = 1"))


SMALL = MatchOptions(k=10, max_gap=16, max_occ=2, min_run=12)


@query(f"WITH {ITEM}, {DOC}, {sql_match(SMALL)} {SEG_OUT}")
def match_capped(spark, sf_dir):
    """A low cap and a least run length."""
    return shown(segments(spark, sf_dir, SMALL))


SPARSE = MatchOptions(k=12, max_gap=24, stride=2, q_sample=3)


@query(f"WITH {ITEM}, {DOC}, {sql_match(SPARSE)} {SEG_OUT}")
def match_sampled(spark, sf_dir):
    """Both axes sampled by place."""
    return shown(segments(spark, sf_dir, SPARSE))


SELF = MatchOptions(k=8, max_gap=0, max_occ=200)


@query(f"WITH {ITEM}, {sql_match(SELF, 'item', 'item')} {SEG_OUT}")
def self_match(spark, sf_dir):
    """An axis on itself, with the diagonal and both mirror images."""
    axis = benchmark_axis(spark, sf_dir)
    return shown(match.match(axis, axis, SELF))


@query(f"WITH {SEG} {SEG_OUT}")
def match_kept_index(spark, sf_dir):
    """A comparison whose target's index was left by an earlier one."""
    folder, q = scratch(spark, "indexes"), document_axis(spark, sf_dir)
    kept_index(benchmark_axis(spark, sf_dir), OPTIONS, folder, 4)
    total = kmers.total_length(q)
    return shown(match.merge_runs(match.anchors(kept_index(benchmark_axis(spark, sf_dir), OPTIONS, folder), kmers.spread(q), OPTIONS, total), OPTIONS, total))


T_WINDOW, Q_WINDOW = (500, 6000), (10_000, 900_000)


@query(f"WITH {ITEM}, {DOC}, {sql_match(SMALL, t_window=T_WINDOW, q_window=Q_WINDOW)} {SEG_OUT}")
def match_window(spark, sf_dir):
    """Starts in a window of each axis; the reverse strand's window is not the forward one's."""
    return shown(segments(spark, sf_dir, SMALL, t_window=T_WINDOW, q_window=Q_WINDOW))


INSIDE = f"x >= {T_WINDOW[0]} AND x + dx <= {T_WINDOW[1]} AND y >= {Q_WINDOW[0]} AND y + dy <= {Q_WINDOW[1]}"


@query(f"""WITH {SEG}, old AS (SELECT * FROM seg WHERE NOT ({INSIDE})), fresh AS (
  WITH {ITEM}, {DOC}, {sql_match(SMALL, t_window=T_WINDOW, q_window=Q_WINDOW)} SELECT * FROM seg)
SELECT strand, count(*) AS n, CAST(sum(dx) AS BIGINT) AS bp, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh) GROUP BY strand""")
def refine_merge(spark, sf_dir):
    """Segments inside a window replaced by those of a finer comparison."""
    both = match.refine(segments(spark, sf_dir), segments(spark, sf_dir, SMALL, t_window=T_WINDOW, q_window=Q_WINDOW), (*T_WINDOW, *Q_WINDOW))
    return both.groupBy("strand").agg(F.count(F.lit(1)).alias("n"), F.sum("dx").cast("long").alias("bp"), F.sum("x").cast("long").alias("xs"), F.sum("y").cast("long").alias("ys"))


# ---------------------------------------------------------------- repeat structure
SATURATED = f"""{OCC}, total AS (SELECT CAST(sum(len) AS BIGINT) AS n FROM doc),
tiles AS (SELECT pos // 512 AS t, count(*) AS n, count(*) FILTER (WHERE occ > 1) AS over FROM dk JOIN occ USING (km) GROUP BY 1),
hot AS (SELECT t, t - row_number() OVER (ORDER BY t) AS g FROM tiles WHERE 2 * over >= n),
saturated AS (SELECT CAST(min(t) * 512 AS BIGINT) AS start, CAST(least((max(t) + 1) * 512, (SELECT n FROM total)) AS BIGINT) AS "end" FROM hot GROUP BY g)"""


def saturated(spark, sf_dir) -> tuple[DataFrame, int]:
    axis = document_axis(spark, sf_dir)
    total = kmers.total_length(axis)
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("rec"), letters_as_bases(F.col("text")).alias("seq"))
    placed = kmers.catalog(axis).select("rec", "start", (F.col("end") - F.col("start")).alias("len"))
    return profile.saturated(kmers.near(kmers.squeezed(texts, "rec", placed)), total, 1, k=K), total


@query(f"WITH {SATURATED} SELECT * FROM saturated")
def saturated_intervals(spark, sf_dir):
    """A5: where k-mers above a cap of 1 are half or more."""
    return saturated(spark, sf_dir)[0]


@query(f"""WITH {SATURATED}, parts AS (
  SELECT start, least("end", 100000) AS e FROM saturated UNION ALL SELECT greatest(start, 600000), "end" FROM saturated UNION ALL SELECT 250000, 300000),
ok AS (SELECT * FROM parts WHERE start < e),
marked AS (SELECT *, CASE WHEN max(e) OVER (ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS fresh FROM ok),
groups AS (SELECT *, sum(fresh) OVER (ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM marked)
SELECT min(start) AS start, max(e) AS "end" FROM groups GROUP BY g""")
def interval_splice(spark, sf_dir):
    """The intervals of a window replaced."""
    old, _ = saturated(spark, sf_dir)
    return profile.splice(old, spark.createDataFrame([(250_000, 300_000)], "start long, end long"), 100_000, 600_000)


PROFILE = f"""{OCC}, tiles AS (SELECT pos // {TILE} AS tile, avg(log2(occ)) AS lg, avg(CASE WHEN occ = 1 THEN 1.0 ELSE 0.0 END) AS u FROM dk JOIN occ USING (km) GROUP BY 1),
profile AS (SELECT r.tile, coalesce(pow(2, lg), 0) AS mult, coalesce(u, 0) AS uniq_frac FROM range(0, CAST((SELECT (sum(len) + {TILE - 1}) // {TILE} FROM doc) AS BIGINT)) r(tile) LEFT JOIN tiles USING (tile))"""


def multiplicity(spark, sf_dir) -> DataFrame:
    axis = document_axis(spark, sf_dir)
    return profile.multiplicity(kmers.spread(axis), kmers.total_length(axis), TILE, k=K)


@query(f"WITH {PROFILE} SELECT tile, round(mult, 6) AS mult, round(CAST(uniq_frac AS DOUBLE), 6) AS uniq_frac FROM profile")
def multiplicity_profile(spark, sf_dir):
    """A6."""
    return multiplicity(spark, sf_dir).select("tile", F.round("mult", 6).alias("mult"), F.round("uniq_frac", 6).alias("uniq_frac"))


@query(f"""WITH {PROFILE}, lane AS (SELECT tile * {TILE} // 20000 AS bucket, pow(2, avg(log2(mult))) AS mult, avg(CAST(uniq_frac AS DOUBLE)) AS uniq_frac FROM profile WHERE mult > 0 GROUP BY 1)
SELECT CAST(bucket * 20000 AS BIGINT) AS start, round(mult, 6) AS mult, round(uniq_frac, 6) AS uniq_frac, round(least(1.0, log10(greatest(mult, 1.0)) / 2.5), 6) AS tone FROM lane WHERE least(1.0, log10(greatest(mult, 1.0)) / 2.5) >= 0.001""")
def multiplicity_lane(spark, sf_dir):
    """A22, F8, W10."""
    lane = profile.multiplicity_lane(multiplicity(spark, sf_dir), TILE, 10_000.0, 0.001)
    return lane.select("start", *[F.round(c, 6).alias(c) for c in ("mult", "uniq_frac", "tone")])


TEXELS = 100


@query(f"""WITH {PROFILE}, n AS (SELECT count(*) AS n FROM profile), x AS (SELECT x, x * n // {TEXELS} AS t0, greatest(x * n // {TEXELS} + 1, (x + 1) * n // {TEXELS}) AS t1 FROM range(0, {TEXELS}) r(x), n)
SELECT x AS texel, CAST(coalesce(floor(least(1.0, greatest(0.0, avg(log10(mult)) / 2.5)) * 255 + 0.5), 0) AS INTEGER) AS value FROM x LEFT JOIN profile ON tile >= t0 AND tile < t1 AND mult > 0 GROUP BY x""")
def multiplicity_texture(spark, sf_dir):
    """A23."""
    axis = document_axis(spark, sf_dir)
    total = kmers.total_length(axis)
    found = profile.multiplicity(kmers.spread(axis), total, TILE, k=K)
    return profile.multiplicity_texture(found, (total + TILE - 1) // TILE, TEXELS)


SIDES = ", ".join(f"({n})" for n in density.GRID_SIDES if n <= 512)


@query(f"""WITH {SPECTRUM}, cost AS (SELECT n, sum(occ_count * pow(n * (1 - exp(-cls / CAST(n AS DOUBLE))), 2)) AS c FROM spectrum, (VALUES {SIDES}) s(n) GROUP BY n)
SELECT CAST(coalesce(max(n) FILTER (WHERE c <= {density.GRID_COST}), {density.GRID_LEAST}) AS INTEGER) AS side FROM cost""")
def grid_side_pick(spark, sf_dir):
    """The finest grid that the documents' k-mers allow."""
    return spark.createDataFrame([(contain.side_of(kmers.spread(document_axis(spark, sf_dir)), K),)], "side int")


@query(f"""WITH {SPECTRUM}, t AS (SELECT 2 * sum(CASE WHEN cls <= 200 THEN occ_sumsq ELSE 0 END) AS anchors FROM spectrum), n AS (SELECT sum(len) AS n FROM doc)
SELECT anchors, round(least(anchors / 2, 2 * n) * 28 * 8 / 3 / 1e9, 9) AS table_gb FROM t, n""")
def volume_preflight(spark, sf_dir):
    """Anchors of both strands and GB of diagonals of a self comparison with a cap of 200."""
    axis = document_axis(spark, sf_dir)
    total = kmers.total_length(axis)
    _, sumsq = density.histogram(profile.spectrum(kmers.counted_kmers(kmers.spread(axis), K)))
    found = density.check_volume(density.estimate_anchors(sumsq, 200, density.anchor_scale(total, total, 1, 1)), total, total, confirm=True)
    return spark.createDataFrame([(found["anchors"], round(found["table_gb"], 9))], "anchors double, table_gb double")


# ---------------------------------------------------------------- containment
GRID_N = 64


def sql_grid(x: str, y: str, x_total: str, y_total: str) -> str:
    return f"""cx AS (SELECT CAST(least({GRID_N - 1}, floor(pos * (CAST({GRID_N} AS DOUBLE) / {x_total}))) AS INTEGER) AS tx, km, count(*) AS n FROM {x} GROUP BY 1, 2),
cy AS (SELECT CAST(least({GRID_N - 1}, floor(pos * (CAST({GRID_N} AS DOUBLE) / {y_total}))) AS INTEGER) AS ty, km, count(*) AS n FROM {y} GROUP BY 1, 2),
sx AS (SELECT tx, sum(n) AS total_x FROM cx GROUP BY 1), sy AS (SELECT ty, sum(n) AS total_y FROM cy GROUP BY 1),
both_ AS (SELECT tx, ty, CAST(sum(least(cx.n, cy.n)) AS BIGINT) AS shared FROM cx JOIN cy USING (km) GROUP BY 1, 2)
SELECT tx, ty, shared, round(shared / least(total_x, total_y), 9) AS containment, round(pow(shared / least(total_x, total_y), 1e0 / {K}), 9) AS identity FROM both_ JOIN sx USING (tx) JOIN sy USING (ty)"""


def nine(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(f"WITH {DOC_KM}, {sql_grid('dk', 'dk', '(SELECT sum(len) FROM doc)', '(SELECT sum(len) FROM doc)')}")
def containment_grid(spark, sf_dir):
    """Tile pairs of all documents, laid end to end."""
    axis = document_axis(spark, sf_dir)
    return nine(contain.containment_grid(kmers.spread(axis), None, (0, kmers.total_length(axis)), None, GRID_N, K), "containment", "identity")


@query(f"WITH {ITEM}, {DOC}, {sql_kmers('ik', 'item')}, {sql_kmers('dk', 'doc')}, {sql_grid('ik', 'dk', '(SELECT sum(len) FROM item)', '(SELECT sum(len) FROM doc)')}")
def containment_grid_cross(spark, sf_dir):
    """Tiles of one axis on tiles of another."""
    x, y = benchmark_axis(spark, sf_dir), document_axis(spark, sf_dir)
    return nine(contain.containment_grid(kmers.spread(x), kmers.spread(y), (0, kmers.total_length(x)), (0, kmers.total_length(y)), GRID_N, K), "containment", "identity")


SOURCES = f"""{DOC_KM}, sk AS (SELECT source AS rec, least(km, {rc("km")}) AS c, count(*) AS n FROM dk JOIN documents ON rec = doc_id GROUP BY 1, 2),
tot AS (SELECT rec, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE n = 1) AS unique_total FROM sk GROUP BY 1),
many AS (SELECT c, count(*) AS n_rec FROM sk GROUP BY 1 HAVING count(*) > 1),
pairs AS (
  SELECT a.rec AS i, b.rec AS j, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared, CAST(sum(CASE WHEN n_rec = 2 THEN least(a.n, b.n) ELSE 0 END) AS BIGINT) AS exclusive,
    count(*) FILTER (WHERE a.n = 1) AS "unique", CAST(sum(a.n) AS BIGINT) AS cross_mass
  FROM sk a JOIN sk b ON a.c = b.c AND a.rec IS DISTINCT FROM b.rec JOIN many ON many.c = a.c GROUP BY 1, 2)"""


def source_sums(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Pairs of sources and the masses of each."""
    names = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec"), "source")
    axis = document_axis(spark, sf_dir).join(names, "rec")
    return B.between(kmers.spread(axis, keep=("source",)), K, "source")


@query(f"WITH {SOURCES} SELECT * FROM tot")
def belongs_masses(spark, sf_dir):
    """Windows of each source, and k-mers that it holds once."""
    return source_sums(spark, sf_dir)[1]


@query(f"WITH {SOURCES} SELECT * FROM pairs")
def belongs_matrix(spark, sf_dir):
    """Shared, exclusive and unique k-mers of sources."""
    return source_sums(spark, sf_dir)[0]


@query(f"""WITH {SOURCES} SELECT p.i, p.j, round(p.shared / CAST(ti.total AS DOUBLE), 9) AS containment, round(p.shared / CAST(tj.total AS DOUBLE), 9) AS back, round(pow(p.shared / CAST(least(ti.total, tj.total) AS DOUBLE), 1e0 / {K}), 9) AS identity,
  round(p.exclusive / CAST(ti.total AS DOUBLE), 9) AS exclusive_share, round(p."unique" / CAST(nullif(ti.unique_total, 0) AS DOUBLE), 9) AS unique_share,
  CASE WHEN b.cross_mass / CAST(p.cross_mass AS DOUBLE) >= 1.15 OR b.cross_mass / CAST(p.cross_mass AS DOUBLE) <= 1 / 1.15e0 THEN round(b.cross_mass / CAST(p.cross_mass AS DOUBLE), 9) END AS copy_ratio
FROM pairs p JOIN pairs b ON p.i = b.j AND p.j = b.i JOIN tot ti ON ti.rec = p.i JOIN tot tj ON tj.rec = p.j""")
def belongs_metrics(spark, sf_dir):
    """A8b."""
    return nine(B.with_metrics(*source_sums(spark, sf_dir), K), "containment", "back", "identity", "exclusive_share", "unique_share", "copy_ratio")


CONTAMINATION = f"""WITH {ITEM}, {DOC}, {sql_kmers("ik", "item")}, {sql_kmers("dk", "doc")},
ic AS (SELECT rec AS item, least(km, {rc("km")}) AS c, count(*) AS n FROM ik GROUP BY 1, 2), dc AS (SELECT rec AS doc, least(km, {rc("km")}) AS c, count(*) AS n FROM dk GROUP BY 1, 2),
total AS (SELECT item, sum(n) AS total FROM ic GROUP BY 1)
SELECT item, doc, CAST(sum(least(ic.n, dc.n)) AS BIGINT) AS shared, round(sum(least(ic.n, dc.n)) / any_value(total), 9) AS containment FROM ic JOIN dc USING (c) JOIN total USING (item) GROUP BY item, doc"""


@query(CONTAMINATION)
def contamination_scan(spark, sf_dir):
    """How much of each benchmark item each document holds."""
    items = stored(kmers.record_kmers(kmers.spread(benchmark_axis(spark, sf_dir)), K), "items")
    docs = kmers.spread(document_axis(spark, sf_dir))
    if items.count() <= match.BROADCAST_ROWS:  # so few are sent to all tasks, and nothing else of the documents is shuffled
        known = items.select("kv").distinct().toArrow().column("kv").to_numpy()
        items, docs = F.broadcast(items), kmers.record_kmers(docs, K, among=known)
    else:
        docs = kmers.record_kmers(docs, K)
    return nine(B.contamination(items, docs), "containment")


def source_axis(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sources as records, from 0 by the number in their name, then those without one by name, null last; their documents' bases in the order of ids with an N between two: the records, without sequences, and the documents as pieces of them. No row and no task holds a source, and sequences are joined once, with where they go."""
    texts = read(spark, sf_dir, "documents").select("doc_id", "source", letters_as_bases(F.col("text")).alias("seq"))
    order = Window.orderBy(F.regexp_extract("source", "[0-9]+", 0).try_cast("long").asc_nulls_last(), F.col("source").asc_nulls_last())
    sizes = stored(texts.select("doc_id", "source", F.length("seq").cast("long").alias("len")), "sizes")
    lengths = sizes.groupBy("source").agg((F.sum(F.col("len") + 1) - 1).cast("long").alias("len")).select(F.col("source").alias("name"), (F.row_number().over(order) - 1).cast("long").alias("rec"), "len")
    records = stored(with_running_total(lengths, "rec", "len", "start").select("rec", "name", "start", "len", F.lit(0).cast("long").alias("offset")), "sources")
    numbered = sizes.withColumn("size", F.col("len") + 1).join(records.select("rec", "name", "start"), F.col("source").eqNullSafe(F.col("name")))
    placed = stored(with_running_total(numbered, "doc_id", "size", "at", keys=("rec",)).select("doc_id", "rec", (F.col("start") + F.col("at")).alias("start"), "len"), "places")
    return records, kmers.squeezed(texts, "doc_id", placed)


# Sources as source_axis() lays them out, what windows hold of the first one, and rounds: `steps` has the state before each.
COVER = f"""{DOC_KM}, number AS (SELECT source AS name, row_number() OVER (ORDER BY TRY_CAST(regexp_extract(source, '[0-9]+') AS BIGINT) NULLS LAST, source NULLS LAST) - 1 AS r FROM (SELECT DISTINCT source FROM documents)),
laid AS (SELECT doc.rec AS d, r, doc.start AS s, sum(doc.len + 1) OVER (PARTITION BY r ORDER BY doc.rec) - doc.len - 1 AS ahead, doc.len FROM doc JOIN documents ON doc.rec = doc_id JOIN number ON source IS NOT DISTINCT FROM name),
long AS (SELECT r, CAST(max(ahead + len) AS BIGINT) AS len FROM laid GROUP BY 1),
wide AS (SELECT CAST(greatest({gather.LEAST_BP}, ceil(coalesce(sum(len) FILTER (WHERE r <> 0), 1) / {gather.TILES}.0)) AS BIGINT) AS tile, CAST(ceil(max(len) FILTER (WHERE r = 0) / {gather.SLICES}.0) AS BIGINT) AS slice FROM long),
put AS MATERIALIZED (SELECT r, CAST(ahead + pos - s AS BIGINT) AS p, least(km, {rc("km")}) AS c FROM dk JOIN laid ON dk.rec = d),
own AS MATERIALIZED (SELECT c, count(*) AS total FROM put WHERE r = 0 GROUP BY 1),
tiles AS (SELECT c, r, p // tile AS t, count(*) AS n FROM put, wide WHERE r <> 0 AND c IN (SELECT c FROM own) GROUP BY 1, 2, 3),
kinds AS MATERIALIZED (SELECT *, row_number() OVER () AS kind FROM (SELECT total, several, held, count(*) AS copies FROM (
  SELECT total, min(r) < max(r) AS several, list({{'r': r, 't': t, 'n': n}} ORDER BY r, t) AS held FROM tiles JOIN own USING (c) GROUP BY c, total) GROUP BY 1, 2, 3)),
least_ AS (SELECT greatest(1, {gather.SHARE} * sum(total)) AS least FROM own),
steps AS (
  SELECT 0 AS turn, kind, h.r, h.t, h.n, CAST(total AS BIGINT) AS room, several, copies FROM kinds, UNNEST(held) u(h)
  UNION ALL
  SELECT turn + 1, s.kind, s.r, s.t, s.n, s.room - coalesce(x.take, 0), several, copies
  FROM steps s CROSS JOIN least_ CROSS JOIN (SELECT r, t, sum(copies * least(n, room)) AS gain FROM steps GROUP BY 1, 2 ORDER BY gain DESC, r, t LIMIT 1) b
    LEFT JOIN (SELECT kind, least(n, room) AS take FROM steps JOIN (SELECT r, t, sum(copies * least(n, room)) AS gain FROM steps GROUP BY 1, 2 ORDER BY gain DESC, r, t LIMIT 1) USING (r, t)) x ON x.kind = s.kind
  WHERE b.gain >= least AND turn < {gather.ROUNDS - 1} AND NOT (s.r = b.r AND s.t = b.t) AND s.room > coalesce(x.take, 0)),
gains AS (SELECT turn, r, t, sum(copies * least(n, room)) AS mass, sum(CASE WHEN several THEN copies * least(n, room) ELSE 0 END) AS contested FROM steps GROUP BY 1, 2, 3),
claimed AS (SELECT g.* FROM gains g, least_ WHERE mass >= least QUALIFY row_number() OVER (PARTITION BY turn ORDER BY mass DESC, r, t) = 1),
found AS (
  SELECT r AS rec, CAST(min(t) * any_value(tile) AS BIGINT) AS lo, CAST(least((max(t) + 1) * any_value(tile), any_value(len)) AS BIGINT) AS hi, CAST(sum(mass) AS DOUBLE) AS mass, CAST(sum(contested) AS DOUBLE) AS contested
  FROM (SELECT *, t - row_number() OVER (PARTITION BY r ORDER BY t) AS g FROM claimed) JOIN long USING (r), wide GROUP BY r, g)"""


def first_source(spark, sf_dir) -> tuple[DataFrame, int, DataFrame]:
    """The sources' records, the first one's number, and the pieces of all."""
    axis, pieces = source_axis(spark, sf_dir)
    return axis, axis.agg(F.min("rec")).first()[0], pieces


@query(f"WITH RECURSIVE {COVER} SELECT * FROM found")
def gather_components(spark, sf_dir):
    """The first source as a cover by windows of the others, from all k-mers of both."""
    axis, rec, table = first_source(spark, sf_dir)
    rows, width, _ = gather.gather(table, axis, rec, k=K)
    return gather.components(rows, axis, width)


@query(f"""WITH RECURSIVE {COVER}, ranked AS (SELECT mass, row_number() OVER (ORDER BY mass DESC, rec, lo) AS p FROM found), whole AS (SELECT CAST(sum(total) AS DOUBLE) AS m FROM own),
parts AS (SELECT CAST(least(p, 9) AS INTEGER) AS place, sum(mass) AS mass FROM ranked GROUP BY 1 UNION ALL SELECT 10, m - coalesce((SELECT sum(mass) FROM found), 0) FROM whole)
SELECT place, mass, round(mass / greatest(m, 1), 9) AS share FROM parts, whole""")
def gather_summary(spark, sf_dir):
    """The heaviest components of the first source's cover, the others and what is unexplained."""
    axis, rec, table = first_source(spark, sf_dir)
    rows, width, _ = gather.gather(table, axis, rec, k=K)
    told = gather.summary(gather.components(rows, axis, width), rows.filter("kind = 'total'").first()["mass"])
    return nine(told.withColumn("place", F.col("place").cast("int")), "share")


@query(f"""WITH RECURSIVE {COVER}, used AS (SELECT kind, c.r, c.turn, least(s.n, s.room) * 1e0 / total AS part FROM claimed c JOIN steps s USING (turn, r, t) JOIN kinds USING (kind)),
named AS (SELECT c, kind FROM (SELECT c, total, min(r) < max(r) AS several, list({{'r': r, 't': t, 'n': n}} ORDER BY r, t) AS held FROM tiles JOIN own USING (c) GROUP BY c, total) JOIN kinds USING (total, several, held)),
cut AS (SELECT c, p // slice AS slice, count(*) AS n FROM put, wide WHERE r = 0 GROUP BY 1, 2),
totals AS (SELECT slice, sum(n) AS total FROM cut GROUP BY 1),
paint AS (SELECT slice, r AS rec, sum(n * part) AS mass FROM cut JOIN named USING (c) JOIN used USING (kind) GROUP BY 1, 2),
top AS (SELECT slice, arg_max(rec, (round(mass, 6), -rec)) AS rec, sum(mass) AS mass FROM paint GROUP BY 1)
SELECT CAST(slice AS BIGINT) AS slice, rec, round(least(1e0, mass / total), 6) AS explained FROM top JOIN totals USING (slice) WHERE least(1e0, mass / total) > 0.02""")
def gather_strip(spark, sf_dir):
    """Of each slice of the first source the record that explains most of it. Sums are rounded, so that their order decides no tie."""
    axis, rec, table = first_source(spark, sf_dir)
    rows, _, slice_bp = gather.gather(table, axis, rec, k=K)
    rows = rows.withColumn("mass", F.when(F.col("kind") == "paint", F.round("mass", 6)).otherwise(F.col("mass")))
    own = rows.filter("kind = 'slice'").select(F.col("place").alias("slice"), F.col("mass").alias("total"))
    return gather.strip(rows, own).withColumn("explained", F.round("explained", 6))


# Claims that stand in for a cover: records and windows of 1,024 bases with a mass.
CLAIMS = """claims AS (SELECT l_suppkey AS rec, CAST(1024 * (l_partkey % 40) AS BIGINT) AS place, CAST(sum(l_quantity) AS DOUBLE) AS mass, CAST(sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS DOUBLE) AS contested FROM lineitem WHERE l_partkey % 3 < 2 GROUP BY 1, 2),
comp AS (
  SELECT rec, min(place) AS lo, least(max(place) + 1024, 40000) AS hi, sum(mass) AS mass, sum(contested) AS contested
  FROM (SELECT *, place // 1024 - row_number() OVER (PARTITION BY rec ORDER BY place) AS g FROM claims) GROUP BY rec, g)"""


def claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    l = read(spark, sf_dir, "lineitem").filter("l_partkey % 3 < 2")
    rows = l.groupBy(F.col("l_suppkey").alias("rec"), (1024 * (F.col("l_partkey") % 40)).cast("long").alias("place")).agg(F.sum("l_quantity").cast("double").alias("mass"), F.sum(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).otherwise(0)).cast("double").alias("contested"))
    return rows.withColumn("kind", F.lit("claim")), rows.select("rec").distinct().withColumn("len", F.lit(40_000).cast("long"))


@query(f"WITH {CLAIMS} SELECT * FROM comp")
def cover_components(spark, sf_dir):
    """Neighbouring claimed windows of a record as one."""
    return gather.components(*claims(spark, sf_dir), 1024)


@query(f"""WITH {CLAIMS}, ranked AS (SELECT mass, row_number() OVER (ORDER BY mass DESC, rec, lo) AS p FROM comp), parts AS (
  SELECT CAST(least(p, 9) AS INTEGER) AS place, sum(mass) AS mass FROM ranked GROUP BY 1 UNION ALL SELECT 10, 2e6 - sum(mass) FROM comp)
SELECT place, mass, round(mass / 2e6, 9) AS share FROM parts""")
def cover_summary(spark, sf_dir):
    """The heaviest components, the others and what is unexplained."""
    found = gather.summary(gather.components(*claims(spark, sf_dir), 1024), 2e6)
    return nine(found.withColumn("place", F.col("place").cast("int")), "share")


@query("""WITH paint AS (SELECT CAST(o_custkey % 97 AS BIGINT) AS place, o_orderkey % 11 AS rec, sum(CAST(o_totalprice AS DOUBLE)) AS mass FROM orders GROUP BY 1, 2), totals AS (SELECT place AS slice, 3e6 + 1e5 * place AS total FROM (SELECT DISTINCT place FROM paint)),
top AS (SELECT place, arg_max(rec, (mass, -rec)) AS rec, sum(mass) AS mass FROM paint GROUP BY 1)
SELECT slice, rec, round(least(1.0, mass / total), 6) AS explained FROM top JOIN totals ON slice = place WHERE least(1.0, mass / total) > 0.02""")
def cover_strip(spark, sf_dir):
    """Of each slice the record that explains most of it."""
    paint = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 97).cast("long").alias("place"), (F.col("o_orderkey") % 11).alias("rec")).agg(F.sum(F.col("o_totalprice").cast("double")).alias("mass")).withColumn("kind", F.lit("paint"))
    totals = paint.select(F.col("place").alias("slice")).distinct().withColumn("total", 3e6 + 1e5 * F.col("slice"))
    return gather.strip(paint, totals).withColumn("explained", F.round("explained", 6))


@query(f"WITH {DOC}, {ITEM}, t AS (SELECT max(rec) + 1 AS r, sum(len) AS n FROM doc) SELECT rec, CAST(start AS BIGINT) AS start, len FROM doc UNION ALL SELECT CAST(item.rec + r AS BIGINT), CAST(start + n AS BIGINT), len FROM item, t")
def axis_concat(spark, sf_dir):
    """M2: two axes on one."""
    return kmers.concatenate(document_axis(spark, sf_dir), benchmark_axis(spark, sf_dir)).select("rec", "start", "len")


@query(f"""WITH {DOC}, {ITEM}, both_ AS (SELECT rec AS ord, 0 AS f, 'doc' || rec AS name, seq, len, CAST(3 * rec AS BIGINT) AS "offset" FROM doc UNION ALL SELECT rec, 1, 'item' || rec, seq, len, 0 FROM item)
SELECT row_number() OVER o - 1 AS rec, name, CAST(sum(len) OVER (o ROWS UNBOUNDED PRECEDING) - len AS BIGINT) AS start, len, "offset", md5(seq) AS seq_md5 FROM both_ WINDOW o AS (ORDER BY f, ord)""")
def fasta_axis(spark, sf_dir):
    """Documents and benchmark items as two FASTA files, written to the shared folder, read back and stacked."""
    folder = scratch(spark, "fasta")
    for name, axis, offset in (("doc", document_axis(spark, sf_dir), 3 * F.col("rec")), ("item", benchmark_axis(spark, sf_dir), F.lit(0))):
        lines = F.regexp_replace("seq", "(.{60})", "$1\n")
        text = axis.select("rec", F.concat(F.lit(">"), "name", F.lit(" @offset="), offset.cast("string"), F.lit("\n"), lines).alias("value"))
        text.repartitionByRange(tasks(spark), "rec").sortWithinPartitions("rec").select("value").write.text(f"{folder}/{name}")
    return fasta.read_axis(spark, f"{folder}/doc", f"{folder}/item").select("rec", "name", "start", "len", "offset", F.md5("seq").alias("seq_md5"))


@query(f"""WITH {DOC} SELECT rec, 'doc' || rec AS name, start, len, CAST(3 * rec AS BIGINT) AS "offset", md5(seq) AS seq_md5 FROM (SELECT row_number() OVER (ORDER BY rec) - 1 AS rec, rec AS key, seq, start, len FROM doc)""".replace("'doc' || rec", "'doc' || key").replace("3 * rec", "3 * key"))
def bgzf_axis(spark, sf_dir):
    """Documents as FASTA in BGZF files, each read back by several tasks."""
    folder = scratch(spark, "bgzf")
    axis = document_axis(spark, sf_dir)
    text = axis.select("rec", F.concat(F.lit(">"), "name", F.lit(" @offset="), (3 * F.col("rec")).cast("string"), F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value"))
    bgzf.write_bgzf(text.repartitionByRange(tasks(spark), "rec").sortWithinPartitions("rec").select("value"), folder)
    return fasta.read_axis(spark, folder, split=bgzf.split_for(folder, 4 * tasks(spark))).select("rec", "name", "start", "len", "offset", F.md5("seq").alias("seq_md5"))


PIECE = 4096


@query(f"""WITH {DOC}, cut AS (SELECT rec, a, seq, len FROM doc, UNNEST(range(0, greatest(len, 1), {PIECE})) c(a))
SELECT 'doc' || rec AS name, CAST(a AS BIGINT) AS start, CAST(least(a + {PIECE}, len) AS BIGINT) AS "end", md5(substr(seq, CAST(a + 1 AS INTEGER), {PIECE})) AS seq_md5 FROM cut""")
def twobit_read(spark, sf_dir):
    """Documents as 2bit files, read by ranges in pieces."""
    folder = scratch(spark, "twobit")
    axis = document_axis(spark, sf_dir)
    binary.write_twobit(axis.select("name", "seq").repartition(max(tasks(spark), kmers.total_length(axis) >> 25)), folder)
    return binary.twobit_pieces(spark, folder, piece=PIECE, task=binary.PIECE).select("name", "start", "end", F.md5("seq").alias("seq_md5"))


BED_WINDOWS = [("A", 1000, 9000), ("N", 0, 5000), ("N", 4000, 7000), ("R", 2000, 2500), ("X", 0, 10)]


BED_ITEMS = """SELECT l_returnflag AS chrom, l_partkey * 10 AS start, l_partkey * 10 + CAST(l_quantity AS BIGINT) + 1 AS "end", 'L' || l_linenumber AS name, CASE l_linestatus WHEN 'O' THEN '+' ELSE '-' END AS strand, CASE l_linenumber WHEN 1 THEN '1,2,3' END AS rgb FROM lineitem"""


def bed_file(spark, sf_dir) -> str:
    """Order lines as items of bigBed files."""
    folder = scratch(spark, "bigbed")
    at = (F.col("l_partkey") * 10).cast("long")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), at.alias("start"), (at + F.col("l_quantity").cast("long") + 1).alias("end"), F.concat(F.lit("L"), "l_linenumber").alias("name"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), F.when(F.col("l_linenumber") == 1, "1,2,3").alias("rgb"))
    binary.write_bigbed(items.repartitionByRange(max(8, tasks(spark)), "chrom", "start"), folder)
    return folder


@query(f"""WITH items AS ({BED_ITEMS})
SELECT * FROM items WHERE {" OR ".join(f"(chrom = '{c}' AND start < {e} AND {chr(34)}end{chr(34)} > {s_})" for c, s_, e in BED_WINDOWS)}""")
def bigbed_windows(spark, sf_dir):
    """Order lines as items of bigBed files, those in some windows read by the index."""
    return binary.read_bigbed(spark, bed_file(spark, sf_dir), BED_WINDOWS)


@query(f"""WITH items AS ({BED_ITEMS})
SELECT chrom, start, "end", name, min(strand) AS strand, rgb FROM items WHERE chrom = 'N' AND start < 12345 AND "end" > 3210 GROUP BY ALL""")
def annotation_view(spark, sf_dir):
    """A view of annotations from tiles, some of which an earlier view has read."""
    folder = bed_file(spark, sf_dir)
    cache = TileCache(lambda windows: binary.read_bigbed(spark, folder, windows), tile_bp=1024)
    cache.view("N", 2048, 6000)
    return cache.view("N", 3210, 12345)


# ---------------------------------------------------------------- intervals
CATALOG = f'{DOC}, cat AS (SELECT rec, \'doc\' || rec AS name, start, start + len AS "end", CAST(1000 * rec AS BIGINT) AS "offset" FROM doc)'


def document_catalog(spark, sf_dir) -> DataFrame:
    return kmers.catalog(document_axis(spark, sf_dir)).withColumn("offset", (1000 * F.col("rec")).cast("long"))


@query(f"""WITH {CATALOG}, g AS (SELECT event_id, event_id * 997 AS g FROM events)
SELECT event_id, g.g, rec, name, g.g - start AS "local", g.g - start + "offset" AS shown FROM g LEFT JOIN cat ON start <= g.g AND g.g < "end\"""")
def record_locate(spark, sf_dir):
    """Places to records; null beyond the axis."""
    return intervals.locate(read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 997).alias("g")), document_catalog(spark, sf_dir))


@query(f'WITH {CATALOG} SELECT * FROM cat WHERE "end" > 5000 AND start < 250000')
def bands_in_range(spark, sf_dir):
    """J8."""
    return intervals.bands(document_catalog(spark, sf_dir), 5000, 250_000)


ITEMS = """items AS (SELECT DISTINCT chrom, start, "end", name FROM (
  SELECT 'doc' || conv_id AS chrom, CAST(1000 * conv_id + 60 * turn AS BIGINT) AS start, CAST(1000 * conv_id + 60 * turn + length(text) AS BIGINT) AS "end", role AS name FROM conversations))"""


@query(f"""WITH {CATALOG}, {ITEMS}
SELECT rec, greatest("offset", i.start) + c.start - "offset" AS w0, least("offset" + c."end" - c.start, i."end") + c.start - "offset" AS w1, i.name AS item_name
FROM cat c JOIN items i ON c.name = i.chrom AND i.start < "offset" + c."end" - c.start AND i."end" > "offset\"""")
def interval_overlap_clip(spark, sf_dir):
    """Spans of conversations as annotations, clipped to the documents they fall on."""
    items = read(spark, sf_dir, "conversations").select(F.concat(F.lit("doc"), "conv_id").alias("chrom"), (1000 * F.col("conv_id") + 60 * F.col("turn")).cast("long").alias("start"), (1000 * F.col("conv_id") + 60 * F.col("turn") + F.length("text")).cast("long").alias("end"), F.col("role").alias("name"), F.lit("+").alias("strand"), F.lit(None).cast("string").alias("rgb"))
    return intervals.annotate(items, document_catalog(spark, sf_dir)).select("rec", "w0", "w1", "item_name")


@query("""WITH names AS (SELECT s_suppkey, 'chr' || s_suppkey % 30 || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'p' WHEN 2 THEN 'q' ELSE '_alt' END AS name FROM supplier), known AS (SELECT 'chr' || n_nationkey AS chrom FROM nation)
SELECT s_suppkey, name, coalesce(a.chrom, b.chrom, c.chrom) AS chrom FROM names LEFT JOIN known a ON a.chrom = name LEFT JOIN known b ON b.chrom = regexp_replace(name, '[pq]$', '') LEFT JOIN known c ON c.chrom = split_part(name, '_', 1)""")
def name_resolution(spark, sf_dir):
    """J10."""
    k = F.col("s_suppkey")
    names = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("chr"), k % 30, F.when(k % 4 == 0, "").when(k % 4 == 1, "p").when(k % 4 == 2, "q").otherwise("_alt")).alias("name"))
    return intervals.resolve_names(names, read(spark, sf_dir, "nation").select(F.concat(F.lit("chr"), "n_nationkey").alias("chrom")))


@query("""WITH bands AS (SELECT c_mktsegment AS chrom, c_custkey AS start, c_custkey + 10 AS "end", CASE WHEN c_nationkey < 12 THEN 'p1' ELSE 'q1' END AS band FROM customer), sizes AS (SELECT c_mktsegment AS chrom, max(c_custkey) + 100 AS size FROM customer GROUP BY 1)
SELECT chrom, max("end") FILTER (WHERE band LIKE 'p%') AS p_end, min(start) FILTER (WHERE band LIKE 'q%') AS q_start, any_value(size) AS size FROM bands JOIN sizes USING (chrom) GROUP BY chrom""")
def arm_ranges(spark, sf_dir):
    """S13."""
    c = read(spark, sf_dir, "customer")
    bands = c.select(F.col("c_mktsegment").alias("chrom"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + 10).alias("end"), F.when(F.col("c_nationkey") < 12, "p1").otherwise("q1").alias("band"))
    return intervals.arm_ranges(bands, c.groupBy(F.col("c_mktsegment").alias("chrom")).agg((F.max("c_custkey") + 100).alias("size")))


# ---------------------------------------------------------------- PAF
PAF_TEXT = """paf AS (SELECT l_orderkey * 10 + l_linenumber AS line_no,
  concat_ws(chr(9), 'doc' || l_suppkey, CAST(CASE WHEN l_linenumber = 1 THEN 100000 ELSE 2000 + l_suppkey END AS VARCHAR), CAST(l_linenumber * 100 AS VARCHAR), CAST(l_linenumber * 100 + l_suppkey AS VARCHAR), CASE l_returnflag WHEN 'R' THEN '-' WHEN 'A' THEN '+' ELSE CASE WHEN l_linestatus = 'O' THEN '+' ELSE '*' END END,
    'item' || l_partkey % 60, '1000', CAST(l_partkey % 500 AS VARCHAR), CAST(l_partkey % 700 AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_suppkey + l_linenumber AS VARCHAR), '60') AS value FROM lineitem),
parts AS (SELECT line_no, string_split(value, chr(9)) AS p FROM paf),
cols AS (SELECT line_no, p[1] AS qname, CAST(p[2] AS BIGINT) AS qlen, CAST(p[3] AS BIGINT) AS qs, CAST(p[4] AS BIGINT) AS qe, p[5] AS strand, p[6] AS tname, CAST(p[7] AS BIGINT) AS tlen, CAST(p[8] AS BIGINT) AS ts, CAST(p[9] AS BIGINT) AS te, CAST(p[10] AS BIGINT) AS nmatch, CAST(p[11] AS BIGINT) AS alnlen FROM parts),
checked AS (SELECT *, strand IN ('+', '-') AND qe > qs AND te > ts AS valid, least(1.0, nmatch / CAST(alnlen AS DOUBLE)) AS identity FROM cols)"""


def paf_lines(spark, sf_dir) -> DataFrame:
    """PAF text made of order lines; some lines have a strand or a span that is not valid. The lines are stored, as a file's would be: the making of a text and its parsing in one generated method are more than the JVM compiles."""
    text = lambda c: c.cast("string")
    n, s, p = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")
    strand = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", "+").otherwise(F.when(F.col("l_linestatus") == "O", "+").otherwise("*"))
    value = F.concat_ws("\t", F.concat(F.lit("doc"), s), text(F.when(n == 1, F.lit(100_000).cast("long")).otherwise(2000 + s)), text(n * 100), text(n * 100 + s), strand, F.concat(F.lit("item"), p % 60), F.lit("1000"), text(p % 500), text(p % 700), text(s), text(s + n), F.lit("60"))
    return stored(read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("line_no"), value.alias("value")), "paf-lines")


@query(f"WITH {PAF_TEXT} SELECT line_no, qname, qlen, qs, qe, strand, tname, tlen, ts, te, nmatch, alnlen, valid, round(identity, 9) AS identity FROM checked")
def paf_validate(spark, sf_dir):
    """S4."""
    return nine(paf.parse(paf_lines(spark, sf_dir)).drop("mapq", "tags"), "identity")


NUMBERED = PAF_TEXT.replace("AS p FROM paf)", "AS p FROM (SELECT row_number() OVER (ORDER BY line_no, value) - 1 AS line_no, value FROM paf))")


@query(f"WITH {NUMBERED} SELECT line_no, qname, tname, valid, round(identity, 9) AS identity FROM checked")
def paf_bgzf(spark, sf_dir):
    """PAF lines in BGZF files, numbered over the tasks that read them."""
    folder = scratch(spark, "bgzf")
    lines = paf_lines(spark, sf_dir)
    bgzf.write_bgzf(lines.repartitionByRange(tasks(spark), "line_no", "value").sortWithinPartitions("line_no", "value").select("value"), folder)
    return nine(paf.parse(paf.read_lines(spark, folder, split=bgzf.split_for(folder, 4 * tasks(spark)))).select("line_no", "qname", "tname", "valid", "identity"), "identity")


@query(f"""WITH {PAF_TEXT}, first_ AS (SELECT qname AS name, arg_min(qlen, line_no) AS len, min(line_no) AS f FROM checked WHERE valid GROUP BY 1)
SELECT row_number() OVER o - 1 AS rec, name, CAST(sum(len) OVER (o ROWS UNBOUNDED PRECEDING) - len AS BIGINT) AS start, CAST(sum(len) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM first_ WINDOW o AS (ORDER BY len DESC, f, name)""")
def paf_catalog(spark, sf_dir):
    """The query axis of a PAF file."""
    return paf.paf_catalog(paf.parse(paf_lines(spark, sf_dir)).filter("valid"), "qname", "qlen")


OVERLAY = f"""{PAF_TEXT}, {CATALOG}, {ITEM}, tcat AS (SELECT 'item' || rec AS name, start AS t0, len AS tw FROM item), qcat AS (SELECT name AS qn, start AS q0, "end" - start AS qw, "offset" AS qo FROM cat),
placed AS (SELECT *, CASE WHEN tlen = tw THEN CASE WHEN te <= tw THEN ts END END AS tl, CASE WHEN qlen = qw THEN CASE WHEN qe <= qw THEN qs END WHEN qo > 0 AND qs >= qo AND qe <= qo + qw THEN qs - qo END AS ql FROM checked LEFT JOIN tcat ON tcat.name = tname LEFT JOIN qcat ON qn = qname),
overlaid AS (SELECT *, CASE WHEN NOT valid THEN 'skipped' WHEN t0 IS NULL OR q0 IS NULL THEN 'unknown' WHEN tl IS NULL OR ql IS NULL THEN 'mismatch' WHEN tlen <> tw OR qlen <> qw THEN 'remapped' ELSE 'kept' END AS status FROM placed)"""


@query(f"WITH {OVERLAY} SELECT line_no, status FROM overlaid")
def paf_overlay(spark, sf_dir):
    """What becomes of each line on axes that are loaded."""
    return paf.overlay(paf.parse(paf_lines(spark, sf_dir)), kmers.catalog(benchmark_axis(spark, sf_dir)), document_catalog(spark, sf_dir)).select("line_no", "status")


@query(f"WITH {OVERLAY} SELECT count(*) FILTER (WHERE status IN ('kept', 'remapped')) AS kept, count(*) FILTER (WHERE status = 'remapped') AS remapped, count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) FILTER (WHERE status = 'mismatch') AS mismatch, count(*) FILTER (WHERE status = 'skipped') AS skipped, min(identity) FILTER (WHERE status IN ('kept', 'remapped')) AS identity_min FROM overlaid")
def paf_overlay_counts(spark, sf_dir):
    """Z8."""
    return paf.overlay_counts(paf.overlay(paf.parse(paf_lines(spark, sf_dir)), kmers.catalog(benchmark_axis(spark, sf_dir)), document_catalog(spark, sf_dir)))


# ---------------------------------------------------------------- segments as results
@query(f"WITH {SEG} SELECT x, y, dx, dy, strand, qrec, trec, gap_bases, round(identity, 9) AS identity FROM seg WHERE strand = 0 AND identity + 1e-6 >= 0.9 AND dx + 0.5 >= 40")
def segment_visible(spark, sf_dir):
    """W5."""
    return shown(segments(spark, sf_dir).filter(raster.visible(0.9, 40, reverse=False)))


@query(f"WITH {SEG} SELECT strand, x AS x0, CASE WHEN strand = 0 THEN y ELSE y + dy END AS y0, x + dx AS x1, CASE WHEN strand = 0 THEN y + dy ELSE y END AS y1 FROM seg")
def segment_endpoints(spark, sf_dir):
    """P12."""
    return raster.endpoints(segments(spark, sf_dir)).select("strand", "x0", "y0", "x1", "y1")


@query(f"WITH {SEG} SELECT strand, count(*) AS n, CAST(sum(dx) AS BIGINT) AS bp FROM seg GROUP BY strand")
def segment_totals(spark, sf_dir):
    """A14."""
    return summary.segment_totals(segments(spark, sf_dir))


@query(f"""WITH {SEG}, e AS (SELECT strand, dx, pow(10, floor(log10(dx))) AS m FROM seg)
SELECT CAST(round(CASE WHEN dx <= m THEN m WHEN dx <= 2 * m THEN 2 * m WHEN dx <= 5 * m THEN 5 * m ELSE 10 * m END) AS BIGINT) AS edge, strand, count(*) AS n FROM e GROUP BY 1, 2""")
def length_ladder(spark, sf_dir):
    """A16."""
    return summary.length_distribution(segments(spark, sf_dir))


@query(f"""WITH {SEG}, lo AS (SELECT least(0.99, floor(min(identity) * 100) / 100) AS lo FROM seg), n AS (SELECT lo, greatest(8, least(40, CAST(floor((1 - lo) * 100 + 0.5) AS INTEGER) * 2)) AS n FROM lo)
SELECT CAST(least(n - 1, greatest(0, floor((identity - lo) / ((1 - lo) / n)))) AS INTEGER) AS bin, strand, count(*) AS n FROM (SELECT seg.strand, seg.identity, n.lo, n.n FROM seg, n) GROUP BY 1, 2""".replace("count(*) AS n FROM (SELECT seg.strand", "count(*) AS total FROM (SELECT seg.strand"))
def identity_distribution(spark, sf_dir):
    """A16, A25."""
    return summary.identity_distribution(segments(spark, sf_dir)).withColumnRenamed("n", "total")


def heat(spark, sf_dir) -> DataFrame:
    x, y = kmers.total_length(benchmark_axis(spark, sf_dir)), kmers.total_length(document_axis(spark, sf_dir))
    return raster.identity_heatmap(segments(spark, sf_dir), (0, x, 0, y), 50, 100)


HEAT = f"""{SEG}, b AS (SELECT 50 / CAST((SELECT sum(len) FROM item) AS DOUBLE) AS fx, 100 / CAST((SELECT sum(len) FROM doc) AS DOUBLE) AS fy),
e AS (SELECT identity, x * fx AS ax, (CASE WHEN strand = 0 THEN y ELSE y + dy END) * fy AS ay, (x + dx) * fx AS ex, (CASE WHEN strand = 0 THEN y + dy ELSE y END) * fy AS ey FROM seg, b),
st AS (SELECT *, least(4096, CAST(floor(greatest(abs(ex - ax), abs(ey - ay), 1.0)) AS INTEGER)) + 1 AS steps FROM e),
cells AS (SELECT CAST(floor(ax + (ex - ax) * (t / CAST(greatest(steps - 1, 1) AS DOUBLE))) AS INTEGER) AS cx, CAST(floor(ay + (ey - ay) * (t / CAST(greatest(steps - 1, 1) AS DOUBLE))) AS INTEGER) AS cy, identity FROM st, UNNEST(range(0, steps)) u(t)),
heat AS (SELECT cx, cy, max(identity) AS v FROM cells WHERE cx BETWEEN 0 AND 49 AND cy BETWEEN 0 AND 99 GROUP BY 1, 2)"""


@query(f"WITH {HEAT} SELECT cx, cy, round(v, 9) AS v FROM heat")
def identity_heatmap(spark, sf_dir):
    """The whole comparison on 50 by 100 cells."""
    return nine(heat(spark, sf_dir), "v")


@query(f"WITH {HEAT}, r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM heat), l AS (SELECT max(v) FILTER (WHERE i = floor(n * 0.02)) AS lo, max(v) AS hi FROM r) SELECT round(CASE WHEN hi - lo < 0.005 THEN greatest(0, hi - 0.05) ELSE lo END, 9) AS lo, round(hi, 9) AS hi FROM l")
def contrast_stretch(spark, sf_dir):
    """A19."""
    return nine(raster.contrast(heat(spark, sf_dir)), "lo", "hi")


@query(f"""WITH {SATURATED}, f AS (SELECT 200 / CAST((SELECT n FROM total) AS DOUBLE) AS f)
SELECT DISTINCT CAST(c AS INTEGER) AS cell FROM (SELECT CAST(greatest(0, floor(start * f)) AS BIGINT) AS a, CAST(least(200, ceil("end" * f)) AS BIGINT) AS b FROM saturated, f), UNNEST(range(a, b)) u(c)""")
def saturation_mask(spark, sf_dir):
    """A20, Z5."""
    found, total = saturated(spark, sf_dir)
    return raster.saturation_mask(found, 0, total, 200)


@query(f"""WITH {SATURATED}, {ITEM}, {sql_match(OPTIONS)}, {{HEAT_TAIL}}, f AS (SELECT 100 / CAST((SELECT n FROM total) AS DOUBLE) AS f),
mask AS (SELECT DISTINCT CAST(c AS INTEGER) AS cy FROM (SELECT CAST(greatest(0, floor(start * f)) AS BIGINT) AS a, CAST(least(100, ceil("end" * f)) AS BIGINT) AS b FROM saturated, f), UNNEST(range(a, b)) u(c))
SELECT m.cy AS cx, CAST(r.x AS INTEGER) AS cy FROM mask m, range(0, 50) r(x) WHERE (m.cy + r.x) & 3 < 2 AND NOT EXISTS (SELECT 1 FROM heat WHERE heat.cx = r.x AND heat.cy = m.cy)""".replace("{HEAT_TAIL}", HEAT.split(SEG + ", ")[1]))
def hatch_cells(spark, sf_dir):
    """Empty cells where the documents are saturated, with documents across."""
    found, total = saturated(spark, sf_dir)
    cells = heat(spark, sf_dir).select(F.col("cy").alias("cx"), F.col("cx").alias("cy"))
    return raster.hatched(cells, raster.saturation_mask(found, 0, total, 100), 100, 50)


@query(f"""WITH {SEG}, tcat AS (SELECT 'item' || rec AS name, start, start + len AS "end" FROM item WHERE len > 0), qcat AS (SELECT 'doc' || rec AS name, start, start + len AS "end" FROM doc WHERE len > 0),
p AS (SELECT seg.*, a.name AS an, x - a.start + 1 AS a1, b.name AS bn, x + dx - b.start AS b1, c.name AS cn, y - c.start + 1 AS c1, d.name AS dn, y + dy - d.start AS d1 FROM seg
  JOIN tcat a ON a.start <= x AND x < a."end" JOIN tcat b ON b.start <= x + dx - 1 AND x + dx - 1 < b."end" JOIN qcat c ON c.start <= y AND y < c."end" JOIN qcat d ON d.start <= y + dy - 1 AND y + dy - 1 < d."end")
SELECT x, y, strand, CASE WHEN an = bn THEN an || ' : ' || format('{{:,}}', a1) || '–' || format('{{:,}}', b1) ELSE an || ':' || format('{{:,}}', a1) || ' → ' || bn || ':' || format('{{:,}}', b1) END AS target,
  CASE WHEN cn = dn THEN cn || ' : ' || format('{{:,}}', c1) || '–' || format('{{:,}}', d1) ELSE cn || ':' || format('{{:,}}', c1) || ' → ' || dn || ':' || format('{{:,}}', d1) END AS query, CASE strand WHEN 1 THEN 'reverse' ELSE 'forward' END AS direction FROM p""")
def segment_labels(spark, sf_dir):
    """F16: where segments lie, in words."""
    catalogs = [kmers.catalog(a) for a in (benchmark_axis(spark, sf_dir), document_axis(spark, sf_dir))]
    return summary.described(segments(spark, sf_dir), *catalogs).select("x", "y", "strand", "target", "query", "direction")


@query(f"WITH {SEG}, s AS (SELECT count(*) AS n, min(identity) AS low FROM seg) SELECT CAST(CASE WHEN n > {summary.DENSE} THEN 0 END AS INTEGER) AS dense, round(CASE WHEN low >= 0.999 THEN 0.9 ELSE floor(low * 100) / 100 END, 9) AS floor FROM s")
def scale_picks(spark, sf_dir):
    """The least length that a dense result is shown from (none here) and where its identity scale begins."""
    found = segments(spark, sf_dir)
    return spark.createDataFrame([(summary.dense_length(found), round(summary.identity_floor(found.agg(F.min("identity")).first()[0]), 9))], "dense int, floor double")


PICTURES = ((100, 5), (100, 60), (100, 390), (10**9, 1))


@query(f"""WITH {SEG}, n AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE dx >= {c}) AS n{c}" for c in summary.DENSE_LENGTHS)} FROM seg)
SELECT CAST(dense AS INTEGER) AS dense, CAST(shown AS INTEGER) AS shown, CAST(CASE WHEN n > dense THEN CASE {" ".join(f"WHEN n{c} <= shown THEN {c}" for c in summary.DENSE_LENGTHS)} ELSE {summary.DENSE_LENGTHS[-1]} END END AS INTEGER) AS least FROM n, (VALUES {", ".join(map(str, PICTURES))}) v(dense, shown)""")
def dense_picks(spark, sf_dir):
    """The least length that is shown of a dense result, for several sizes of a picture."""
    found = stored(segments(spark, sf_dir), "segments")
    return spark.createDataFrame([(d, n, summary.dense_length(found, d, n)) for d, n in PICTURES], "dense int, shown int, least int")


LANE = "SELECT doc_id AS w0, doc_id + 3 + doc_id % 40 AS w1, source AS item_name, CASE doc_id % 3 WHEN 0 THEN '1,2,3' END AS rgb FROM documents"


@query(f"""WITH lane AS ({LANE}), r AS (SELECT greatest(0.0, (greatest(w0, 100.5) - 100.5) * (300 / 700.0::DOUBLE)) AS a, least(300.0, (least(w1, 800.5) - 100.5) * (300 / 700.0::DOUBLE)) AS b, CASE WHEN rgb IS NULL THEN 'accent' ELSE 'rgb(' || rgb || ')' END AS fill, item_name, '+' AS strand FROM lane)
SELECT round(a, 6) AS a, round(b, 6) AS b, fill, item_name, strand FROM r WHERE b - a >= 0.75""")
def lane_rects(spark, sf_dir):
    """lane items in a view, clipped to pixels."""
    i = F.col("doc_id")
    lane = read(spark, sf_dir, "documents").select(i.alias("w0"), (i + 3 + i % 40).alias("w1"), F.col("source").alias("item_name"), F.lit("+").alias("strand"), F.when(i % 3 == 0, "1,2,3").alias("rgb"))
    return intervals.lane_rects(lane, 100.5, 800.5, 300, colored=True).withColumns({c: F.round(c, 6) for c in "ab"})


@query(f"WITH {CATALOG}, seen AS (SELECT * FROM cat WHERE \"end\" > 5000 AND start < 250000) SELECT start AS g FROM seen WHERE rec > 0 AND 9000 / (SELECT count(*) FROM seen) > 6")
def boundary_lines(spark, sf_dir):
    """where records begin, if a view has room for it."""
    return intervals.boundary_lines(document_catalog(spark, sf_dir), 5000, 250_000, 9000)


@query(f"""WITH {SEG}, e AS (SELECT *, x AS x0, CASE WHEN strand = 0 THEN y ELSE y + dy END AS y0, x + dx AS x1, CASE WHEN strand = 0 THEN y + dy ELSE y END AS y1 FROM seg WHERE x < 3000 + 50000 AND x + dx > 3000 - 50000 AND y < 400000 + 50000 AND y + dy > 400000 - 50000),
t AS (SELECT *, least(1.0, greatest(0.0, -((x0 - 3000.0) * (x1 - x0) + (y0 - 400000.0) * (y1 - y0)) / CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE))) AS t FROM e)
SELECT x, y, strand, round(sqrt(pow(x0 - 3000.0 + t * (x1 - x0), 2) + pow(y0 - 400000.0 + t * (y1 - y0), 2)), 6) AS distance FROM t WHERE sqrt(pow(x0 - 3000.0 + t * (x1 - x0), 2) + pow(y0 - 400000.0 + t * (y1 - y0), 2)) < 50000 ORDER BY distance, x, y, strand LIMIT 1""")
def nearest_segment(spark, sf_dir):
    """A report of one row."""
    return raster.nearest(segments(spark, sf_dir), 3000.0, 400_000.0, 50_000.0).select("x", "y", "strand", F.round("distance", 6).alias("distance"))


@query(f"""WITH {SEG}, q AS (SELECT CAST(sum(len) AS DOUBLE) AS total FROM doc), near AS (SELECT *, least(1.0, greatest(0.0, (1000.0 - x) / dx)) AS t0, least(1.0, greatest(0.0, (3000.0 - x) / dx)) AS t1 FROM seg WHERE dx >= 20 AND x + dx >= 1000 AND x <= 3000),
iv AS (SELECT y + (CASE WHEN strand = 1 THEN 1 - t0 ELSE t0 END) * dy AS qa, y + (CASE WHEN strand = 1 THEN 1 - t1 ELSE t1 END) * dy AS qb, (t1 - t0) * dx AS w FROM near),
i2 AS (SELECT least(qa, qb) AS a, greatest(qa, qb) AS b, w FROM iv),
m AS (SELECT *, CASE WHEN a - max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= greatest(6000, least(2e6, (SELECT total FROM q) * 0.05)) THEN 0 ELSE 1 END AS fresh FROM i2),
g AS (SELECT *, sum(fresh) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM m), c AS (SELECT min(a) AS a, max(b) AS b, sum(w) AS w FROM g GROUP BY g)
SELECT round(a, 6) AS a, round(b, 6) AS b, round(w, 6) AS w, CAST(row_number() OVER (ORDER BY w DESC, a) AS INTEGER) AS place FROM c""")
def jump_clusters(spark, sf_dir):
    """Where a part of the target axis maps on the documents."""
    found = intervals.jump(segments(spark, sf_dir), 1000, 3000, kmers.total_length(document_axis(spark, sf_dir)))
    return found.select(*[F.round(c, 6).alias(c) for c in "abw"], "place")


# ---------------------------------------------------------------- scalar functions
@query("""WITH t AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || '.5' || CASE p_partkey % 6 WHEN 0 THEN ' kb' WHEN 1 THEN 'M' WHEN 2 THEN '' WHEN 3 THEN 'Gb' WHEN 4 THEN ' bp' ELSE 'x' END AS value FROM part),
p AS (SELECT *, regexp_replace(lower(trim(value)), '[, ]', '', 'g') AS bare FROM t)
SELECT p_partkey, value, CASE WHEN regexp_matches(bare, '^([0-9]*\\.?[0-9]+)(bp|k|kb|m|mb|g|gb)?$') THEN CAST(regexp_extract(bare, '^([0-9]*\\.?[0-9]+)', 1) AS DOUBLE) * CASE substr(regexp_extract(bare, '^([0-9]*\\.?[0-9]+)(bp|k|kb|m|mb|g|gb)?$', 2), 1, 1) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'g' THEN 1e9 ELSE 1 END END AS bp FROM p""")
def parse_bp(spark, sf_dir):
    """F1."""
    k = F.col("p_partkey") % 6
    unit = F.when(k == 0, " kb").when(k == 1, "M").when(k == 2, "").when(k == 3, "Gb").when(k == 4, " bp").otherwise("x")
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit).alias("value")).withColumn("bp", grammar.parse_bp_column(F.col("value")))


@query("""WITH t AS (SELECT o_orderkey, floor(o_totalprice) * (o_orderkey % 1000) + 0.3 AS v FROM orders), u AS (SELECT o_orderkey, v, CASE WHEN v >= 999.5e6 THEN v / 1e9 WHEN v >= 999.5e3 THEN v / 1e6 WHEN v >= 999.5 THEN v / 1e3 END AS x, CASE WHEN v >= 999.5e6 THEN ' Gb' WHEN v >= 999.5e3 THEN ' Mb' WHEN v >= 999.5 THEN ' kb' END AS unit FROM t),
s AS (SELECT *, CASE WHEN x < 10 THEN printf('%.2f', x) WHEN x < 100 THEN printf('%.1f', x) ELSE printf('%.0f', x) END AS text FROM u)
SELECT o_orderkey, CASE WHEN x IS NULL THEN CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) || ' bp' ELSE CASE WHEN contains(text, '.') THEN regexp_replace(text, '\\.?0+$', '') ELSE text END || unit END AS label FROM s""")
def format_bp(spark, sf_dir):
    """F5."""
    return read(spark, sf_dir, "orders").select("o_orderkey", formatting.format_bp_column(F.floor("o_totalprice").cast("double") * (F.col("o_orderkey") % 1000) + 0.3).alias("label"))


CELLS_X, CELLS_Y = 3000, 9000


@query(f"""WITH {SEG}, size AS (SELECT (SELECT sum(len) FROM item)::DOUBLE / {CELLS_X} AS w, (SELECT sum(len) FROM doc)::DOUBLE / {CELLS_Y} AS h),
e AS (SELECT x / w AS x0, (CASE WHEN strand = 0 THEN y ELSE y + dy END) / h AS y0, (x + dx) / w AS x1, (CASE WHEN strand = 0 THEN y + dy ELSE y END) / h AS y1 FROM seg, size),
meets AS (SELECT *, CASE WHEN x0 <> x1 THEN list_transform(range(CAST(ceil(least(x0, x1)) AS BIGINT), CAST(floor(greatest(x0, x1)) AS BIGINT) + 1), lambda g: (CAST(g AS DOUBLE) - x0) / (x1 - x0)) ELSE [] END AS mx,
  CASE WHEN y0 <> y1 THEN list_transform(range(CAST(ceil(least(y0, y1)) AS BIGINT), CAST(floor(greatest(y0, y1)) AS BIGINT) + 1), lambda g: (CAST(g AS DOUBLE) - y0) / (y1 - y0)) ELSE [] END AS my FROM e),
cuts AS (SELECT *, list_sort(list_distinct(list_concat([0.0::DOUBLE, 1.0::DOUBLE], list_filter(list_concat(mx, my), lambda t: t > 0 AND t < 1)))) AS c FROM meets),
cells AS (SELECT x0, y0, x1, y1, CAST(floor(x0 + (x1 - x0) * ((c[i] + c[i + 1]) / 2)) AS BIGINT) AS cx, CAST(floor(y0 + (y1 - y0) * ((c[i] + c[i + 1]) / 2)) AS BIGINT) AS cy, row_number() OVER () AS r FROM cuts, UNNEST(range(1, len(c))) u(i))
SELECT cx, cy, count(*) AS n FROM cells GROUP BY cx, cy""")
def segment_cells(spark, sf_dir):
    """Cells of a fine grid that segments cross, each once for each segment."""
    w, h = kmers.total_length(benchmark_axis(spark, sf_dir)) / CELLS_X, kmers.total_length(document_axis(spark, sf_dir)) / CELLS_Y
    found = raster.endpoints(segments(spark, sf_dir))
    return raster.grid_cells(found, w, h, []).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


NEAR = 40_000


@query(f"""WITH {ITEM}, {DOC}, {sql_match(SMALL)}, size AS (SELECT (SELECT CAST(sum(len) AS BIGINT) FROM item) AS w, (SELECT CAST(sum(len) AS BIGINT) FROM doc) AS h),
points AS (SELECT event_id AS id, CAST((event_id * 7919) % w AS DOUBLE) AS px, CAST((event_id * 104729) % h AS DOUBLE) AS py FROM events, size),
e AS (SELECT x, y, strand, x AS x0, CASE WHEN strand = 0 THEN y ELSE y + dy END AS y0, x + dx AS x1, CASE WHEN strand = 0 THEN y + dy ELSE y END AS y1 FROM seg),
near AS (SELECT id, x, y, strand, x0, y0, x1, y1, px, py FROM points JOIN e ON y - {NEAR} < py AND greatest(y0, y1) + {NEAR} > py),
t AS (SELECT *, least(1.0, greatest(0.0, -((x0 - px) * (x1 - x0) + (y0 - py) * (y1 - y0)) / CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE))) AS t FROM near),
d AS (SELECT *, sqrt(pow((x0 - px) + t * (x1 - x0), 2) + pow((y0 - py) + t * (y1 - y0), 2)) AS distance FROM t)
SELECT id, x, y, strand, round(distance, 6) AS distance FROM d WHERE distance < {NEAR} QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, x, y, strand) = 1""")
def nearest_join(spark, sf_dir):
    """J12, J13 for many points: of each event's place the nearest segment."""
    target, documents = benchmark_axis(spark, sf_dir), document_axis(spark, sf_dir)
    w, h = kmers.total_length(target), kmers.total_length(documents)
    i = F.col("event_id")
    points = read(spark, sf_dir, "events").select(i.alias("id"), ((i * 7919) % w).cast("double").alias("px"), ((i * 104_729) % h).cast("double").alias("py"))
    found = raster.nearest_join(points, stored(match.match(target, documents, SMALL).select("x", "y", "dx", "dy", "strand"), "segments"), NEAR)
    return found.select("id", "x", "y", "strand", F.round("distance", 6).alias("distance"))


VIEW, PIXELS = (0, 4000, 100_000, 900_000), (640, 480)


@query(f"""WITH {SEG}, e AS (SELECT *, CASE WHEN strand = 0 THEN y ELSE y + dy END AS y0, CASE WHEN strand = 0 THEN y + dy ELSE y END AS ye FROM seg WHERE identity + 1e-6 >= 0.5 AND dx + 0.5 >= 20 AND x < {VIEW[1]} AND x + dx > {VIEW[0]} AND y < {VIEW[3]} AND y + dy > {VIEW[2]})
SELECT x, y, strand, round((x - {VIEW[0]}) * ({PIXELS[0]} / {VIEW[1] - VIEW[0]}::DOUBLE), 2) AS x1, round(({VIEW[3]}::DOUBLE - y0) * ({PIXELS[1]} / {VIEW[3] - VIEW[2]}::DOUBLE), 2) AS y1, round((x + dx - {VIEW[0]}) * ({PIXELS[0]} / {VIEW[1] - VIEW[0]}::DOUBLE), 2) AS x2, round(({VIEW[3]}::DOUBLE - ye) * ({PIXELS[1]} / {VIEW[3] - VIEW[2]}::DOUBLE), 2) AS y2,
  CAST(floor(least(1.0, greatest(0.0, (identity - 0.5) / 0.5)) * 255 + 0.5) AS INTEGER) AS tone FROM e""")
def svg_segments(spark, sf_dir):
    """K1: lines of a picture of the visible segments in a view."""
    found = segments(spark, sf_dir).filter(raster.visible(0.5, 20))
    return svg.svg_lines(found, tuple(map(float, VIEW)), *PIXELS, identity_low=0.5)
