"""The sequence engine against plain versions of its operators and worked cases."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions import sequence as S
from kmerloom.model import EngineError, MatchOptions
from kmerloom.operators import belongs, contain, gather, intervals, kmers, match, profile, raster, summary
from kmerloom.plans import density
from kmerloom.plans.compare import compare


def bases(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def axis(spark, *seqs):
    rows, at = [], 0
    for i, s in enumerate(seqs):
        rows.append((i, f"r{i}", at, len(s), 0, s))
        at += len(s)
    return spark.createDataFrame(rows, "rec long, name string, start long, len long, offset long, seq string")


def windows(seqs, k):
    at = 0
    for i, s in enumerate(seqs):
        for j in range(len(s) - k + 1):
            if "N" not in s[j : j + k]:
                yield i, at + j, s[j : j + k]
        at += len(s)


def match_by_hand(target, query, o):
    k, total = o.k, sum(map(len, query))
    index = defaultdict(list)
    for r, p, km in windows(target, k):
        if p % o.stride == 0:
            index[km].append((r, p))
    diagonals = defaultdict(list)
    for r, y, km in windows(query, k):
        for strand, p, word in ((0, y, km), (1, total - y - k, rc(km))):
            hits = index.get(word, [])
            if p % o.q_sample == 0 and (o.cap is None or len(hits) <= o.cap):
                for tr, t in hits:
                    diagonals[strand, r, tr, p - t].append((p, t))
    out = Counter()
    for (strand, r, tr, _), pts in diagonals.items():
        pts.sort()
        runs = [[pts[0]]]
        for a, b in zip(pts, pts[1:]):
            if b[0] - a[0] - 1 <= o.max_gap + o.hole:
                runs[-1].append(b)
            else:
                runs.append([b])
        for run in runs:
            n = run[-1][0] - run[0][0] + k
            gap = sum(max(0, b[0] - a[0] - 1 - o.hole) for a, b in zip(run, run[1:]))
            if n >= o.least_run:
                y = run[0][0] if strand == 0 else total - run[-1][0] - k
                out[min(t for _, t in run), y, n, strand, r, tr, gap] += 1
    return out


def found(df):
    return Counter((r.x, r.y, r.dx, r.strand, r.qrec, r.trec, r.gap_bases) for r in df.collect())


@pytest.mark.parametrize("o", [MatchOptions(6), MatchOptions(5, 7, 3), MatchOptions(6, 4, None, 9, 2, 3), MatchOptions(4, 0, 20, 6)])
def test_match(spark, o):
    t = [bases(150, 1) + "N" + bases(40, 2), bases(60, 3)]
    q = [t[0][30:90] + bases(20, 4) + rc(t[1][10:50]), "ACG", t[1][5:30] + "NN" + t[0][:25]]
    assert found(match.match(axis(spark, *t), axis(spark, *q), o)) == match_by_hand(t, q, o)


def test_worked_matches(spark):
    t = bases(500, 9)
    one = lambda q, o: match.match(axis(spark, t), axis(spark, q), o).filter("dx > 30").collect()
    (r,) = one(t[100:200], MatchOptions())
    assert (r.x, r.y, r.dx, r.strand, r.identity) == (100, 0, 100, 0, 1.0)
    (r,) = one(rc(t[100:200]), MatchOptions())
    assert (r.x, r.y, r.dx, r.strand) == (100, 0, 100, 1)
    q = t[100:150] + ("A" if t[150] != "A" else "C") + t[151:200]
    assert len(one(q, MatchOptions(max_gap=0))) == 2
    (r,) = one(q, MatchOptions(max_gap=16))
    assert math.isclose(r.identity, 0.85) and r.gap_bases == 15
    assert len([r for r in one(t[100:140] + "N" + t[141:200], MatchOptions()) if r.strand == 0]) == 2
    a, b = bases(150, 20), bases(180, 21)
    runs = match.match(axis(spark, a, b), axis(spark, a, b), MatchOptions(max_gap=256)).filter("strand = 0 AND dx > 50").collect()
    assert sorted(r.dx for r in runs) == [150, 180]
    unit = bases(20, 22)
    many, single = axis(spark, "".join(unit + bases(9, i) for i in range(60))), axis(spark, unit)
    assert match.match(many, single, MatchOptions(max_occ=20)).count() == 0 and match.match(many, single, MatchOptions(max_occ=100)).count() > 50
    s = bases(600, 23)
    windowed = match.match(axis(spark, s), axis(spark, s), MatchOptions(), t_window=(200, 400)).filter("strand = 0 AND dx > 50").collect()
    assert [(r.x, r.dx) for r in windowed] == [(200, 214)]
    inverted = s[:400] + rc(s[100:160]) + s[460:]
    got = {(r.x, r.y, r.dx) for r in match.match(axis(spark, inverted), axis(spark, inverted), MatchOptions(max_occ=1)).filter("strand = 1 AND dx >= 60").collect()}
    assert {(100, 400, 60), (400, 100, 60)} <= got


def test_windows_of_both_strands(spark):
    t, q = bases(80, 5), bases(90, 6)
    o = MatchOptions(4, 0, None)
    got = match.anchors(match.target_index(axis(spark, t), o), axis(spark, q), o, 90, (10, 50), (20, 60)).collect()
    want = Counter()
    for p in range(87):
        for strand, s, lo, hi in ((0, q, 20, 60), (1, rc(q), 30, 70)):
            if lo <= p < hi:
                for x in range(10, 50):
                    if s[p : p + 4] == t[x : x + 4]:
                        want[strand, p, x] += 1
    assert Counter((r.strand, r.p, r.t) for r in got) == want


@pytest.mark.parametrize("k", [4, 5, 11, 16, 17, 26])
def test_kmers(spark, k):
    seqs = [bases(70, 1), "", "ACG", bases(30, 2) + "N" + bases(40, 3)]
    a = axis(spark, *seqs)
    number = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    want = {(r, p, number(w), number(rc(w))) for r, p, w in windows(seqs, k)}
    assert {tuple(r) for r in kmers.kmers(a, k, both=True).collect()} == want
    assert {(r.rec, r.pos, r.kv, r.rc) for r in kmers.kmers_by_expressions(a, k).collect()} == want
    assert {tuple(r) for r in kmers.canonical_kmers(a, k).collect()} == {(r, p, min(x, y)) for r, p, x, y in want}
    assert {r.pos for r in kmers.kmers(a, k, stride=3).collect()} == {p for _, p, _, _ in want if p % 3 == 0}
    with pytest.raises(EngineError):
        kmers.kmers(a, 27)


def test_hash_and_sampling(spark):
    values = [0, 1, 4**15, 4**26 - 1, 123456789012]

    def by_hand(v):
        low, high = v % 2**26, v // 2**26
        h = (low * 0x9E3779B1 % 2**32) ^ (high * 0x85EBCA6B % 2**32)
        h ^= h >> 15
        h = h * 0x2B591E5B % 2**32
        return h ^ h >> 13

    want = [by_hand(v) for v in values]
    assert S.hash32_array(np.array(values)).tolist() == want
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(S.hash32(F.col("v"))).collect()] == want
    a = axis(spark, bases(4000, 8))
    n = kmers.canonical_kmers(a, 15, 8).select("kv").distinct().count()
    assert 350 < n < 650
    assert S.scaled_for(100, 24) == 8 and S.scaled_for(24, 24) == 1


def test_normalise(spark):
    df = spark.createDataFrame([("acgtuUNxR-",)], "s string")
    assert df.select(S.normalise(F.col("s"))).first()[0] == "ACGTTTNNNN"


# ------------------------------------------------------------------ repeats, densities
def test_saturation_splice_profile(spark):
    s = bases(2048, 1) + "AC" * 1024 + bases(2048, 2)
    index = kmers.kmers(axis(spark, s), 8)
    tiles = lambda width: kmers.tile_kmers(kmers.cut(axis(spark, s)), 8, width)
    assert [(r.start, r.end) for r in profile.saturated(tiles(512), len(s), 64).collect()] == [(2048, 4096)]
    old = spark.createDataFrame([(100, 200), (300, 500), (800, 900)], "start long, end long")
    new = spark.createDataFrame([(400, 450)], "start long, end long")
    assert sorted((r.start, r.end) for r in profile.splice(old, new, 150, 850).collect()) == [(100, 150), (400, 450), (850, 900)]
    occ = Counter(w for _, _, w in windows([s], 8))
    rows = {r.tile: r for r in profile.multiplicity(tiles(1000), len(s), 1000).collect()}
    assert sorted(rows) == list(range(7))
    for t, r in rows.items():
        own = [occ[w] for _, p, w in windows([s], 8) if p // 1000 == t]
        assert math.isclose(r.mult, 2 ** np.mean(np.log2(own)), rel_tol=1e-9) and math.isclose(r.uniq_frac, np.mean([o == 1 for o in own]), abs_tol=1e-9)
    spectrum = {r.cls: (r.occ_count, r.occ_sumsq) for r in profile.spectrum(index).collect()}
    want = Counter(min(o, 1024) for o in occ.values())
    assert {c: n for c, (n, _) in spectrum.items()} == want and sum(x for _, x in spectrum.values()) == sum(o * o for o in occ.values())


def test_density():
    sumsq = {c: 4e6 for c in range(1, 11)}
    assert density.pick_cutoff(sumsq, 1, 200, 30e6) == 7 and density.pick_cutoff(sumsq, 2, 200, 30e6) == 4
    assert density.pick_cutoff(sumsq, 1, None, 1e12) is None and density.pick_cutoff(sumsq, 1, 5000, 1e12) == 5000 and density.pick_cutoff({1: 1e12}, 1, 200, 1.0) == 4
    assert density.pick_density("off", 1, 51_300_000, 51_300_000) == (1, 1) and density.pick_density("auto", 1, 51_300_000, 51_300_000) == (2, 2) and density.pick_density(1, 1, 51_300_000, 51_300_000) == (2, 1)
    with pytest.raises(EngineError):
        density.pick_density("off", 1, 200_000_000, 1)
    with pytest.raises(EngineError):
        density.check_volume(2e9, 10, 10)
    assert density.check_volume(2e9, 10, 10, confirm=True)["anchors"] == 4e9
    assert density.grid_side({1: 10}) == 512 and density.grid_side({1: 10}, 2000) == 1024 and density.grid_side({1000: 10**9}) == 64


def test_compare_lowers_the_cutoff(spark):
    s = bases(300, 3) + bases(12, 4) * 60
    c = compare(axis(spark, s), axis(spark, s), MatchOptions(8, 0), budget=1e-6)
    assert c.options.max_occ == 4 and any("cutoff" in n for n in c.notes) and c.segments.count() > 0


# ------------------------------------------------------------------ containment
def test_containment_grid(spark):
    a, r = bases(1000, 1), random.Random(2)
    b = "".join(r.choice("ACGT") if r.random() < 0.05 else c for c in a)
    s = a + a + b + bases(1000, 3)
    own = kmers.spread(axis(spark, s))
    grid = {(x.tx, x.ty): x.identity for x in contain.containment_grid(own, None, (0, 4000), None, 4, 12).collect()}
    assert grid[0, 0] >= 0.999 and grid[0, 1] >= 0.98 and 0.9 < grid[0, 2] < 0.99 and grid.get((0, 3), 0) < 0.8
    counts = lambda t: Counter(w for _, p, w in windows([s], 12) if min(3, p * 4 // 4000) == t)
    for y in (None, own):
        rows = contain.containment_grid(own, y, (0, 4000), (0, 4000), 4, 12).collect()
        assert {(x.tx, x.ty): x.shared for x in rows} == {(i, j): n for i in range(4) for j in range(4) if (n := (counts(i) & counts(j)).total())}
    with pytest.raises(EngineError):
        contain.tile_counts(own, 0, 50, 4, 12)


def test_belongs(spark):
    e = bases(100, 1)
    seqs = [e, e, rc(e), e[:50] + bases(50, 2), e * 3, bases(60, 5), "ACGTACGTAC"]
    k = 15
    counts = [Counter(min(w, rc(w)) for _, _, w in windows([s], k)) for s in seqs]
    table = belongs.species_counts(kmers.canonical_kmers(axis(spark, *seqs), k))
    held = Counter(w for c in counts for w in c)
    pairs = {(r.i, r.j): r for r in belongs.belongs(table).collect()}
    for i in range(len(seqs)):
        for j in range(len(seqs)):
            both = counts[i] & counts[j]
            if i == j or not both:
                assert (i, j) not in pairs
                continue
            r = pairs[i, j]
            assert (r.shared, r.exclusive) == (both.total(), sum(n for w, n in both.items() if held[w] == 2))
            assert (r.unique, r.cross_mass) == (sum(counts[i][w] == 1 for w in both), sum(counts[i][w] for w in both))
    totals = belongs.masses(table)
    assert {r.rec: r.total for r in totals.collect()} == {i: c.total() for i, c in enumerate(counts) if c}
    m = {(r.i, r.j): r for r in belongs.with_metrics(belongs.belongs(table), totals, k).collect()}
    assert m[0, 1].containment == 1 and m[0, 1].copy_ratio is None and 2.5 < m[0, 4].copy_ratio < 3.5
    with pytest.raises(EngineError):
        belongs.check_records(axis(spark, e))


def test_multiset_shares(spark):
    table = belongs.species_counts(kmers.canonical_kmers(axis(spark, "ACG" * 40, "ACG" * 10), 6))
    assert {r.shared for r in belongs.belongs(table).collect()} == {25}
    masses = belongs.masses(belongs.species_counts(kmers.canonical_kmers(axis(spark, bases(100, 1), bases(40, 2) + "N" + bases(59, 3), "ACGTACGTAC"), 15)))
    assert {r.rec: r.total for r in masses.collect()} == {0: 86, 1: 26 + 45}


def cover_by_hand(own, tiles, share=0.001):
    """Rounds over plain dictionaries: own[kv], tiles[(rec, lo)][kv]."""
    left, room = dict(own), {t: dict(c) for t, c in tiles.items()}
    claimed, mass = Counter(), sum(own.values())
    while True:
        gain = {t: sum(min(left.get(w, 0), n) for w, n in c.items()) for t, c in room.items()}
        best = min(gain, key=lambda t: (-gain[t], t), default=None)
        if best is None or gain[best] < max(1, share * mass):
            return claimed, mass
        for w, n in room[best].items():
            take = min(left.get(w, 0), n)
            if take:
                left[w] -= take
                room[best][w] -= take
                claimed[best] += take


def test_gather(spark):
    x, y = bases(6000, 1), bases(6000, 2)
    seqs = [x[:2500] + y[3000:5500] + bases(300, 3), x, y, x[:2000] + x[:500]]
    a, k = axis(spark, *seqs), 15
    rows, width, slice_bp = gather.gather(kmers.canonical_kmers(a, k), a, 0)
    assert (width, slice_bp) == (1024, math.ceil(5300 / 96))
    own = Counter(min(w, rc(w)) for _, _, w in windows(seqs[:1], k))
    tiles = defaultdict(Counter)
    for i, s in enumerate(seqs[1:], 1):
        for _, p, w in windows([s], k):
            if min(w, rc(w)) in own:
                tiles[i, p // width * width][min(w, rc(w))] += 1
    claimed, mass = cover_by_hand(own, tiles)
    got = rows.collect()
    assert {(r.rec, r.place): r.mass for r in got if r.kind == "claim"} == dict(claimed)
    (total,) = [r for r in got if r.kind == "total"]
    assert total.mass == mass and not total.place
    assert math.isclose(sum(r.mass for r in got if r.kind == "paint"), sum(claimed.values()))
    parts = gather.components(rows, a, width).collect()
    assert math.isclose(sum(r.mass for r in parts), sum(claimed.values())) and all(r.lo % width == 0 and r.lo < r.hi <= len(seqs[r.rec]) for r in parts)
    table = gather.summary(gather.components(rows, a, width), total.mass, top=2).collect()
    assert math.isclose(sum(r.share for r in table), 1.0)


def test_rounds_of_any_batch(spark):
    """The cover is that of one round at a time, however many windows a pass takes and however few rows may describe them; ties go to the first window."""
    x, y, z = bases(4000, 4), bases(4000, 5), bases(900, 6)
    seqs = [x + y[:2000] + z * 2, x[1000:] + z, y + z, z + x[:2500], y[500:1500] * 2, x[1000:] + z]
    a, k = axis(spark, *seqs), 15
    table = kmers.canonical_kmers(a, k).cache()
    own, tiles = Counter(min(w, rc(w)) for _, _, w in windows(seqs[:1], k)), defaultdict(Counter)
    for i, s in enumerate(seqs[1:], 1):
        for _, p, w in windows([s], k):
            if min(w, rc(w)) in own:
                tiles[i, p // 256 * 256][min(w, rc(w))] += 1
    claimed, _ = cover_by_hand(own, tiles, 0.0)
    told = []
    for batch, most in ((1, 1), (3, 200_000), (64, 4), (64, 200_000)):
        rows, width, _ = gather.gather(table, a, 0, tile_bp=256, share=0.0, batch=batch, most=most)
        got = rows.collect()
        assert width == 256 and {(r.rec, r.place): r.mass for r in got if r.kind == "claim"} == dict(claimed)
        told.append(sorted((r.kind, r.rec, r.place, round(r.mass, 6), r.contested) for r in got))
    assert all(t == told[0] for t in told)
    (total,) = [r for r in gather.gather(table, a, 0, tile_bp=256, rounds=3)[0].collect() if r.kind == "total"]
    assert total.place == 1


def test_source_axis_of_any_names(spark, tmp_path):
    from kmerloom.queries import source_axis

    names = ["src2", "b", None, "src10", "x2", "a", "src2"]
    spark.createDataFrame([(i, "acgt" * (i + 1), n) for i, n in enumerate(names)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted((r.rec, r.name, r.start, r.len) for r in source_axis(spark, str(tmp_path))[0].collect())
    lengths = {"src2": 4 + 1 + 28, "x2": 20, "src10": 16, "a": 24, "b": 8, None: 12}
    assert out == [(i, n, sum(list(lengths.values())[:i]), k) for i, (n, k) in enumerate(lengths.items())]
    pieces = sorted((r.rec, r.start, r.len) for r in source_axis(spark, str(tmp_path))[1].collect())
    assert pieces == [(0, 0, 4), (0, 5, 28), (1, 33, 20), (2, 53, 16), (3, 69, 24), (4, 93, 8), (5, 101, 12)]


def test_gather_of_equal_sources(spark):
    x = bases(3000, 1)
    a = axis(spark, x, x, x)
    rows, width, _ = gather.gather(kmers.canonical_kmers(a, 15), a, 0)
    (part,) = gather.components(rows, a, width).collect()
    assert part.rec == 1 and part.mass == part.contested == 2986


# ------------------------------------------------------------------ intervals
def test_locate_and_overlap(spark):
    catalog = spark.createDataFrame([(0, "a", 0, 100, 5), (1, "b", 100, 100, 0), (2, "c", 100, 200_000, 7)], "rec long, name string, start long, end long, offset long")
    points = spark.createDataFrame([(x,) for x in (0, 99, 100, 150_000, 199_999, 200_000, -1)], "g long")
    got = {r.g: (r.rec, r.local, r.shown) for r in intervals.locate(points, catalog).collect()}
    assert got == {0: (0, 0, 5), 99: (0, 99, 104), 100: (2, 0, 7), 150_000: (2, 149_900, 149_907), 199_999: (2, 199_899, 199_906), 200_000: (None,) * 3, -1: (None,) * 3}
    rng = random.Random(1)
    left, right = ([(i, *sorted(rng.sample(range(5000), 2))) for i in range(60)] for _ in range(2))
    pairs = intervals.overlap_join(spark.createDataFrame(left, "i long, l0 long, l1 long"), spark.createDataFrame(right, "j long, r0 long, r1 long"), width=64).collect()
    assert Counter((r.i, r.j) for r in pairs) == Counter((i, j) for i, a, b in left for j, c, d in right if a < d and c < b)


def test_annotate(spark):
    visible = spark.createDataFrame([(0, "chr1p", 0, 200_000, 10_600_000)], "rec long, name string, start long, end long, offset long")
    item = ("chr1", 10_650_000, 10_700_000, "gene", "+", None)
    items = spark.createDataFrame([item, item, ("chr1", 0, 10, "far", "-", None), ("chr2", 10_650_000, 10_700_000, "other", "+", None)], "chrom string, start long, end long, name string, strand string, rgb string")
    lane = intervals.annotate(items, visible)
    assert [(r.w0, r.w1, r.item_name) for r in lane.collect()] == [(50_000, 100_000, "gene")]
    assert intervals.hit(lane, 60_000).first().item_name == "gene" and not intervals.hit(lane, 100_000).count()


def test_jump(spark):
    rows = [(0, 1000, 100, 100, 0), (150, 90_000, 100, 100, 1), (50, 1080, 100, 100, 0), (5000, 1, 100, 100, 0)]
    seg = spark.createDataFrame(rows, "x long, y long, dx long, dy long, strand int")
    got = [tuple(r) for r in intervals.jump(seg, 0, 200, 200_000).orderBy("place").collect()]
    assert got == [(1000.0, 1180.0, 200.0, 1), (90_050.0, 90_100.0, 50.0, 2)]


# ------------------------------------------------------------------ raster, summaries
def test_heatmap_and_nearest(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(1000), rng.randrange(1000), n := rng.randrange(1, 300), n, rng.randrange(2), rng.random()) for _ in range(80)]
    seg = spark.createDataFrame(rows, "x long, y long, dx long, dy long, strand int, identity double")
    x0, x1, y0, y1, nx, ny = 200, 800, 100, 900, 16, 20
    fx, fy, want = nx / (x1 - x0), ny / (y1 - y0), {}
    for x, y, dx, dy, s, v in rows:
        if x >= x1 or x + dx <= x0 or y >= y1 or y + dy <= y0:
            continue
        ax, ay, bx, by = (x - x0) * fx, ((y + dy if s else y) - y0) * fy, (x + dx - x0) * fx, ((y if s else y + dy) - y0) * fy
        lo, hi = 0.0, 1.0
        for a, d, n in ((ax, bx - ax, nx), (ay, by - ay, ny)):
            e, f = sorted((-a / d, (n - a) / d))
            lo, hi = max(lo, e), min(hi, f)
        if lo > hi:
            continue
        p, q, u, w = ax + (bx - ax) * lo, ay + (by - ay) * lo, ax + (bx - ax) * hi, ay + (by - ay) * hi
        steps = min(4096, int(max(abs(u - p), abs(w - q), 1))) + 1
        for t in range(steps):
            f = t / max(steps - 1, 1)
            c = math.floor(p + (u - p) * f), math.floor(q + (w - q) * f)
            if 0 <= c[0] < nx and 0 <= c[1] < ny:
                want[c] = max(want.get(c, 0), v)
    cells = raster.identity_heatmap(seg, (x0, x1, y0, y1), nx, ny)
    assert {(r.cx, r.cy): r.v for r in cells.collect()} == want
    values = sorted(want.values())
    r = raster.contrast(cells).first()
    assert (r.lo, r.hi) == (values[int(len(values) * 0.02)], values[-1])
    assert tuple(raster.contrast(cells.limit(0)).first()) == (0.0, 1.0)

    def far(x, y, dx, dy, s):
        a, b = (x, y + dy if s else y), (x + dx, y if s else y + dy)
        t = max(0, min(1, ((500 - a[0]) * dx + (500 - a[1]) * (b[1] - a[1])) / (dx * dx + dy * dy)))
        return math.hypot(a[0] + t * dx - 500, a[1] + t * (b[1] - a[1]) - 500)

    best = min(far(*r[:5]) for r in rows)
    assert math.isclose(raster.nearest(seg, 500, 500, 400).first().distance, best, rel_tol=1e-9)
    mask = raster.saturation_mask(spark.createDataFrame([(10, 25)], "start long, end long"), 0, 100, 10)
    assert sorted(r.cell for r in mask.collect()) == [1, 2]
    assert {(r.cx, r.cy) for r in raster.hatched(cells.limit(0).select("cx", "cy"), mask, 10, 4).collect()} == {(x, y) for x in (1, 2) for y in range(4) if (x + y) & 3 < 2}


def test_distributions(spark):
    assert summary.ladder(10, 5000) == [10, 20, 50, 100, 200, 500, 1000, 2000, 5000] and summary.ladder(30, 400) == [50, 100, 200, 500]
    rng = random.Random(6)
    rows = [(rng.randrange(15, 6000), rng.randrange(2), 1 - rng.random() / 5) for _ in range(300)]
    seg = spark.createDataFrame(rows, "dx long, strand int, identity double")
    edges = summary.ladder(min(r[0] for r in rows), max(r[0] for r in rows))
    assert {(r.edge, r.strand): r.n for r in summary.length_distribution(seg).collect()} == Counter((next(e for e in edges if n <= e), s) for n, s, _ in rows)
    lo, n = summary.identity_bins(min(r[2] for r in rows))
    assert {(r.bin, r.strand): r.n for r in summary.identity_distribution(seg).collect()} == Counter((min(n - 1, max(0, int((v - lo) / ((1 - lo) / n)))), s) for _, s, v in rows)
    assert summary.identity_distribution(seg.limit(0)).count() == 0 and summary.dense_length(seg) is None
    assert [summary.dense_length(seg, 0, n) for n in (10**9, 0)] == [summary.DENSE_LENGTHS[0], next((c for c in summary.DENSE_LENGTHS if not seg.filter(F.col("dx") >= c).count()), summary.DENSE_LENGTHS[-1])]


def test_stream_counts(spark, tmp_path):
    from kmerloom.streaming.counts import stream_counts

    seqs = [bases(80, 1), bases(90, 2)]
    for i, s in enumerate(seqs):
        axis(spark, s).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(axis(spark, "A").schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream_counts(stream, 7).writeStream.outputMode("complete").format("memory").queryName("kmer_stream").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = Counter(min(w, rc(w)) for s in seqs for _, _, w in windows([s], 7))
    assert spark.table("kmer_stream").agg(F.sum("n"), F.count("*")).first() == (want.total(), len(want))


# ------------------------------------------------------------------ long records and diagonals
@pytest.fixture
def short_pieces(monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 64)
    monkeypatch.setattr(kmers, "BATCH", 50)
    monkeypatch.setattr(match, "RANGE", 16)


def test_records_in_pieces(spark, short_pieces):
    """Records of many pieces have the k-mers that they have whole; each window is in one piece."""
    seqs = [bases(1000, 1), "", bases(63, 2), bases(64, 3), bases(65, 4), bases(200, 5) + "N" + bases(300, 6), bases(40, 7) * 8]
    for k in (4, 15, 26):
        own = kmers.spread(axis(spark, *seqs))
        assert own.agg(F.sum("len")).first()[0] == sum(map(len, seqs)) and own.agg(F.max(F.length("seq"))).first()[0] <= 64 + 25
        want = Counter((r, p, w) for r, p, w in windows(seqs, k))
        number = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
        assert Counter(tuple(r) for r in kmers.kmers(own, k).collect()) == Counter({(r, p, number(w)): n for (r, p, w), n in want.items()})
        canon = [Counter(number(min(w, rc(w))) for r, _, w in windows(seqs, k) if r == i) for i in range(len(seqs))]
        assert {(r.rec, r.kv): r.n for r in kmers.record_kmers(own, k).collect()} == {(i, w): n for i, c in enumerate(canon) for w, n in c.items()}
        assert {r.rec: r.species for r in kmers.distinct_kmers(own, k).collect()} == {i: len(c) for i, c in enumerate(canon) if c}
        assert {(r.tile, r.kv): r.n for r in kmers.tile_kmers(own, k, 100, 3).collect()} == Counter((p // 100, number(w)) for _, p, w in windows(seqs, k) if p % 3 == 0)


def test_runs_over_many_ranges(spark, short_pieces):
    """A diagonal in ranges: runs that go on over several of them, gaps at their ends, and runs inside one."""
    r = random.Random(11)
    t = bases(700, 8)
    q = "".join(r.choice("ACGT") if r.random() < 0.03 else c for c in t)
    for o in (MatchOptions(8, 12, None), MatchOptions(8, 0, None), MatchOptions(10, 30, 5), MatchOptions(9, 20, None, 0, 2, 3)):
        assert found(match.match(axis(spark, t), axis(spark, q), o)) == match_by_hand([t], [q], o)
        assert found(match.match(axis(spark, t), axis(spark, t), o)) == match_by_hand([t], [t], o)


def test_groups_of_intervals(spark):
    """Unions and clusters in ranges, with intervals that reach over many of them, against one pass in order."""
    from kmerloom.plans.ordering import with_group

    rng = random.Random(5)
    rows = [(k, a, a + rng.choice([1, 5, 30, 700]), 1.0) for k in range(3) for a in rng.sample(range(6000), 120)]
    df = spark.createDataFrame(rows, "k long, a long, b long, w double")
    for gap in (0, 7):
        got = Counter(tuple(x) for x in with_group(df, "a", "b", gap, ("k",), "g", 50).groupBy("k", "g").agg(F.max("b").alias("b"), F.sum("w").alias("n")).collect())
        want = Counter()
        for k in range(3):
            groups = []
            for _, a, b, _ in sorted(x for x in rows if x[0] == k):
                if groups and a - groups[-1][1] <= gap:
                    groups[-1][1:] = max(groups[-1][1], b), groups[-1][2] + 1
                else:
                    groups.append([a, b, 1.0])
            want.update((k, *g) for g in groups)
        assert got == want


def test_concatenated_axes(spark):
    a, b = axis(spark, "ACGT", "GG"), axis(spark, "TTT", "C")
    both = [tuple(r) for r in kmers.concatenate(a, b).select("rec", "start", "len", "seq").orderBy("rec").collect()]
    assert both == [(0, 0, 4, "ACGT"), (1, 4, 2, "GG"), (2, 6, 3, "TTT"), (3, 9, 1, "C")]


def test_compare_guards_and_notes(spark):
    from kmerloom.plans.compare import run_notes

    s = bases(200, 9) + "AC" * 600
    a = axis(spark, s)
    copies = axis(spark, bases(12, 4) * 30)
    with pytest.raises(EngineError) as e:
        compare(copies, copies, MatchOptions(8, 0, max_segments=3))
    assert e.value.remedies["max_segments"] == 6
    warnings = spark.createDataFrame([("empty", "x"), ("empty", "y")], "kind string, name string")
    c = compare(a, a, MatchOptions(8, 0, max_occ=4), warnings=warnings)
    assert c.notes[0] == "2 records: empty" and any(n.endswith("which were not searched") for n in c.notes)
    assert found(c.segments) == match_by_hand([s], [s], MatchOptions(8, 0, max_occ=4))
    c.close()
    assert run_notes(MatchOptions(15, 0, max_occ=5), 2, 1, 2, 100, 0)[1].startswith("the occurrence cap 5 counts as 4")


def test_multiplicity_texture(spark):
    mult = [0.0, 1.0, 10.0, 0.0, 100.0, 1000.0, 3.0]
    df = spark.createDataFrame([(t, m, 0.0) for t, m in enumerate(mult)], "tile long, mult double, uniq_frac double")
    for width in (3, 4, 7, 100):
        w = min(width, 7)
        want = []
        for x in range(w):
            own = [m for m in mult[x * 7 // w : max(x * 7 // w + 1, (x + 1) * 7 // w)] if m > 0]
            want.append(math.floor(min(1, max(0, np.mean(np.log10(own))) / 2.5) * 255 + 0.5) if own else 0)
        assert [r.value for r in profile.multiplicity_texture(df, 7, width).orderBy("texel").collect()] == want


def test_grid_side_of_an_axis(spark):
    own = kmers.spread(axis(spark, bases(500, 1)))
    assert contain.side_of(own, 12) == 512 and contain.side_of(own, 12, 80) == 80 and contain.side_of(own, 12, 5000) == 1024


def test_records_and_explanations(spark):
    from kmerloom.plans.records import compare_records, explain_record

    x, y = bases(6000, 1), bases(6000, 2)
    a = axis(spark, x[:2500] + y[3000:5500] + bases(300, 3), x, y)
    rows = {(r.i, r.j): r for r in compare_records(a).collect()}
    assert rows[1, 0].containment > 0.4 and (1, 2) not in rows
    with pytest.raises(EngineError):
        compare_records(axis(spark, x))
    with pytest.raises(EngineError):
        compare_records(a, most=2)
    e = explain_record(a, 0)
    assert not e.truncated and {r.rec for r in e.components.collect()} == {1, 2} and math.isclose(sum(r.share for r in e.report.collect()), 1.0)
    strip = {r.slice: (r.rec, r.explained) for r in e.strip.collect()}
    assert strip[1] == (1, 1.0) and strip[80][0] == 2 and max(strip) < 94


def test_packed_kmers(spark, monkeypatch):
    """A row holds a bucket's k-mers of many bases: what is shuffled are few rows, and copies by group come out as counted."""
    from kmerloom.operators import packed

    monkeypatch.setattr(packed, "LEAST", 2)
    seqs = [bases(3000, 7), bases(2000, 8) + "N" + "A" * 400, "ACG"]
    pieces, lay = kmers.spread(axis(spark, *seqs), 2), packed.layout(9, 5000, 1)
    rows = packed.packed(pieces, [], lambda batch, row, place: np.where(place < 4900, place // 100, -1), lay)
    assert rows.count() <= 2 * 4

    def told(batches):
        for kv, g, n in packed.buckets(batches, lay):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kv, g, n)], names=["kv", "g", "n"])

    got = Counter({(r.kv, r.g): r.n for r in packed.dealt(rows).mapInArrow(told, "kv long, g long, n long").collect()})
    code = lambda w: int("".join("0123"["ACGT".index(c)] for c in w), 4)
    assert got == Counter((code(w) * int(packed.ODD) % 4**9, p // 100) for _, p, w in windows(seqs, 9) if p < 4900)


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_gather_of_pieces_and_tables(spark, monkeypatch, at_once):
    """A cover of pieces, with what slices hold, is that of a table of k-mers."""
    from kmerloom.operators import packed

    monkeypatch.setattr(packed, "ROWS", at_once)
    x, y = bases(3000, 11), bases(2500, 12)
    a = axis(spark, x + y[:900] + "A" * 50, y + x[200:1700], x[1500:] + "A" * 90, y[300:] * 2)
    of = lambda rows: sorted((r.kind, r.rec, r.place, round(r.mass, 6), r.contested) for r in rows[0].collect())
    told = of(gather.gather(kmers.spread(a), a, 0, tile_bp=256, share=0.0, k=15))
    assert told == of(gather.gather(kmers.canonical_kmers(a, 15), a, 0, tile_bp=256, share=0.0))
    own = Counter(p // math.ceil(3950 / 96) for _, p, _ in windows([x + y[:900] + "A" * 50], 15))
    assert {(place, mass) for kind, _, place, mass, _ in told if kind == "slice"} == set(own.items())


@pytest.mark.parametrize("alone", [1 << 60, 0])
def test_rounds_in_passes_and_together(spark, monkeypatch, alone):
    """The cover is that of one round at a time over so many windows that twice their number is no byte, whether passes or tasks that run together take the rounds; few passes do."""
    monkeypatch.setattr(gather, "ALONE", alone)
    monkeypatch.setattr(gather, "AGAIN", 4)
    x, y = bases(9000, 21), bases(40_000, 22)
    seqs = [x + y + x[:700], bases(200, 23) + x[:2000] + y[:18_000], y[18_000:] + x[3000:7500], x[5000:] + y[:9000]]
    a, k = axis(spark, *seqs), 15
    own, tiles, passes = Counter(min(w, rc(w)) for _, _, w in windows(seqs[:1], k)), defaultdict(Counter), []
    for i, s in enumerate(seqs[1:], 1):
        for _, p, w in windows([s], k):
            if min(w, rc(w)) in own:
                tiles[i, p // 256 * 256][min(w, rc(w))] += 1
    claimed, _ = cover_by_hand(own, tiles, 0.0)
    trial = gather._trial
    monkeypatch.setattr(gather, "_trial", lambda *of: passes.append(of) or trial(*of))
    rounds = 24 if alone else 12
    got = [(r.rec, r.place, r.mass) for r in gather.gather(kmers.spread(a), a, 0, tile_bp=256, share=0.0, rounds=rounds, k=k)[0].filter("kind = 'claim'").collect()]
    assert len(tiles) > 128 and len(got) == rounds and all(claimed[r, p] == m for r, p, m in got)
    assert len(passes) == 1 if not alone else len(passes) < rounds
