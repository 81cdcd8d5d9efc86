"""Pairs of groups, cells, nearest segments, kept indexes and pruned enumerations, against plain versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.sequence import scaled_for
from kmerloom.model import SEGMENT, EngineError, MatchOptions
from kmerloom.operators import belongs, contain, kmers, match, pairs, raster
from kmerloom.plans import density, index_store, records
from kmerloom.plans.compare import compare
from kmerloom.plans.tables import release, scratch, shared_folder, stored


def axis_of(spark, seqs):
    return kmers.as_axis(spark.createDataFrame([(i, f"r{i}", s) for i, s in enumerate(seqs)], "i long, n string, s string"), "i", "n", "s")


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


# ------------------------------------------------------------------ pairs
@pytest.mark.parametrize("first", [None, 4])
@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_pair_sums(spark, monkeypatch, first, chunk):
    rng = random.Random(chunk)
    rows = [(rng.randrange(9) if rng.random() < 0.3 else rng.randrange(200), rng.randrange(9), rng.randrange(1, 4)) for _ in range(900)] + [(3, g % 9, 1) for g in range(400)]
    copies = defaultdict(lambda: defaultdict(int))
    for kv, g, n in rows:
        copies[kv][g] += n
    want = defaultdict(lambda: dict.fromkeys(pairs.SUMS, 0))
    for own in copies.values():
        for i, a in own.items():
            want[i, i]["total"] += a
            want[i, i]["unique"] += a == 1
            for j, b in own.items():
                if i < j and (first is None or i < first <= j):
                    want[i, j]["shared"] += min(a, b)
                    want[i, j]["exclusive"] += min(a, b) if len(own) == 2 else 0
                    for x, y, n in ((i, j, a), (j, i, b)):
                        want[x, y]["unique"] += n == 1
                        want[x, y]["cross_mass"] += n
    want = {k: v for k, v in want.items() if any(v.values())}
    # The chunk is read where tasks run, so it goes with the function.
    run = pairs._pairs(9, first, pairs.SUMS)
    monkeypatch.setitem(run.__globals__, "CHUNK", chunk)
    table = sorted(rows, key=lambda r: r[:2])
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({c: [r[i] for r in table[at : at + 50]] for i, c in enumerate(("kv", "g", "n"))}) for at in range(0, len(table), 50)]
    local = {(r["i"], r["j"]): {s: r[s] for s in pairs.SUMS} for b in run(iter(batches)) for r in b.to_pylist()}
    assert local == want
    got = pairs.pair_sums(spark.createDataFrame(rows, "kv long, g int, n long").repartition(5), 9, first).collect()
    assert {(r.i, r.j): {s: r[s] for s in pairs.SUMS} for r in got} == want
    with pytest.raises(EngineError):
        pairs.pair_sums(spark.createDataFrame(rows, "kv long, g int, n long"), 4000)


def test_records_by_table_and_by_join(spark, monkeypatch):
    rng = random.Random(5)
    core = bases(rng, 400)
    seqs = [core + bases(rng, 100), core[:200] * 2, bases(rng, 300) + core[100:300], bases(rng, 200), "ACGTNN", ""]
    axis = axis_of(spark, seqs)
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    by_table = [key(x) for x in belongs.between(kmers.spread(axis), 11)]
    monkeypatch.setattr(pairs, "CELLS", 1)
    by_join = [key(x) for x in belongs.between(kmers.spread(axis), 11)]
    assert by_table == by_join and by_table[0]


def test_records_above_the_cap_can_be_exact(spark, monkeypatch):
    rng = random.Random(6)
    a = bases(rng, 3000)
    axis = axis_of(spark, [a, a[:1500] + bases(rng, 1500), bases(rng, 1000)])
    exact = sorted(map(tuple, records.compare_records(axis).collect()))
    monkeypatch.setattr(records, "SKETCH_CAP", 1000)
    assert records.sampling(axis, None) == scaled_for(7000, 1000) == 8 and records.sampling(axis, 1) == 1
    assert sorted(map(tuple, records.compare_records(axis, scaled=1).collect())) == exact != sorted(map(tuple, records.compare_records(axis).collect()))
    whole = records.explain_record(axis, 0, scaled=1)
    assert not whole.truncated and whole.components.count() > 0
    with pytest.raises(EngineError):
        records.compare_records(axis, scaled=0)


def test_density_of_long_targets():
    assert density.pick_density("exact", 1, 5_000_000_000, 10) == (1, 1) and density.pick_density("auto", 1, 480_000_000, 10) == (10, 1)
    with pytest.raises(EngineError) as e:
        density.pick_density("off", 1, 5_000_000_000, 10)
    assert e.value.remedies == {"sample": "exact"}


def test_grids_of_one_and_of_two_axes_agree(spark):
    rng = random.Random(7)
    axis = axis_of(spark, [bases(rng, 700), "AC" * 300, bases(rng, 500)])
    pieces, total = kmers.spread(axis), kmers.total_length(axis)
    one = sorted(map(tuple, contain.containment_grid(pieces, None, (0, total), None, 20, 9).collect()))
    two = sorted(map(tuple, contain.containment_grid(pieces, pieces, (0, total), (0, total), 20, 9).collect()))
    assert one == two and len(one) > 20


# ------------------------------------------------------------------ runs, windows, indexes
def test_runs_over_range_borders(spark, monkeypatch):
    """Ranges of a few starts: runs that go on over many of them, gaps as wide as ranges."""
    rng = random.Random(8)
    for gap, hole_by in ((3, 1), (2, 3)):
        options = MatchOptions(k=4, max_gap=gap, q_sample=hole_by, min_run=0)
        found = spark.createDataFrame([(0, 0, 0, p, p - d) for d in (0, 50) for p in sorted(rng.sample(range(0, 300, hole_by), 60))], "strand int, qrec long, trec long, p long, t long")
        monkeypatch.setattr(match, "RANGE", 1 << 20)
        want = sorted(map(tuple, match.merge_runs(found, options, 400).collect()))
        for width in (5, 64):
            monkeypatch.setattr(match, "RANGE", width)
            assert sorted(map(tuple, match.merge_runs(found, options, 400).collect())) == want, (gap, width)


def test_a_window_enumerates_what_it_touches(spark):
    rng = random.Random(9)
    axis = axis_of(spark, [bases(rng, rng.randrange(0, 300)) for _ in range(60)])
    total = kmers.total_length(axis)
    every = {(r.rec, r.pos, r.kv) for r in kmers.kmers(kmers.spread(axis), 9).collect()}
    for lo, hi in ((1000, 1600), (-50, 10), (total - 5, total + 50), (total, total + 9)):
        pieces = kmers.spread(axis, window=(lo, hi))
        assert {(r.rec, r.pos, r.kv) for r in kmers.kmers(pieces, 9).collect()} == {x for x in every if lo <= x[1] < hi}
        touched = axis.filter((F.col("start") < hi) & (F.col("start") + F.col("len") > lo)).count()
        assert pieces.count() == touched and (pieces.agg(F.sum("len")).first()[0] or 0) == max(0, min(hi, total) - max(lo, 0))


def test_long_records_in_a_window(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 100)
    rng = random.Random(10)
    axis = axis_of(spark, [bases(rng, 1000), bases(rng, 250)])
    every = {(r.rec, r.pos, r.kv) for r in kmers.kmers(axis, 9).collect()}
    pieces = kmers.spread(axis, window=(333, 1111))
    assert pieces.count() == 9 and {(r.rec, r.pos, r.kv) for r in kmers.kmers(pieces, 9).collect()} == {x for x in every if 333 <= x[1] < 1111}


def test_windows_of_a_match(spark):
    rng = random.Random(11)
    t = bases(rng, 900)
    target, query = axis_of(spark, [t[:500], t[500:]]), axis_of(spark, [bases(rng, 100) + t[200:420], t[600:800][::-1].translate(str.maketrans("ACGT", "TGCA"))])
    o, q_total = MatchOptions(k=9), kmers.total_length(query)
    for t_window, q_window in (((150, 700), (120, 400)), ((0, 900), (330, 331))):
        all_ = match.anchors(match.target_index(target, o), query, o, q_total, t_window, q_window)
        want = sorted(map(tuple, match.merge_runs(all_, o, q_total).collect()))
        assert sorted(map(tuple, match.match(target, query, o, t_window, q_window).collect())) == want


@pytest.mark.parametrize("piece, chunk", [(1 << 21, 1 << 21), (90, 1 << 21), (1 << 21, 40), (70, 7)])
def test_runs_where_pieces_are_enumerated(spark, monkeypatch, piece, chunk):
    """Runs put together in the tasks are those of joined anchors, wherever records and anchors are cut, and no anchor is shuffled: what is stored are the runs."""
    from kmerloom.operators import runs

    rng = random.Random(31)
    t = bases(rng, 700)
    flip = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    mutated = "".join(c if rng.random() > 0.04 else rng.choice("ACGTN") for c in t)
    target, query = axis_of(spark, [t[:400], t[400:], "AC" * 60]), axis_of(spark, [mutated, flip(mutated)[50:500], "", "CA" * 40, t[300:500] * 2])
    q_total = kmers.total_length(query)
    for o in (MatchOptions(k=7, max_gap=9, max_occ=5, min_run=12), MatchOptions(k=6, max_gap=20, max_occ=None, q_sample=3, stride=2), MatchOptions(k=6)):
        for t_window, q_window in ((None, None), ((100, 600), (130, 1400))):
            want = sorted(map(tuple, match.merge_runs(match.anchors(match.target_index(target, o), query, o, q_total, t_window, q_window), o, q_total).collect()))
            monkeypatch.setattr(kmers, "PIECE", piece)
            pieces = kmers.spread(query, window=(q_window[0] - o.k + 1, q_window[1]) if q_window else None)
            index = match.target_index(target, o)
            index = match.occurrence_cap(index.filter(F.col("t").between(t_window[0], t_window[1] - 1)) if t_window else index, o.cap)
            found = list(_run_here(index, pieces, o, q_total, q_window, chunk))
            got = sorted(map(tuple, match._joined(spark.createDataFrame(found, runs.RUN), F.col("border"), o, q_total).collect()))
            assert got == want and len(want) > 3
            if piece == chunk:
                assert not any(r[-1] for r in found) and sorted(map(tuple, match.match(target, query, o, t_window, q_window).collect())) == want
            monkeypatch.undo()


def _run_here(index, pieces, o, q_total, q_window, chunk):
    """piece_runs in this process, where the size of a chunk can be set."""
    from types import SimpleNamespace

    from kmerloom.operators import runs

    rows = index.select("kv", "t", "trec").toArrow()
    held = runs.Index(*[rows.column(c).to_numpy() for c in ("kv", "t", "trec")])
    before, runs.CHUNK = runs.CHUNK, chunk
    try:
        for batch in runs._runs(SimpleNamespace(value=held), o, q_total, q_window)(iter(pieces.select("rec", "start", "len", "parts", "seq").toArrow().combine_chunks().to_batches())):
            yield from (tuple(r.values()) for r in batch.to_pylist())
    finally:
        runs.CHUNK = before


def test_kept_index(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    seqs = [bases(rng, 400), bases(rng, 300)]
    folder, o = str(tmp_path), MatchOptions(k=9)
    first = index_store.kept_index(axis_of(spark, seqs), o, folder, 3)
    rows = sorted(map(tuple, first.collect()))
    assert rows == sorted((r.trec, r.t, r.kv) for r in match.target_index(axis_of(spark, seqs), o).collect())
    spark.catalog.dropTempView("none")
    spark.sql(f"DROP TABLE {[t.name for t in spark.catalog.listTables() if t.name.startswith('kmerloom_index')][0]}")
    made = []
    monkeypatch.setattr(index_store, "target_index", lambda *a: made.append(a))
    again = index_store.kept_index(axis_of(spark, seqs), o, folder)
    assert not made and sorted(map(tuple, again.collect())) == rows
    # No exchange between the index and a count or a join by k-mer.
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = again.groupBy("kv").count()._jdf.queryExecution().executedPlan().toString()
        joined = again.join(spark.range(99).withColumnRenamed("id", "kv"), "kv")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Exchange" not in plan and joined.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    monkeypatch.undo()
    for other, options in (([seqs[0][:-1] + ("A" if seqs[0][-1] != "A" else "C"), seqs[1]], o), (seqs[::-1], o), (seqs, MatchOptions(k=10)), (seqs, MatchOptions(k=9, stride=2))):
        assert index_store.fingerprint(axis_of(spark, other), options) != index_store.fingerprint(axis_of(spark, seqs), o)
    query = axis_of(spark, [seqs[0][100:300]])
    plain, kept, later = (compare(axis_of(spark, seqs), query, o, keep=k) for k in (None, folder, folder))
    found = [sorted(map(tuple, c.segments.collect())) for c in (plain, kept, later)]
    assert found[0] == found[1] == found[2] and found[0]
    for c in (plain, kept, later):
        c.close()


# ------------------------------------------------------------------ cells and nearest segments
def cells_by_force(x0, y0, x1, y1):
    """Cells whose inside a line passes, from many points between its crossings."""
    ts = {0.0, 1.0}
    for a, b in ((x0, x1), (y0, y1)):
        if a != b:
            ts |= {(g - a) / (b - a) for g in range(math.ceil(min(a, b)), math.floor(max(a, b)) + 1)}
    ts = sorted(t for t in ts if 0 <= t <= 1)
    out = []
    for lo, hi in zip(ts, ts[1:], strict=False):
        for f in (0.25, 0.5, 0.75):
            t = lo + (hi - lo) * f
            c = (math.floor(x0 + (x1 - x0) * t), math.floor(y0 + (y1 - y0) * t))
            if hi - lo > 1e-9 and c not in out:
                out.append(c)
    return out


def test_every_cell_once(spark):
    rng = random.Random(13)
    lines = [(rng.uniform(-20, 60), rng.uniform(-20, 60), rng.uniform(-20, 60), rng.uniform(-20, 60)) for _ in range(300)]
    lines += [(0.5, 0.5, 12_000.5, 7000.25), (3.5, 2.0, 3.5, 9.0), (1.0, 4.5, 8.0, 4.5), (5.25, 5.25, 5.75, 5.5), (2.5, 7.5, 9.5, 0.5), (0.0, 0.0, 4.0, 4.0)]
    rows = [(i, *x) for i, x in enumerate(lines)]
    found = spark.createDataFrame(rows, "i long, x0 double, y0 double, x1 double, y1 double").select("i", raster.crossed(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("cells")).collect()
    for r in found:
        got = [(c.cx, c.cy) for c in r.cells]
        assert got == cells_by_force(*lines[r.i]) and len(set(got)) == len(got)
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 or lines[r.i] in ((2.5, 7.5, 9.5, 0.5), (0.0, 0.0, 4.0, 4.0)) for a, b in zip(got, got[1:], strict=False))


def segments_of(spark, rng, n, size=10_000, most=400):
    rows = []
    for _ in range(n):
        d = rng.randrange(1, most)
        rows.append((rng.randrange(size - d), rng.randrange(size - d), d, d, rng.randrange(2), 0, 0, 0, round(rng.random(), 3)))
    return spark.createDataFrame(rows, SEGMENT)


def test_heat_of_a_fine_grid_has_no_holes(spark):
    row = spark.createDataFrame([(0, 0, 10_000, 10_000, 0, 0, 0, 0, 0.9)], SEGMENT)
    cells = {(r.cx, r.cy) for r in raster.identity_heatmap(row, (0, 10_000, 0, 10_000), 9000, 9000).collect()}
    # A sample that rounds to the cell before leaves single ones out.
    assert len(cells) > 8500 and all({(i, i), (i + 1, i + 1)} & cells for i in range(8998))


def test_segments_in_view(spark):
    rng = random.Random(14)
    found = segments_of(spark, rng, 500)
    grid, side = raster.segment_grid(found, 10_000, 10_000)
    assert side == 64 and {(r.cx, r.cy) for r in grid.collect()} <= {(i, j) for i in range(64) for j in range(64)}
    for _ in range(3):
        x, y = rng.randrange(9000), rng.randrange(9000)
        view = (x, x + rng.randrange(1, 3000), y, y + rng.randrange(1, 3000))
        ends = raster.endpoints(found)
        want = {(r.x, r.y, r.dx, r.strand) for r in ends.collect() if any(view[0] <= r.x0 + (r.x1 - r.x0) * t / 400 <= view[1] and view[2] <= r.y0 + (r.y1 - r.y0) * t / 400 <= view[3] for t in range(401))}
        got = [(r.x, r.y, r.dx, r.strand) for r in raster.in_view(grid, side, 10_000, 10_000, *view).collect()]
        assert want <= set(got) and len(got) == len(set(got)) and set(got) <= {(r.x, r.y, r.dx, r.strand) for r in found.filter(raster.in_rect(*view)).collect()}


@pytest.mark.parametrize("most, sx, sy, finest", [(300.0, 0.5, 2.0, None), (1e5, 1.0, 1.0, 500.0)])
def test_nearest_join(spark, most, sx, sy, finest):
    rng = random.Random(15)
    found = segments_of(spark, rng, 120)
    found = found.unionByName(found.limit(10)).unionByName(spark.createDataFrame([(5000, 5000, 300, 300, 0, 0, 0, 0, 0.5), (5000, 5000, 300, 300, 0, 0, 0, 0, 0.4)], SEGMENT))
    points = [(i, rng.uniform(-100, 10_100), rng.uniform(-100, 10_100)) for i in range(150)] + [(900, 5100.0, 5100.0), (901, 5301.0, 5300.0), (902, 1e7, 1e7)]
    got = {r.id: (r.x, r.y, r.strand, round(r.distance, 6)) for r in raster.nearest_join(spark.createDataFrame(points, "id long, px double, py double"), found, most, sx, sy, finest).collect()}
    ends = raster.endpoints(found).collect()
    want = {}
    for i, px, py in points:
        best = []
        for r in ends:
            ax, ay, dx, dy = (r.x0 - px) * sx, (r.y0 - py) * sy, (r.x1 - r.x0) * sx, (r.y1 - r.y0) * sy
            t = min(1.0, max(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
            d = math.sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)
            if d < most:
                best.append((d, r.x, r.y, r.strand))
        if best:
            d, x, y, s = min(best)
            want[i] = (x, y, s, round(d, 6))
    assert got == want


def test_nearest_join_searches_a_point_once(spark, monkeypatch):
    """Clusters of short segments far apart, points in them and between: no rounds, whatever the distances, and the results of a plain search."""
    rng = random.Random(16)
    found = {(cx + rng.randrange(60), cy + rng.randrange(60), 12, 12, rng.randrange(2), 0, 0, 0, 1.0) for cx, cy in ((0, 0), (40, 90_000), (30_000, 400_000)) for _ in range(150)}
    points = [(i, float(cx + rng.randrange(-40, 100)), float(cy + rng.randrange(-40, 100))) for i, (cx, cy) in enumerate([(0, 0), (40, 90_000), (30_000, 400_000)] * 20)]
    points += [(100 + i, rng.uniform(-100, 31_000), rng.uniform(-100, 410_000)) for i in range(60)]
    made = []
    monkeypatch.setattr(raster, "stored", lambda df, label, by=None: made.append(label) or stored(df, label, by))
    got = {r.id: (r.x, r.y, r.strand, round(r.distance, 6)) for r in raster.nearest_join(spark.createDataFrame(points, "id long, px double, py double"), spark.createDataFrame(sorted(found), SEGMENT), 50_000.0, finest=8.0).collect()}
    want = {}
    for i, px, py in points:
        best = []
        for x, y, dx, dy, strand, *_ in found:
            y0, up = (y, dy) if strand == 0 else (y + dy, -dy)
            t = min(1.0, max(0.0, -((x - px) * dx + (y0 - py) * up) / (dx * dx + up * up)))
            best.append((math.hypot(x - px + t * dx, y0 - py + t * up), x, y, strand))
        d, x, y, s = min((round(b[0], 9), *b[1:]) for b in best)
        if d < 50_000:
            want[i] = (x, y, s, round(d, 6))
    assert got == want and 60 < len(want) < 120 and made == ["reach"]


# ------------------------------------------------------------------ stored tables
def test_stored_tables(spark, tmp_path):
    df = stored(spark.range(100), "numbers")
    path = df._kmerloom_path
    assert df.count() == 100 and path.startswith(shared_folder(spark))
    release(df, scratch(spark, "nothing"))
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077", applicationId="a"))
    with pytest.raises(EngineError, match="checkpoint"):
        shared_folder(cluster)


def test_tiles_of_annotations(spark):
    """A view from tiles equals one of all items; a repeated view reads nothing, and the first tiles go first."""
    from kmerloom.sources.tiles import TileCache

    rng = random.Random(11)
    items = [("c", a := rng.randrange(0, 9500), a + rng.choice([1, 30, 2500]), rng.choice("xyz"), rng.choice(["+", "-", None]), None) for _ in range(300)]
    items += items[:20] + [("d", 5, 50, "x", "+", "1,2,3"), ("c", 1000, 2000, None, None, None)]
    table = spark.createDataFrame(items, "chrom string, start long, end long, name string, strand string, rgb string")
    asked = []

    def read(windows):
        asked.append(windows)
        return table.filter(" OR ".join(f"(chrom = '{c}' AND start < {e} AND end > {s})" for c, s, e in windows))

    def plain(chrom, lo, hi):
        held = {}
        for x in items:
            if x[0] == chrom and x[2] > lo and x[1] < hi:
                held.setdefault(x[:4], []).append((x[4] is not None, x[4] or "", x[5]))
        return sorted(((*k, min(v)[1] if min(v)[0] else None, min(v)[2]) for k, v in held.items()), key=repr)

    cache = TileCache(read, tile_bp=1000, most=6)
    told = lambda *x: sorted(map(tuple, cache.view(*x).collect()), key=repr)
    assert told("c", 2500, 4100) == plain("c", 2500, 4100) and asked == [[("c", 2000, 5000)]]
    assert told("c", 1000, 6000) == plain("c", 1000, 6000) and asked[1:] == [[("c", 1000, 2000), ("c", 5000, 6000)]]
    assert told("c", 1200, 5500) == plain("c", 1200, 5500) and len(asked) == 2
    assert told("d", 0, 100) == plain("d", 0, 100) == [("d", 5, 50, "x", "+", "1,2,3")] and len(cache.held) == 6
    assert told("c", 7000, 7001) == plain("c", 7000, 7001) and ("c", 2) not in cache.held and len(cache.held) == 6
    assert told("c", 2999, 3000) == plain("c", 2999, 3000) and asked[4:] == [[("c", 2000, 3000)]]
    assert told("c", 0, 10_000) == plain("c", 0, 10_000) and len(cache.held) == 10
    assert told("none", 0, 10) == []
    with pytest.raises(EngineError):
        TileCache(read, most=0)


@pytest.mark.parametrize("first", [None, 2])
@pytest.mark.parametrize("chunk", [5, 1 << 18])
def test_pair_sums_of_packed_rows(spark, monkeypatch, first, chunk):
    """Sums of packed k-mers, a few rows for all of a batch, are those of a row for each k-mer."""
    from kmerloom.operators import packed

    monkeypatch.setattr(pairs, "CHUNK", chunk)
    rng = random.Random(3)
    parts = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    seqs = ["".join(rng.choice(parts) for _ in range(12)) + "A" * 40 for _ in range(5)]
    axis = kmers.as_axis(spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "i long, name string, seq string"), "i", "name", "seq")
    pieces, lay = kmers.spread(axis), packed.layout(7, 5, 4000)
    rows = packed.packed(pieces, ["rec"], lambda batch, row, place: batch.column("rec").to_numpy()[row], lay)
    plain = kmers.kmers(pieces, 7).select("kv", "rec").withColumnsRenamed({"rec": "g"}).selectExpr("kv", "g", "1L AS n")
    assert rows.count() * 4 < plain.count()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(pairs.packed_sums(rows, lay, 5, first)) == key(pairs.pair_sums(plain, 5, first))
