"""What reading and writing sequence files costs does not grow with the number of records or pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.sources import bgzf, fasta


def test_fasta_is_parsed_once(spark, tmp_path):
    texts = [f">r{i} x\n" + "ACGT" * (i % 7) for i in range(300)]
    spark.createDataFrame([(t,) for t in ["; a comment", *texts]], "value string").coalesce(1).write.text(str(tmp_path / "f"))
    rows = fasta.read_records(spark, str(tmp_path / "f"))
    plan = rows._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan
    assert [(r.rec_ord, r.name) for r in rows.orderBy("rec_ord").collect()] == [(i + 1, f"r{i}") for i in range(300)]


def test_bgzf_ranges_grow_with_the_folder(spark, tmp_path):
    (tmp_path / "x.gz").write_bytes(bytes(100 * bgzf.MOST))
    assert bgzf.split_for(str(tmp_path), 10) == 10 * bgzf.MOST
    assert bgzf.split_for(str(tmp_path), 1000) == bgzf.MOST and bgzf.split_for(str(tmp_path), 1) == 100 * bgzf.MOST


def test_small_twobit_records_share_tasks(spark, tmp_path):
    from kmerloom.sources import binary

    seqs = [(f"s{i}", "ACGTN"[i % 5] * (i % 40)) for i in range(3000)] + [("long", "ACGTT" * 4000)]
    binary.write_twobit(spark.createDataFrame(seqs, "name string, seq string").coalesce(2), str(tmp_path / "t"))
    pieces = binary.twobit_pieces(spark, str(tmp_path / "t"), piece=4096, task=binary.PIECE)
    assert pieces.rdd.getNumPartitions() <= 4
    rows = pieces.orderBy("name", "start").collect()
    assert {n: "".join(r.seq for r in rows if r.name == n) for n in ("s7", "s39", "long")} == {n: s for n, s in seqs if n in ("s7", "s39", "long")}
    assert len(rows) == 3000 + 5


def test_bigbed_writer_holds_a_block_only():
    import tracemalloc

    from kmerloom.sources import binary, sinks

    items = lambda: (("c", i, i + 5, f"n{i}", "+", None) for i in range(200_000))
    tracemalloc.start()
    pieces = list(sinks.bigbed_file(items()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    assert [x[0] for x in binary.BigBed(b"".join(pieces)).query("c", 1000, 1010)] == list(range(996, 1010))


def test_saturated_intervals_are_stored(spark):
    from kmerloom.operators import profile

    tiles = spark.createDataFrame([(t, k, 1) for t in (0, 1, 2, 5, 6) for k in range(4)], "tile long, kv long, n long").mapInArrow(lambda b: b, "tile long, kv long, n long")
    found = profile.saturated(tiles, 3500, 1, tile=512)
    spliced = profile.splice(found, spark.createDataFrame([(600, 700)], "start long, end long"), 500, 1200)
    assert "MapInArrow" not in found._jdf.queryExecution().toString() + spliced._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(0, 1536), (2560, 3500)]
    assert sorted(map(tuple, spliced.collect())) == [(0, 500), (600, 700), (1200, 1536), (2560, 3500)]


def test_windows_of_records_need_no_shuffle_of_kmers(spark, monkeypatch):
    from kmerloom.operators import kmers

    monkeypatch.setattr(kmers, "PIECE", 50)
    seqs = {0: "ACGTTGCA" * 20, 1: "ACG", 2: "AAAAAAANCCCCCC", 3: "ACGTACGTAA"}
    axis = kmers.as_axis(spark.createDataFrame([(i, f"r{i}", s) for i, s in seqs.items()], "i long, name string, seq string"), "i", "name", "seq")
    rows = {r.rec: (r.windows, r.pos_sum, r.distinct_kmers) for r in kmers.record_windows(kmers.spread(axis), 5).collect()}
    at, want = 0, {}
    for i, s in seqs.items():
        own = [(at + j, s[j : j + 5]) for j in range(len(s) - 4) if "N" not in s[j : j + 5]]
        if own:
            want[i] = (len(own), sum(p for p, _ in own), len({w for _, w in own}))
        at += len(s)
    assert rows == want
    each = axis.withColumn("parts", F.lit(1)).select("rec", "start", "len", "parts", "seq").mapInArrow(kmers._windowed(5), "rec long, windows long, pos_sum long, n long, kv long")
    assert each.filter("kv IS NOT NULL").isEmpty()


def test_occurrences_of_counted_kmers(spark):
    from kmerloom.operators import kmers, profile

    axis = kmers.spread(kmers.as_axis(spark.createDataFrame([(0, "a", "ACGTACGTACGT"), (1, "b", "ACGTAN")], "i long, name string, seq string"), "i", "name", "seq"))
    counted = kmers.counted_kmers(axis, 5)
    assert counted.count() < kmers.kmers(axis, 5).count()
    assert {tuple(r) for r in profile.occurrences(counted).collect()} == {tuple(r) for r in profile.occurrences(kmers.kmers(axis, 5)).collect()}


def test_kmers_among_some(spark):
    """Of k-mers that are wanted alone nothing else leaves the task that enumerates them."""
    from kmerloom.operators import kmers

    seqs = ["ACGTTGCAAC" * 30, "TTTTTTTACG", "GGGCATTTACCAGT" * 9]
    axis = kmers.spread(kmers.as_axis(spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "i long, name string, seq string"), "i", "name", "seq"))
    every = {(r.rec, r.kv): r.n for r in kmers.record_kmers(axis, 7).collect()}
    for some in (np.array(sorted({kv for _, kv in every})[::3] + [4**7 + 1]), np.zeros(0, np.int64)):
        got = {(r.rec, r.kv): r.n for r in kmers.record_kmers(axis, 7, among=some).collect()}
        assert got == {x: n for x, n in every.items() if x[1] in set(some.tolist())}
        assert kmers.group_kmers(axis, 7, among=some).filter(~F.col("kv").isin(some.tolist() or [-1])).isEmpty()


@pytest.mark.parametrize("held", [1 << 21, 3])
def test_multiplicity_of_packed_kmers(spark, monkeypatch, held):
    """A profile of pieces, whose k-mers are packed, is that of a row for each k-mer and tile."""
    from kmerloom.operators import kmers, profile

    monkeypatch.setattr(profile, "TILES_HELD", held)
    axis = kmers.as_axis(spark.createDataFrame([(i, str(i), s) for i, s in enumerate(["ACGTTGCAAC" * 30, "TTTTTTTACG", "GGGCATTTACCAGT" * 9 + "N" * 200])], "i long, name string, seq string"), "i", "name", "seq")
    pieces, total = kmers.spread(axis), kmers.total_length(axis)
    for stride in (1, 3):
        key = lambda df: sorted((r.tile, round(r.mult, 9), round(r.uniq_frac, 9)) for r in df.collect())
        assert key(profile.multiplicity(pieces, total, 50, stride, k=6)) == key(profile.multiplicity(kmers.tile_kmers(pieces, 6, 50, stride), total, 50, stride))


@pytest.mark.parametrize("placed", [1 << 24, 3])
def test_saturation_of_packed_kmers(spark, monkeypatch, placed):
    """Saturated tiles of pieces, whose k-mers and sums are packed, are those of a row for each k-mer and tile."""
    from kmerloom.operators import kmers, profile

    monkeypatch.setattr(profile, "TILES_PLACED", placed)
    monkeypatch.setattr(profile, "TILES_ROW", 4)
    rng = np.random.default_rng(3)
    of = lambda n: "".join(rng.choice(list("ACGT"), n))
    seqs = [of(700), "ACGTTGCAAC" * 30, "TTTTTTTACG", "N" * 120 + "GGGCATTTACCAGT" * 9 + "N" * 200, of(433) + "ACGTTGCAAC" * 20]
    axis = kmers.as_axis(spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "i long, name string, seq string"), "i", "name", "seq")
    pieces, total = kmers.spread(axis), kmers.total_length(axis)
    told = {}
    for cap in (1, 2, 45):
        told[cap] = sorted(map(tuple, profile.saturated(pieces, total, cap, 50, k=9).collect()))
        assert told[cap] == sorted(map(tuple, profile.saturated(kmers.tile_kmers(pieces, 9, 50), total, cap, 50).collect()))
    assert len(told[1]) > 1 and told[1] != told[45]


def test_saturation_deals_out_no_row_for_a_kmer(spark, data, monkeypatch):
    from kmerloom import queries
    from kmerloom.operators import profile

    plans = {}

    def stored(df, label, by=None):
        plans[label] = df._jdf.queryExecution().toString()
        return df

    monkeypatch.setattr(profile, "stored", stored)
    queries.saturated(spark, data)
    assert "hashpartitioning(bucket" in plans["hot"] and "hashpartitioning(kv" not in plans["hot"] and "windowspecdefinition(kv" not in plans["hot"]


@pytest.mark.parametrize("k,groups", [(15, 1 << 24), (26, 1 << 24), (26, 3)])
def test_packed_rows_give_back_kmers_and_groups(k, groups):
    """Of neighbours distance and group take three bytes; where both don't fit into one number they stand apart."""
    from collections import Counter

    from kmerloom.operators import packed

    rng = np.random.default_rng(5)
    lay = packed.layout(k, groups, 1 << 30)
    assert lay.joint == (k == 15 or groups == 3)
    kv, g = rng.integers(0, 4**k, 1 << 19), np.sort(rng.integers(groups // 2, groups // 2 + min(2, groups), 1 << 19)) + rng.integers(0, 1 + groups // (1 << 14), 1 << 19)
    kv[::7] = kv[0]
    rows = packed.pack(kv, g, lay)
    want = Counter(zip((kv.astype(np.uint64) * packed.ODD & np.uint64(4**k - 1)).tolist(), g.tolist(), strict=True))
    assert {(a, b): n for x in packed.buckets(iter([rows]), lay) for a, b, n in zip(*(y.tolist() for y in x), strict=True)} == want
    if k == 15:
        assert sum(len(x) for c in ("kv", "g") for x in rows.column(c).to_pylist()) <= 4 * len(want)
    assert list(packed.buckets(iter([packed.pack(kv[:0], g[:0], lay)]), lay)) == []


def test_neighbours_are_dealt_out_squeezed(spark, monkeypatch):
    """Pieces come back whole and in order, give the k-mers of plain ones, and take a third of their bytes while they are dealt out."""
    from kmerloom.functions.sequence import unsqueezed
    from kmerloom.operators import kmers

    monkeypatch.setattr(kmers, "PIECE", 2000)
    rng = np.random.default_rng(9)
    seqs = ["".join(rng.choice(list("ACGT"), n)) for n in (5000, 0, 4000, 900)] + ["ACGNNNNACGTTTG"]
    df = spark.createDataFrame([(i, str(i), s) for i, s in enumerate(seqs)], "i long, name string, seq string")
    axis = kmers.as_axis(df, "i", "name", "seq")
    placed = kmers.catalog(axis).select("rec", "start", (F.col("end") - F.col("start")).alias("len"))
    pieces = kmers.near(kmers.squeezed(df.select(F.col("i").alias("rec"), "seq"), "rec", placed), 4000)
    rows = sorted(((r.rec, r.start, r.len, r.seq) for r in pieces.collect()), key=lambda r: r[:2])
    whole = "".join(seqs)
    assert "".join(unsqueezed(pa.array([bytes(x)], pa.binary()))[0].as_py()[:n] for _, _, n, x in rows) == whole and len(rows) == 8
    assert sum(len(x) for *_, x in rows) < 0.36 * len(whole)
    assert sorted(map(tuple, kmers.kmers(pieces, 9).collect())) == sorted(map(tuple, kmers.kmers(kmers.spread(axis), 9).collect()))
