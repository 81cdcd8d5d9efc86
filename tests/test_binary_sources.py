"""Compressed and binary files read by ranges, in many tasks."""

from __future__ import annotations

import random
import struct
import zlib

import pytest
from test_sources import LINES, bigbed, twobit, write

from kmerloom.model import EngineError
from kmerloom.sources import bgzf, binary, fasta, intake, paf, svg
from kmerloom.sources.ranges import Ranges


def blocks_of(data: bytes, sizes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = sizes()
        out.append(bgzf.packed(data[at : at + n]))
        at += n
    return b"".join(out) + bgzf.END


def hadoop_like(data: bytes, separator: bytes) -> list[bytes]:
    out = data.split(separator)
    return out[:-1] if out[-1] == b"" else out


@pytest.mark.parametrize("separator", [b"\n", b"\n>"])
def test_every_record_once_whatever_the_ranges(separator):
    rng = random.Random(2)
    for _ in range(120):
        data = b"".join(rng.choice([b"\n", b">", b"ACGT", b"x" * rng.randrange(40), b"\n>"]) for _ in range(rng.randrange(60)))
        file = blocks_of(data, lambda: rng.randrange(1, 50))
        for split in (len(file), rng.randrange(20, 60), rng.randrange(60, 300)):
            parts = [list(bgzf.records(Ranges(file), at, min(at + split, len(file)), separator, bgzf.MOST)) for at in range(0, len(file), split)]
            assert sum(parts, []) == hadoop_like(data, separator), (data, split)


def test_stored_data_that_looks_like_a_block():
    """A header inside a block's data leads nowhere."""
    inner = bgzf.packed(b"not a block of this file")
    data = b"".join(bytes([i % 256]) * 7 + inner + b"\n" for i in range(300))
    stored = b""
    for at in range(0, len(data), 5000):
        deflate = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = deflate.compress(data[at : at + 5000]) + deflate.flush()
        stored += bgzf.MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data[at : at + 5000]), len(data[at : at + 5000]))
    stored += bgzf.END
    parts = [list(bgzf.records(Ranges(stored), at, min(at + 700, len(stored)), b"\n")) for at in range(0, len(stored), 700)]
    assert sum(parts, []) == hadoop_like(data, b"\n")


def test_corrupt_blocks_are_errors():
    good = blocks_of(b"ACGT\n" * 4000, lambda: 1000)
    second = bgzf.block_size(bgzf.Window(Ranges(good)), 0)[0]
    size = bgzf.block_size(bgzf.Window(Ranges(good)), second)[0]
    for bad in (good[:second] + b"\0" + good[second + 1 :], good[: second + 16] + b"\xff\xff" + good[second + 18 :], good[: second + size - 6] + b"\1" + good[second + size - 5 :], good[: len(good) - 40]):
        with pytest.raises(EngineError, match="BGZF"):
            list(bgzf.records(Ranges(bad), 0, len(bad), b"\n"))
    assert bgzf.is_bgzf(good) and not bgzf.is_bgzf(b"\x1f\x8b\x08\x00" + b"\0" * 30) and not bgzf.is_bgzf(b"")


def test_fasta_and_paf_from_one_bgzf_file(spark, tmp_path):
    rng = random.Random(4)
    text = ";note\n" + "".join(f">r{i} @offset={i}\n" + "\n".join("".join(rng.choice("ACGTN") for _ in range(60)) for _ in range(rng.randrange(12))) + "\n" for i in range(400))
    lines = "".join(f"{LINES[i % len(LINES)]}\n" for i in range(3000))
    for name, data in (("a.fa", text), ("a.paf", lines)):
        write(tmp_path / name, data)
        write(tmp_path / f"{name}.gz", blocks_of(data.encode(), lambda: 3000))
    assert intake.kind_of(spark, str(tmp_path / "a.fa.gz")) == "fasta"
    got = bgzf.read_bgzf(spark, str(tmp_path / "a.fa.gz"), "\n>", 5000)
    assert got.rdd.getNumPartitions() > 3 and got.select("block").distinct().count() > 3
    plain, packed = (fasta.read_axis(spark, str(tmp_path / n), **o).orderBy("rec").collect() for n, o in (("a.fa", {}), ("a.fa.gz", {"split": 5000})))
    assert packed == plain and len(plain) == 400
    plain, packed = (paf.read_lines(spark, str(tmp_path / n), **o).orderBy("line_no").collect() for n, o in (("a.paf", {}), ("a.paf.gz", {"split": 700})))
    assert packed == plain and len(plain) == 3000


def test_bgzf_sink(spark, tmp_path):
    rows = [(f"line {i} " + "x" * (i % 300),) for i in range(5000)]
    df = spark.createDataFrame(rows, "value string").repartition(3)
    bgzf.write_bgzf(df, str(tmp_path / "out"))
    assert sorted(r.value for r in bgzf.read_bgzf(spark, str(tmp_path / "out"), split=20_000).collect()) == sorted(r[0] for r in rows)
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 3 and b"".join(binary.gunzip(f.read_bytes()) for f in files).count(b"\n") == 5000 and sorted(x.name for x in tmp_path.iterdir()) == ["out"]
    with pytest.raises(Exception, match="exists"):
        bgzf.write_bgzf(df, str(tmp_path / "out"))
    bgzf.write_bgzf(df.limit(10), str(tmp_path / "out"), overwrite=True)
    assert bgzf.read_bgzf(spark, str(tmp_path / "out")).count() == 10
    broken = spark.range(10).selectExpr("CASE WHEN id = 7 THEN raise_error('no') ELSE 'a' END AS value")
    with pytest.raises(Exception):
        bgzf.write_bgzf(broken, str(tmp_path / "bad"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out"]


def sequences(seed=6):
    rng = random.Random(seed)
    some = {"long": "".join(rng.choice("ACGT") for _ in range(40_000)), "gaps": "".join(("N" * rng.randrange(1, 9)) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 9))) for _ in range(9000)), "n": "N" * 50, "none": ""}
    return some | {f"small{i:04d}": "ACGT"[i % 4] * (i % 7) for i in range(6000)}


def test_twobit_reads_what_a_region_needs(tmp_path):
    seqs = sequences()
    data = twobit(seqs)
    path = write(tmp_path / "x.2bit", data)
    file = binary.TwoBit(path)
    index = file.file.bytes_read
    assert list(file.at) == list(seqs) and index < 16 + sum(len(n) + 5 for n in seqs) + 3 * binary.INDEX_STEP
    rng = random.Random(7)
    for name in ("long", "gaps", "n", "none", "small0005"):
        for _ in range(60):
            a = rng.randrange(-5, len(seqs[name]) + 5)
            b = a + rng.randrange(-2, 3000)
            assert file.region(name, a, b) == seqs[name][max(a, 0) : max(b, 0)], (name, a, b)
    before = file.file.bytes_read
    assert file.region("long", 10_000, 18_000) == seqs["long"][10_000:18_000] and file.file.bytes_read - before < 8000 / 4 + 20
    before = file.file.bytes_read
    file.region("gaps", 60_000, 60_100)
    assert file.file.bytes_read - before < 2 * 8 * binary.BLOCK_STEP + 200
    for bad in (data[:9000], data[:16]):
        with pytest.raises(EngineError, match="ends inside"):
            binary.TwoBit(bad)
    with pytest.raises(EngineError, match="ends inside"):
        binary.TwoBit(data[: -len(data) // 3]).region("small5999", 0, 5)


def test_twobit_in_many_tasks(spark, tmp_path):
    seqs = sequences()
    path = write(tmp_path / "x.2bit", twobit(seqs))
    regions = [("long", 10, 35_001), ("gaps", 0, 70_000), ("long", 5, 5), ("none", 0, 10), ("long", 39_990, 99_999)]
    rows = binary.read_twobit(spark, path, regions, piece=4096).collect()
    assert sorted((r.name, r.offset, r.seq) for r in rows) == sorted((n, s, seqs[n][s:e]) for n, s, e in regions)
    pieces = binary.twobit_pieces(spark, path, [("long", 0, 40_000)], piece=4096)
    assert pieces.rdd.getNumPartitions() == 10 and max(r.bytes_read for r in pieces.collect()) < 4096 / 4 + 3 * binary.INDEX_STEP + 100
    with pytest.raises(EngineError, match="no sequence|confirm|asked"):
        binary.read_twobit(spark, path, [("long", 0, 400_000_000)])


def test_twobit_filters_reach_the_reader(spark, tmp_path):
    seqs = sequences()
    path = write(tmp_path / "x.2bit", twobit(seqs))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = binary.twobit_pieces(spark, path, piece=4096).filter("name = 'long' AND start < 20000 AND end > 9000")
        assert some.rdd.getNumPartitions() == 3
        assert [(r.start, r.seq) for r in some.orderBy("start").collect()] == [(a, seqs["long"][a : a + 4096]) for a in (8192, 12_288, 16_384)]
        both = binary.twobit_pieces(spark, path, piece=4096).filter("name IN ('n', 'none', 'nobody')")
        assert both.rdd.getNumPartitions() == 2 and {(r.name, r.seq) for r in both.collect()} == {("n", "N" * 50), ("none", "")}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


@pytest.mark.parametrize("compress", [True, False])
def test_bigbed_in_many_tasks(spark, tmp_path, compress, monkeypatch):
    rng = random.Random(8)
    items = []
    for chrom, size in (("chrA", 5000), ("chrB", 3000)):
        for s in sorted(rng.randrange(size - 60) for _ in range(400)):
            items.append((chrom, s, s + rng.randrange(1, 60), f"{chrom}{len(items)}\t0\t{rng.choice('+-.')}\t0\t0\t{rng.choice(['0', '1,2,3'])}"))
    items.append(items[-1])
    path = write(tmp_path / "x.bb", bigbed(items, compress))
    windows = [("chrA", 100, 900), ("chrA", 850, 1000), ("chrB", 2000, 2001), ("chrB", 2900, 9999), ("chrC", 0, 5), ("chrA", 3000, 3000)]
    want = sorted((c, s, e, t.split("\t")[0], t.split("\t")[2], t.split("\t")[5] if "," in t else None) for c, s, e, t in items if any(c == w and s < b and e > a and a < b for w, a, b in windows))
    for most in (100, 2000, None):
        got = binary.read_bigbed(spark, path, windows, most)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
        assert got.rdd.getNumPartitions() > (20 if most == 100 else 0)
    spark.dataSource.register(binary.BigBedSource)
    read = spark.read.format("bigbed").option("windows", '[["chrA", 100, 200]]').load(path)
    # Both trees' nodes (one leaf holds all blocks here) and the data blocks of the window.
    assert max(r.bytes_read for r in read.collect()) < 64 + 60 + 32 * len(items) + 4000
    file = binary.BigBed(path)
    a = file.query("chrA", 850, 1000)
    assert [x[:2] for x in a] == sorted((s, e) for c, s, e, _ in items if c == "chrA" and s < 1000 and e > 850) or sorted(a) == sorted((s, e, t.split("\t")[0], t.split("\t")[2], t.split("\t")[5] if "," in t else None) for c, s, e, t in items if c == "chrA" and s < 1000 and e > 850)


def test_blocks_that_lie_close_are_read_together():
    blocks = [(0, 10), (10, 5), (15 + binary.NEAR - 1, 4), (19 + 2 * binary.NEAR, 1)]
    runs = binary.joined(blocks)
    assert [(b, e, len(p)) for b, e, p in runs] == [(0, 18 + binary.NEAR, 3), (19 + 2 * binary.NEAR, 20 + 2 * binary.NEAR, 1)]
    assert len(binary.joined(blocks, 15)) == 3


def test_svg(spark, tmp_path, monkeypatch):
    from xml.etree import ElementTree

    from kmerloom.model import SEGMENT

    rows = [(0, 0, 100, 100, 0, 0, 0, 0, 1.0), (50, 20, 40, 40, 1, 0, 0, 0, 0.5), (900, 900, 50, 50, 0, 0, 0, 0, 0.75), (2000, 0, 5, 5, 0, 0, 0, 0, 1.0)]
    found = spark.createDataFrame(rows, SEGMENT).repartition(3)
    lines = svg.svg_lines(found, (0.0, 1000.0, 0.0, 1000.0), 300, 150, identity_low=0.5)
    assert sorted(map(tuple, lines.collect())) == [(0, 0, 0, 0.0, 150.0, 30.0, 135.0, 255), (50, 20, 1, 15.0, 141.0, 27.0, 147.0, 0), (900, 900, 0, 270.0, 15.0, 285.0, 7.5, 128)]
    path = str(tmp_path / "a.svg")
    assert svg.write_svg(lines, path, 300, 150, 'two "axes" <&>') == 3
    root = ElementTree.parse(path).getroot()
    drawn = [x.attrib for x in root.iter("{http://www.w3.org/2000/svg}line")]
    assert root.attrib["aria-label"] == 'two "axes" <&>' and [(d["x1"], d["y2"]) for d in drawn] == [("0.00", "135.00"), ("15.00", "147.00"), ("270.00", "7.50")] and drawn[0]["stroke"] == "rgb(16,44,110)" and drawn[1]["stroke"] == "rgb(250,214,190)"
    profile = spark.createDataFrame([(0, 1.0), (1, 10**2.5)], "tile long, mult double")
    assert [r.tone for r in svg.svg_lines(found, (0.0, 1000.0, 0.0, 1000.0), 300, 150, "multiplicity", 0.0, profile, 500).orderBy("x").collect()] == [0, 0, 255]
    monkeypatch.setattr(svg, "MOST_LINES", 2)
    with pytest.raises(EngineError, match="at most") as e:
        svg.write_svg(lines, str(tmp_path / "b.svg"), 300, 150)
    assert e.value.remedies and [x.name for x in tmp_path.iterdir()] == ["a.svg"]
    for by in ("colour", "multiplicity"):
        with pytest.raises(EngineError):
            svg.svg_lines(found, (0.0, 1.0, 0.0, 1.0), 3, 3, by)
