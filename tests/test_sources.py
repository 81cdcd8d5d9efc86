"""Readers on files made here, and the small grammars."""

from __future__ import annotations

import gzip
import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import formatting, grammar
from kmerloom.model import EngineError
from kmerloom.sources import binary, fasta, intake, paf


def write(path, data):
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return str(path)


def test_fasta(spark, tmp_path):
    a = write(tmp_path / "a.fa", ";note\n>one first @offset=100\r\nACGT\r\nac gu\r\n;mid\r\nNNRY\n\n>\nTT>T\n>empty\n>one\nA\n")
    b = write(tmp_path / "b.fa.gz", gzip.compress(b"ACG\nTTT\n"))
    rows = [tuple(r) for r in fasta.read_axis(spark, a, b).orderBy("rec").select("rec", "name", "start", "len", "offset", "seq").collect()]
    assert rows == [(0, "one", 0, 12, 100, "ACGTACGTNNNN"), (1, "seq2", 12, 4, 0, "TTNT"), (2, "empty", 16, 0, 0, ""), (3, "one", 16, 1, 0, "A"), (4, "seq1", 17, 6, 0, "ACGTTT")]
    assert {(r.kind, r.name) for r in fasta.warnings(fasta.read_records(spark, a)).collect()} == {("mid_line_gt", "seq2"), ("empty", "empty"), ("duplicate", "one")}
    with pytest.raises(EngineError):
        fasta.read_axis(spark, write(tmp_path / "c.fa", ">x\n"))
    assert fasta.looks_like_fasta(b"\n >x") and not fasta.looks_like_fasta(b"x") and fasta.region_as_fasta("c", 7, "ACGT") == ">c @offset=7\nACGT\n"


LINES = ["q1\t3000\t0\t1000\t+\tt1\t2500\t500\t1500\t950\t1000\t60\ttp:A:P", "q2\t1000\t0\t500\t-\tt1\t2500\t0\t500\t500\t500\t60", "# note", "", "bad\tline", "q1\t3000\t10\t20\t+\tt1\t2500\t10\t20\t7\t0\t0", "q1\t3000\t10\t10\t+\tt1\t2500\t10\t20\t7\t9\t0"]


def test_paf(spark, tmp_path):
    path = write(tmp_path / "x.paf", "\r\n".join(LINES) + "\n")
    parsed = paf.parse(paf.read_lines(spark, path))
    assert parsed.filter("valid").count() == 3 and parsed.filter("NOT valid").count() == 2
    segments, target, query = paf.standalone(parsed)
    assert [tuple(r) for r in query.orderBy("rec").collect()] == [(0, "q1", 0, 3000), (1, "q2", 3000, 4000)] and [tuple(r) for r in target.collect()] == [(0, "t1", 0, 2500)]
    assert {(r.x, r.y, r.dx, r.dy, r.strand, r.identity) for r in segments.collect()} == {(500, 0, 1000, 1000, 0, 0.95), (0, 3000, 500, 500, 1, 1.0), (10, 10, 10, 10, 0, 0.0)}
    catalog = lambda *rows: spark.createDataFrame([(i, n, s, s + w, o) for i, (n, s, w, o) in enumerate(rows)], "rec long, name string, start long, end long, offset long")
    over = paf.overlay(parsed, catalog(("t1", 50, 1200, 400)), catalog(("q1", 0, 9, 0), ("q1", 20, 3000, 0)))
    status = {r.line_no: (r.status, r.x, r.y) for r in over.collect()}
    assert status[0] == ("remapped", 150, 20) and status[1][0] == "unknown" and status[4][0] == "skipped" and status[5][0] == "mismatch"
    counts = paf.check_overlay(paf.overlay_counts(over))
    assert (counts["kept"], counts["remapped"], counts["unknown"], counts["mismatch"], counts["skipped"]) == (1, 1, 1, 1, 2)
    with pytest.raises(EngineError, match="name other"):
        paf.check_overlay(paf.overlay_counts(paf.overlay(parsed, catalog(("z", 0, 1, 0)), catalog(("z", 0, 1, 0)))))
    assert paf.looks_like_paf(("#c\n" + LINES[0]).encode()) and not paf.looks_like_paf(b"a\tb\n")


def test_a_line_is_split_once(spark, tmp_path):
    """A filter on `valid` doesn't have a line split again for each field that it looks at."""
    parsed = paf.parse(paf.read_lines(spark, write(tmp_path / "x.paf", "\n".join([*LINES, " \t \r", "q3\t9\t0\t9\t-\tt2\t9\t+1\t9\t9\t9\t60", "q4\t9\t0\t9\t-\tt2\t9\t0\t9\t9\t9\r"]))))
    plan = paf.paf_catalog(parsed.filter("valid"), "qname", "qlen")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [(r.qname, r.valid, r.ts, r.alnlen, r.mapq) for r in parsed.orderBy("line_no").collect()][-2:] == [("q3", False, None, 9, "60"), ("q4", False, 0, 9, None)] and parsed.count() == 7


def test_intake(spark, tmp_path):
    a, b, c = write(tmp_path / "a.fa", ">x\nACGT\n"), write(tmp_path / "b", ">y\nACGT\n"), write(tmp_path / "c", LINES[0] + "\n")
    got = intake.route(spark, [a, b, c])
    assert (got.target, got.query, got.paf) == (a, [b], c)
    with pytest.raises(EngineError, match="PAF"):
        intake.fasta_slot(spark, c)
    with pytest.raises(EngineError):
        intake.kind_of(spark, write(tmp_path / "d", "???"))


def test_gzip():
    assert binary.gunzip(b"plain") == b"plain"
    assert binary.gunzip(gzip.compress(b"one ") + gzip.compress(b"two")) == b"one two"
    with pytest.raises(EngineError):
        binary.gunzip(gzip.compress(b"x" * 99)[:-12])


def twobit(seqs):
    head, body, at = struct.pack("<4I", binary.TWOBIT, 0, len(seqs), 0), b"", 16 + sum(5 + len(n) for n in seqs)
    for name, s in seqs.items():
        head += bytes([len(name)]) + name.encode() + struct.pack("<I", at + len(body))
        runs, i = [], 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] == "N":
                j += 1
            if j > i:
                runs.append((i, j - i))
            i = max(j, i + 1)
        packed = bytes(sum(binary.BASES.index(c if c != "N" else "T") << 6 - 2 * k for k, c in enumerate(s[i : i + 4])) for i in range(0, len(s), 4))
        body += struct.pack(f"<2I{2 * len(runs)}I", len(s), len(runs), *[a for a, _ in runs], *[n for _, n in runs]) + struct.pack("<4I", 1, 2, 3, 0) + packed
    return head + body


def test_twobit(spark, tmp_path):
    seqs = {"a": "ACGTACGTNNNNACGTAC", "b": "TTTTCCCCAAAAGGGGT"}
    data = twobit(seqs)
    file = binary.TwoBit(data)
    for name, s in seqs.items():
        assert all(file.region(name, i, j) == s[max(0, i) : j] for i in range(-1, len(s)) for j in range(max(i, 0), len(s) + 3))
    rows = binary.read_twobit(spark, write(tmp_path / "x.2bit", data), [("a", 6, 14), ("b", 0, 4)]).collect()
    assert {tuple(r) for r in rows} == {("a", 6, "GTNNNNAC"), ("b", 0, "TTTT")}
    for bad in (data[:8], b"x" * 20, struct.pack("<4I", binary.TWOBIT, 1, 0, 0)):
        with pytest.raises(EngineError):
            binary.TwoBit(bad)
    with pytest.raises(EngineError):
        file.region("z", 0, 1)


def bigbed(items, compress=True):
    """Two chromosomes, a tree with an inner node, a block for each item."""
    chroms = {"chrA": (0, 5000), "chrB": (1, 3000)}
    tree, key = 64, 4
    leaf = struct.pack("<BBH", 1, 0, 2) + b"".join(n.encode() + struct.pack("<2I", *v) for n, v in chroms.items())
    out = struct.pack("<4I2Q", binary.CHROM_TREE, 2, key, 8, 2, 0) + struct.pack("<BBH", 0, 0, 1) + b"chrA" + struct.pack("<Q", tree + 32 + 16) + leaf
    blocks, at = [], tree + len(out)
    for c, s, e, rest in items:
        raw = struct.pack("<3I", chroms[c][0], s, e) + rest.encode() + b"\0"
        raw = zlib.compress(raw) if compress else raw
        blocks.append((chroms[c][0], s, e, at, len(raw)))
        out, at = out + raw, at + len(raw)
    index = at
    bounds = (blocks[0][0], min(b[1] for b in blocks), blocks[-1][0], max(b[2] for b in blocks))
    out += struct.pack("<2IQ4IQ2I", binary.RTREE, 2, len(blocks), *bounds, 0, 1, 0) + struct.pack("<BBH", 0, 0, 1) + struct.pack("<4IQ", 0, 0, 1, 9999, index + 48 + 4 + 24)
    out += struct.pack("<BBH", 1, 0, len(blocks)) + b"".join(struct.pack("<4I2Q", c, s, c, e, o, n) for c, s, e, o, n in blocks)
    head = struct.pack("<IHH3QHH2QII", binary.BIGBED, 4, 0, tree, 0, index, 9, 9, 0, 0, 1000 if compress else 0, 0)
    return head.ljust(64, b"\0") + out


@pytest.mark.parametrize("compress", [True, False])
def test_bigbed(spark, tmp_path, compress):
    data = bigbed([("chrA", 100, 200, "g1\t0\t+\t0\t0\t255,0,0"), ("chrA", 1000, 1100, "g2\t0\t-\t0\t0\t0"), ("chrB", 5, 9, "g3\t0\t.\t0\t0\t1,2,3")], compress)
    file = binary.BigBed(data)
    assert file.query("chrA", 0, 5000) == [(100, 200, "g1", "+", "255,0,0"), (1000, 1100, "g2", "-", None)]
    assert file.query("chrA", 200, 1000) == [] and file.query("chrB", 8, 9)[0][2] == "g3" and file.query("chrC", 0, 9) == []
    rows = binary.read_bigbed(spark, write(tmp_path / "x.bb", data), [("chrA", 0, 150), ("chrA", 120, 300)]).collect()
    assert [tuple(r) for r in rows] == [("chrA", 100, 200, "g1", "+", "255,0,0")]
    with pytest.raises(EngineError):
        binary.BigBed(b"\0" * 80)


def test_bed(spark, tmp_path):
    rows = binary.read_bed(spark, write(tmp_path / "x.bed", "track x\nchr1\t1\t5\nchr1\t2\t9\tn\t0\t+\t0\t0\t1,2,3\n")).collect()
    assert {tuple(r) for r in rows} == {("chr1", 1, 5, None, None, None), ("chr1", 2, 9, "n", "+", "1,2,3")}


def test_lengths(spark):
    cases = {"1,500": 1500, "2.5 kb": 2500, "1M": 1e6, ".5g": 5e8, "7bp": 7, "x": None, "": None, "5 q": None, "1.2.3": None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", grammar.parse_bp_column(F.col("t")).alias("v")).collect()
    for r in rows:
        want = cases[r.t]
        assert r.v == want and (math.isnan(grammar.parse_bp(r.t)) if want is None else grammar.parse_bp(r.t) == want)


def test_regions():
    cat = [grammar.Record("chr1", 0, 1000), grammar.Record("a:b", 1000, 1500), grammar.Record("s", 1500, 2500, 10_000)]
    go = lambda t: (r := grammar.resolve_region(t, cat)) and r[:2]
    assert go("CHR1") == (0, 1000) and go("a:b") == (1000, 1500) and go("chr1:100-0.2k") == (100, 200) and go("s:10,100–10,300") == (1600, 1800) and go("s:10-20") == (1510, 1520)
    assert go("5-10") == (5, 10) and go("chr1:500-99k") == (500, 1000)
    assert all(go(t) is None for t in ("", "nope", "nope:1-2", "chr1:9-5", "chr1:5", "chr1:x-y", "chr1:2000-3000"))
    assert grammar.parse_browser_region("chrX:57,820,000-60,670,000") == ("chrX", 57_820_000, 60_670_000, None) and grammar.parse_browser_region("chr13P") == ("chr13", None, None, "p")
    assert grammar.parse_browser_region("chr1:0-5") is None and grammar.parse_browser_region("") is None
    assert grammar.window_of(("c", 1, 10, None), 5) == (0, 5) and grammar.window_of(("c", None, None, "q"), 50, (20, 30)) == (30, 50)
    assert grammar.split_regions("chr1:121,700,000-125M,chr8p; x") == ["chr1:121,700,000-125M", "chr8p", "x"] and grammar.split_cross("a b VS. c") == ("a b", "c") and grammar.split_cross(" a ") == ("a", None)


def test_options_and_links():
    assert grammar.parse_sample("off 512M") == ("off", 512e6) and grammar.parse_sample("4") == (4, None) and grammar.parse_sample("auto") == ("auto", None)
    assert grammar.parse_occurrence("0") is None and grammar.parse_budget("4×") == 4 and grammar.parse_budget("off") is None and grammar.parse_budget("999") == 64
    assert grammar.write_link(grammar.Link()) == {}
    link = grammar.Link(k=17, occ=None, sample="off", exact_bp=512e6, budget=4.0, wall=32_000_000)
    assert grammar.write_link(link) == {"k": "17", "occ": "off", "sample": "off 512M", "budget": "4", "wall": "32M"} and grammar.read_link(grammar.write_link(link)) == link
    assert grammar.read_link({"wall": "1M"}).wall == 0 and grammar.read_link({"wall": "999M"}).wall == 64_000_000
    view = grammar.View(1, 200, -3, 40, "2kb", 0.95, "heat", 2, True, False, True)
    assert grammar.read_view(grammar.write_view(view)) == view and grammar.read_view("#v=5-1:0-9") is None and grammar.read_view("x=1") is None


def test_formatting(spark):
    for v, text in ((0, "0 bp"), (999, "999 bp"), (999.6, "1 kb"), (1500, "1.5 kb"), (12_345, "12.3 kb"), (999_600, "1 Mb"), (2.5e9, "2.5 Gb"), (123_456_789, "123 Mb")):
        assert formatting.format_bp(v) == text
        assert spark.range(1).select(formatting.format_bp_column(F.lit(float(v)))).first()[0] == text
    assert formatting.format_tick(24_500_000, 500_000) == "24.5 Mb" and formatting.format_tick(0, 5) == "0" and formatting.format_tick(123_456_789, 10) == "123,456,789"
    assert formatting.format_count(1_240_000) == "1.24 M" and formatting.format_count(87) == "87" and formatting.format_percent(0.0949) == "9.5%" and formatting.format_percent(0.5) == "50%"
    assert formatting.ticks(0, 100, 5) == [0, 20, 40, 60, 80, 100] and formatting.spaced_labels([(0, 5), (4, 9), (8, 12)], 1) == [0, 2]
    assert formatting.flow([(40, 10), (40, 20), (40, 5)], 90, 5) == ([(0, 0), (45, 0), (0, 25)], 30)
    c = formatting.Camera.fit(0, 1000, 0, 500, 100, 100)
    assert c.bounds() == (0, 1000, -250, 750) and c.zoom(0.5, 100, 50).bounds()[1] == 1000


def test_lines_are_numbered_in_order(spark, tmp_path):
    """Over files and over splits of a file."""
    for f in range(3):
        write(tmp_path / f"{f}.paf", "".join(f"{f}\t{i}\t{'x' * (i % 50)}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = paf.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line_no, *map(int, r.value.split("\t")[:2])) for r in got] == [(4000 * f + i, f, i) for f in range(3) for i in range(4000)]


def test_head_of_files(spark, tmp_path):
    text = b">x\n" + b"ACGT" * 100_000
    assert intake.head_of(spark, write(tmp_path / "a", text)) == text[: intake.HEAD]
    packed = intake.head_of(spark, write(tmp_path / "b.gz", gzip.compress(text)))
    assert packed == text[: len(packed)] and len(packed) > 1000


def test_labels():
    assert grammar.regions_label([("chr1", 99, 2000, None)]) == "chr1:100-2,000" and grammar.regions_label([("c", 0, 1, "arm")]) == "arm" and grammar.regions_label([("c", 0, 1, None)] * 2) == "2 regions"
    assert formatting.record_labels(["a", "b"], ["b", "c"]) == ["a", "b (x)", "b (y)", "c"] and formatting.record_region("a", 1000, 0, 5000) == "a:1,001-6,000"


def test_too_many_bases_are_asked_for(spark, tmp_path):
    with pytest.raises(EngineError) as e:
        binary.read_twobit(spark, str(tmp_path), [("a", 0, 400_000_000)])
    assert e.value.remedies == {"confirm": True}
