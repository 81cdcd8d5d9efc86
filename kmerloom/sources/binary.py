"""Binary sources: 2bit sequences and bigBed items, read by ranges and dealt out to tasks; the content of gzip data."""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from kmerloom.model import EngineError
from kmerloom.operators.intervals import check_windows
from kmerloom.sources.ranges import Ranges, files_under
from kmerloom.sources.sinks import BASES, BIGBED, CHROM_TREE, RTREE, TWOBIT, write_bigbed, write_twobit

__all__ = ["BigBed", "TwoBit", "gunzip", "read_bed", "read_bigbed", "read_twobit", "twobit_pieces", "write_bigbed", "write_twobit"]

#: Fixed value: the most blocks of a 2bit record that are believed.
MOST_BLOCKS = 10_000_000
#: The four bases of each byte, the first in its high bits.
QUADS = np.array([[ord(BASES[b >> s & 3]) for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)
RGB = re.compile(r"\d{1,3},\d{1,3},\d{1,3}")
#: Bases of a task, bytes of the index and blocks of unknown bases that are read at a time; data blocks less than NEAR bytes apart are read together, up to RUN bytes in a task.
PIECE, INDEX_STEP, BLOCK_STEP, NEAR, RUN = 1 << 21, 1 << 16, 1 << 12, 1 << 16, 4 << 20
#: Bases that a record counts for beside its own where tasks are made, and rows of a batch.
RECORD, ROWS = 256, 1 << 14
BOUNDS = {LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}


def compare(a: int, op: str, b: int) -> bool:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def gunzip(data: bytes) -> bytes:
    """The content of gzip data of one or more members (so BGZF too); other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            raise EngineError(f"Corrupt gzip data: {e}") from None
        if not member.eof:
            raise EngineError("The gzip data ends inside a member.")
        data = member.unused_data
    return b"".join(out)


class TwoBit:
    """Sequences of a 2bit file (version 0, little-endian), or of its bytes. Only what is asked for is read: the index once, of a sequence some bytes and those blocks of unknown bases that a region may touch, a quarter of a byte for each base."""

    def __init__(self, source: str | bytes, at: dict[str, int] | None = None):
        """at: places of the sequences that are wanted, where they are known; the index then isn't read."""
        self.file = Ranges(source)
        if at is not None:
            self.at = at
            return
        head = self.file.read(0, 16)
        if len(head) < 16:
            raise EngineError("Not a 2bit file: too short for a header.")
        signature, version, self.count, _ = struct.unpack("<4I", head)
        if signature != TWOBIT:
            raise EngineError("Not a little-endian 2bit file.")
        if version:
            raise EngineError(f"2bit version {version} is not supported.")
        self.at: dict[str, int] = {}
        place, data, begin = 16, b"", 16
        for _ in range(self.count):
            if len(data) < place - begin + 260:  # the longest entry: a byte, 255 of a name, four of a place
                begin, data = place, self.file.read(place, INDEX_STEP)
            own = data[place - begin :]
            if not own or len(own) < own[0] + 5:
                raise EngineError("The 2bit file ends inside its index.")
            self.at[own[1 : own[0] + 1].decode()] = struct.unpack_from("<I", own, own[0] + 1)[0]
            place += own[0] + 5

    def _number(self, place: int) -> int:
        return struct.unpack("<I", self.file.exact(place, 4, "a 2bit record"))[0]

    def size(self, name: str) -> int:
        if name not in self.at:
            raise EngineError(f"The 2bit file has no sequence {name}.")
        return self._number(self.at[name])

    def _count(self, place: int) -> int:
        n = self._number(place)
        if n > MOST_BLOCKS:
            raise EngineError("The 2bit record has too many blocks.")
        return n

    def _unknown(self, place: int, n: int, start: int, end: int) -> list[tuple[int, int]]:
        """Blocks of unknown bases that may touch [start, end). Their starts rise: the last one up to `start` is found by halving, what follows is read until it lies beyond."""
        lo, hi = 0, n
        while hi - lo > BLOCK_STEP:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._number(place + 4 * mid) <= start else (lo, mid)
        out = []
        for first in range(lo, n, BLOCK_STEP):
            m = min(BLOCK_STEP, n - first)
            starts, sizes = (np.frombuffer(self.file.exact(place + 4 * at, 4 * m, "a 2bit record"), "<u4").astype(int) for at in (first, n + first))
            out += [(int(s), int(z)) for s, z in zip(starts, sizes, strict=True) if s < end and s + z > start]
            if starts[-1] >= end:
                break
        return out

    def region(self, name: str, start: int, end: int) -> str:
        """Bases [start, end), within the sequence; N where the file says so. Masks are not looked at."""
        total = self.size(name)
        start, end = max(0, start), min(end, total)
        place = self.at[name] + 4
        n = self._count(place)
        packed = place + 8 + 8 * n + 8 * self._count(place + 4 + 8 * n) + 4
        if end <= start:
            return ""
        first = start // 4
        raw = np.frombuffer(self.file.exact(packed + first, (end + 3) // 4 - first, "a 2bit record"), np.uint8)
        out = QUADS[raw].ravel()[start - 4 * first :][: end - start].copy()
        for begin, length in self._unknown(place + 4, n, start, end) if n else []:
            out[max(begin, start) - start : max(0, min(begin + length, end) - start)] = ord("N")
        return out.tobytes().decode()


class BigBed:
    """Items of a bigBed file (little-endian), or of its bytes. The trees are read node by node, as far as a window leads."""

    def __init__(self, source: str | bytes):
        self.file = Ranges(source)
        head = self.file.read(0, 64)
        if len(head) < 64 or struct.unpack_from("<I", head)[0] != BIGBED:
            raise EngineError("Not a little-endian bigBed file.")
        self.tree, _, self.index = struct.unpack_from("<3Q", head, 8)
        _, self.fields = struct.unpack_from("<2H", head, 32)
        (self.buffer,) = struct.unpack_from("<I", head, 52)
        self.chroms: dict[str, tuple[int, int]] = {}
        magic, _, self.key = struct.unpack("<3I", self.file.exact(self.tree, 12, "its chromosome tree"))
        if magic != CHROM_TREE:
            raise EngineError("The bigBed file's chromosome tree is corrupt.")
        if struct.unpack("<I", self.file.exact(self.index, 4, "its index"))[0] != RTREE:
            raise EngineError("The bigBed file's index is corrupt.")
        for leaf, item in self._walk(self.tree + 32, self.key + 8, self.key + 8, lambda item: struct.unpack_from("<Q", item, self.key)[0]):
            if leaf:
                self.chroms[item[: self.key].split(b"\0")[0].decode()] = struct.unpack_from("<2I", item, self.key)

    def _walk(self, root: int, leaf_size: int, inner_size: int, child: Callable[[bytes], int | None]) -> Iterator[tuple[bool, bytes]]:
        """Items of a tree's leaves, below the inner items whose child is not None."""
        nodes, seen = [root], set()
        while nodes:
            node = nodes.pop()
            if node in seen:
                raise EngineError("A tree of the bigBed file has a loop.")
            seen.add(node)
            leaf, _, count = struct.unpack("<BBH", self.file.exact(node, 4, "a tree"))
            size = leaf_size if leaf else inner_size
            body = self.file.exact(node + 4, count * size, "a tree")
            for i in range(count):
                item = body[i * size : (i + 1) * size]
                if leaf:
                    yield True, item
                elif (below := child(item)) is not None:
                    nodes.append(below)

    def blocks(self, chrom: int, start: int, end: int) -> list[tuple[int, int]]:
        """Place and size of the data blocks that may hold items of a window."""

        def touches(item: bytes) -> bool:
            c0, b0, c1, b1 = struct.unpack_from("<4I", item)
            return (c0, b0) < (chrom, end) and (c1, b1) > (chrom, start)

        inner = lambda item: struct.unpack_from("<Q", item, 16)[0] if touches(item) else None
        return sorted({struct.unpack_from("<2Q", item, 16) for _, item in self._walk(self.index + 48, 32, 24, inner) if touches(item)})

    def items(self, offset: int, end: int, parts: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, str | None, str | None, str | None]]:
        """Chromosome, start, end, name, strand and rgb of all items of the blocks `parts`, which lie in [offset, end): one request. What the file's fields don't hold is None."""
        data = self.file.exact(offset, end - offset, "a data block")
        for at, size in parts:
            raw = data[at - offset : at - offset + size]
            try:
                raw = zlib.decompress(raw) if self.buffer else raw
            except zlib.error as e:
                raise EngineError(f"A data block of the bigBed file is corrupt: {e}") from None
            place = 0
            while place + 12 <= len(raw):
                c, s, e = struct.unpack_from("<3I", raw, place)
                stop = raw.find(b"\0", place + 12)
                stop = len(raw) if stop < 0 else stop
                text = [*raw[place + 12 : stop].decode().split("\t"), *[""] * 6]
                place = stop + 1
                rgb = text[5] if self.fields >= 9 and RGB.fullmatch(text[5]) else None
                yield c, s, e, text[0] if self.fields >= 4 else None, text[2] if self.fields >= 6 else None, rgb

    def query(self, chrom: str, start: int, end: int) -> list[tuple[int, int, str | None, str | None, str | None]]:
        """start, end, name, strand, rgb of items that overlap [start, end), by start."""
        if chrom not in self.chroms:
            return []
        number, found = self.chroms[chrom][0], []
        for run in joined(self.blocks(number, start, end)):
            found += [x[1:] for x in self.items(*run) if x[0] == number and x[1] < end and x[2] > start]
        return sorted(found, key=lambda x: x[0])


def joined(blocks: list[tuple[int, int]], most: int | None = None) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted blocks in runs that one request reads: begin, end and blocks. Blocks less than NEAR apart are in one run, of up to `most` bytes where that is given."""
    runs: list[list] = []
    for at, size in blocks:
        if runs and at - runs[-1][1] < NEAR and (most is None or at + size - runs[-1][0] <= most):
            runs[-1][1] = max(runs[-1][1], at + size)
            runs[-1][2].append((at, size))
        else:
            runs.append([at, at + size, [(at, size)]])
    return [tuple(x) for x in runs]


@dataclass
class Spans(InputPartition):
    """Parts of regions of a file, which the task cuts into pieces: the region's number, name, place in the file and start, and the bases to read."""

    path: str
    spans: list[tuple[int, str, int, int, int, int]]


class TwoBitReader(DataSourceReader):
    """Plans tasks of `task` bases, and of one piece where that is less."""

    def __init__(self, options: dict):
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))
        self.task = int(options.get("task", PIECE if self.piece >= PIECE else 0))
        self.regions = [(n, int(s), int(e)) for n, s, e in json.loads(options["regions"])] if "regions" in options else None
        self.names: set[str] | None = None
        self.bounds: list[tuple[str, str, int]] = []

    def wanted(self, start: int, end: int) -> bool:
        return all(compare({"start": start, "end": end}[c], op, v) for c, op, v in self.bounds)

    def partitions(self) -> list[Spans]:
        paths = [p for p, _ in files_under(self.path)]
        # A span is some pieces of a region; where it is one, it may be left out here.
        out, seen, step = [], set(), max(1, self.task // self.piece) * self.piece
        for path in paths:
            file, spans, bases = TwoBit(path), [], 0
            asked = self.regions if self.regions is not None else [(n, 0, 1 << 62) for n in file.at]
            for i, (name, start, end) in enumerate(asked):
                if (self.names is not None and name not in self.names) or (len(paths) > 1 and name not in file.at) or i in seen and self.regions is not None:
                    continue
                seen.add(i)
                begin, end = max(0, start), min(end, file.size(name))
                # A region without bases is a piece without bases.
                for at in range(begin, max(end, begin + 1), step):
                    stop = max(at, min(end, at + step))
                    if step == self.piece and not self.wanted(at, stop):
                        continue
                    if spans and bases + stop - at + RECORD > self.task:
                        out.append(Spans(path, spans))
                        spans, bases = [], 0
                    spans.append((i, name, file.at[name], begin, at, stop))
                    bases += stop - at + RECORD
            if spans:
                out.append(Spans(path, spans))
            file.file.close()
        if len(paths) > 1 and self.regions is not None and (lost := [r[0] for i, r in enumerate(self.regions) if i not in seen and (self.names is None or r[0] in self.names)]):
            raise EngineError(f"No 2bit file of the folder has a sequence {lost[0]}.")
        return out

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        file = TwoBit(partition.path, {name: place for _, name, place, *_ in partition.spans})
        kinds, rows, size = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["region", "name", "begin", "start", "end", "seq", "bytes_read"])

        for region, name, _, begin, start, end in partition.spans:
            for at in range(start, max(end, start + 1), self.piece):
                stop = min(end, at + self.piece)
                if self.wanted(at, stop):
                    rows.append((region, name, begin, at, stop, file.region(name, at, stop), file.file.bytes_read))
                    size += stop - at
                if size >= PIECE or len(rows) >= ROWS:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()
        file.file.close()


class FilteringTwoBitReader(TwoBitReader):
    """Filters on name, and bounds on start and end, leave pieces out before anything is read; Spark applies them again to the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("name",) and isinstance(f, EqualTo | In):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            elif column in (("start",), ("end",)) and type(f) in BOUNDS:
                self.bounds.append((column[0], BOUNDS[type(f)], f.value))
            yield f


class TwoBitSource(DataSource):
    """Format `twobit`: region, name, begin (of the region), start, end, seq and bytes_read (by the task) of pieces. Options: path (a file, or a folder of files that each hold some sequences); regions, a JSON list of [name, start, end] (all sequences without it); piece; task (bases of a task, which takes neighbouring pieces up to so many); filters (true where spark.sql.python.filterPushdown.enabled is: without that setting Spark refuses readers that take filters)."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "region long, name string, begin long, start long, end long, seq string, bytes_read long"

    def reader(self, schema) -> TwoBitReader:  # noqa: ANN001
        return (FilteringTwoBitReader if self.options.get("filters") == "true" else TwoBitReader)(self.options)


@dataclass
class Run(InputPartition):
    """Data blocks of a file that one request reads."""

    path: str
    begin: int
    end: int
    parts: list


class BigBedReader(DataSourceReader):
    """The plan walks the trees for each window. Windows of a chromosome are put together first, so a block that several want is read once, and its items are told apart from the windows they overlap in one place."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("most", RUN))
        self.windows: dict[str, list[tuple[int, int]]] = {}
        for chrom, start, end in sorted((c, int(s), int(e)) for c, s, e in json.loads(options["windows"])):
            own = self.windows.setdefault(chrom, [])
            if own and start <= own[-1][1]:
                own[-1] = (own[-1][0], max(end, own[-1][1]))
            elif end > start:
                own.append((start, end))

    def partitions(self) -> list[Run]:
        out = []
        for path, _ in files_under(self.path):
            file = BigBed(path)
            blocks = {b for chrom, windows in self.windows.items() if chrom in file.chroms for s, e in windows for b in file.blocks(file.chroms[chrom][0], s, e)}
            file.file.close()
            out += [Run(path, *run) for run in joined(sorted(blocks), self.most)]
        return out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        file = BigBed(partition.path)
        names = {v[0]: k for k, v in file.chroms.items()}
        ends = {c: ([s for s, _ in w], [e for _, e in w]) for c, w in self.windows.items()}
        kinds, rows = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chrom", "start", "end", "name", "strand", "rgb", "bytes_read"])

        for number, s, e, *rest in file.items(partition.begin, partition.end, partition.parts):
            chrom = names.get(number)
            if chrom in ends:
                # Windows don't touch each other: the first that ends after the item's start decides.
                i = bisect_right(ends[chrom][1], s)
                if i < len(ends[chrom][0]) and ends[chrom][0][i] < e:
                    rows.append((chrom, s, e, *rest, file.file.bytes_read))
                    if len(rows) >= ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()
        file.file.close()


class BigBedSource(DataSource):
    """Format `bigbed`: chrom, start, end, name, strand, rgb and bytes_read (by the task) of the items that overlap a window, each once. Options: path (a file or a folder of them); windows, a JSON list of [chrom, start, end]; most, bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "bigbed"

    def schema(self) -> str:
        return "chrom string, start long, end long, name string, strand string, rgb string, bytes_read long"

    def reader(self, schema) -> BigBedReader:  # noqa: ANN001
        return BigBedReader(self.options)


def twobit_pieces(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, confirm: bool = False, piece: int = PIECE, task: int | None = None) -> DataFrame:
    """Regions of a 2bit file (all sequences without them) as pieces: region, name, begin, start, end, seq, bytes_read. A task takes pieces up to `task` bases: PIECE unless pieces are smaller than that, then one piece. Regions of more than 300 Mb want to be confirmed."""
    spark.dataSource.register(TwoBitSource)
    reader = spark.read.format("twobit").option("piece", piece).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if task is not None:
        reader = reader.option("task", task)
    if regions is not None:
        check_windows(sum(max(0, e - s) for _, s, e in regions), confirm)
        reader = reader.option("regions", json.dumps(regions))
    return reader.load(path)


def read_twobit(spark: SparkSession, path: str, regions: list[tuple[str, int, int]], confirm: bool = False, piece: int = PIECE) -> DataFrame:
    """name, offset (the region's start) and seq of each region, read in pieces and put together."""
    pieces = twobit_pieces(spark, path, regions, confirm, piece)
    whole = pieces.groupBy("region", "name", "begin").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "seq"))), lambda p: p["seq"]), "").alias("seq"))
    return whole.select("name", F.col("begin").alias("offset"), "seq")


def read_bigbed(spark: SparkSession, path: str, windows: list[tuple[str, int, int]], most: int | None = None) -> DataFrame:
    """chrom, start, end, name, strand, rgb of items in the windows; an item in two windows comes once, items that are equal in the file come as often as they are there."""
    spark.dataSource.register(BigBedSource)
    return spark.read.format("bigbed").option("windows", json.dumps(windows)).option("most", most or RUN).load(path).drop("bytes_read")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED text with 3 to 9 columns."""
    p = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    get = lambda i: F.get(p, F.lit(i))
    rows = spark.read.text(path).filter(~F.col("value").rlike("^(#|track|browser|\\s*$)"))
    return rows.select(get(0).alias("chrom"), get(1).cast("long").alias("start"), get(2).cast("long").alias("end"), get(3).alias("name"), get(5).alias("strand"), F.when(get(8).rlike("^[0-9]{1,3},[0-9]{1,3},[0-9]{1,3}$"), get(8)).alias("rgb"))
