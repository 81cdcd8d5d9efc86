"""Writers of folders of files, a file for each task, and of single small files, with commit and abort."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from kmerloom.model import EngineError
from kmerloom.sources.ranges import locate

#: Signatures of the formats, and the bases in the order of their codes.
TWOBIT, BIGBED, CHROM_TREE, RTREE = 0x1A412743, 0x8789F2EB, 0x78CA8C91, 0x2468ACE0
BASES = "TCAG"
#: Items of a bigBed data block, and of a node of its trees.
BLOCK_ITEMS, NODE_ITEMS = 512, 256
#: Bytes that are copied at a time.
COPY = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class FolderWriter(DataSourceWriter):
    """Tasks write beside the folder; files go into it when all tasks are done, and away if one fails. A task that runs twice leaves one file: the other's isn't committed."""

    SUFFIX = ""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.path, self.overwrite, self.run = dict(options), options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        files, place = locate(self.path)
        if files.get_file_info(place).type != arrow_fs.FileType.NotFound and not overwrite:
            raise EngineError(f"{self.path} exists.")

    def content(self, rows: Iterator) -> Iterator[bytes]:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        files, place = locate(self.path)
        task, n = TaskContext.get(), [0]

        def counted() -> Iterator:
            for row in iterator:
                n[0] += 1
                yield row

        files.create_dir(f"{place}.{self.run}")
        name = f"{place}.{self.run}/part-{task.partitionId():05d}-{task.taskAttemptId()}{self.SUFFIX}"
        with files.open_output_stream(name, compression=None) as out:
            for piece in self.content(counted()):
                out.write(piece)
        return Written(name, n[0])

    def commit(self, messages: list) -> None:
        files, place = locate(self.path)
        if self.overwrite and (kind := files.get_file_info(place).type) != arrow_fs.FileType.NotFound:
            files.delete_dir(place) if kind == arrow_fs.FileType.Directory else files.delete_file(place)
        self.put(files, place, [m for m in messages if m is not None])
        self._clear(files, place)

    def put(self, files: arrow_fs.FileSystem, place: str, written: list[Written]) -> None:
        files.create_dir(place)
        for m in written:
            files.move(m.path, f"{place}/{m.path.rsplit('/', 1)[1]}")

    def abort(self, messages: list) -> None:
        self._clear(*locate(self.path))

    def _clear(self, files: arrow_fs.FileSystem, place: str) -> None:
        if files.get_file_info(f"{place}.{self.run}").type == arrow_fs.FileType.Directory:
            files.delete_dir(f"{place}.{self.run}")


def twobit_file(records: list[tuple[str, str]]) -> Iterator[bytes]:
    """A 2bit file of records, name and sequence (A, C, G, T; all else is unknown)."""
    codes = np.full(256, 0, np.uint8)
    for i, c in enumerate(BASES):
        codes[ord(c)] = codes[ord(c.lower())] = i
    known = np.zeros(256, bool)
    known[[ord(c) for c in BASES + BASES.lower()]] = True
    bodies = []
    for _, seq in records:
        raw = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
        gaps = np.diff(np.concatenate([[0], (~known[raw]).astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(gaps > 0), np.flatnonzero(gaps < 0)
        quads = np.zeros((len(raw) + 3) // 4 * 4, np.uint8)
        quads[: len(raw)] = codes[raw]
        packed = (quads.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
        bodies.append(struct.pack("<2I", len(raw), len(starts)) + starts.astype("<u4").tobytes() + (ends - starts).astype("<u4").tobytes() + struct.pack("<2I", 0, 0) + packed.tobytes())
    names = [n.encode() for n, _ in records]
    if any(len(n) > 255 for n in names):
        raise EngineError("A 2bit name has 255 bytes at most.")
    at = 16 + sum(len(n) + 5 for n in names)
    if at + sum(map(len, bodies)) >= 1 << 32:
        raise EngineError("A 2bit file has 4 GB at most: write more partitions.")
    yield struct.pack("<4I", TWOBIT, 0, len(records), 0)
    for name, body in zip(names, bodies, strict=True):
        yield bytes([len(name)]) + name + struct.pack("<I", at)
        at += len(body)
    yield from bodies


class TwoBitWriter(FolderWriter):
    """Rows: name, seq. A task's records are packed in memory, a quarter of a byte for a base."""

    SUFFIX = ".2bit"

    def content(self, rows: Iterator) -> Iterator[bytes]:
        return twobit_file([(r[0], r[1] or "") for r in rows])


def _levels(leaves: list[bytes], at: int, node_item: int, above) -> tuple[bytes, int]:  # noqa: ANN001
    """Nodes of a tree, the root's first, from items of its leaves: `above` makes an inner item of a node's items and its place. Nodes are as long as if they were full."""
    levels = [[leaves[i : i + NODE_ITEMS] for i in range(0, len(leaves), NODE_ITEMS)] or [[]]]
    while len(levels[0]) > 1:
        below = levels[0]
        levels.insert(0, [list(range(i, min(i + NODE_ITEMS, len(below)))) for i in range(0, len(below), NODE_ITEMS)])
    size = 4 + NODE_ITEMS * node_item
    starts, place = [], at
    for level in levels:
        starts.append(place)
        place += size * len(level)
    out, summaries = [], None
    for depth in range(len(levels) - 1, -1, -1):
        nodes, now = [], []
        for node in levels[depth]:
            leaf = depth == len(levels) - 1
            items = node if leaf else [above(summaries[i], starts[depth + 1] + size * i) for i in node]
            nodes.append((struct.pack("<BBH", leaf, 0, len(items)) + b"".join(items)).ljust(size, b"\0"))
            now.append(items)
        out.insert(0, b"".join(nodes))
        summaries = now
    return b"".join(out), place - at


def bigbed_file(items: Iterable[tuple]) -> Iterator[bytes]:
    """A bigBed file of items: chrom, start, end, name, strand, rgb, in the order of the first three. Packed blocks wait in a file of the task's own disk for the header, which says where they end; in memory are a block, and a row of the index for each."""
    chroms: dict[str, int] = {}
    longest: list[int] = []
    blocks: list[tuple[int, int, int, int]] = []  # chromosome, first start, last end, bytes
    with tempfile.TemporaryFile() as data:

        def close(rows: list[tuple[int, int, int, str]]) -> None:
            raw = zlib.compress(b"".join(struct.pack("<3I", *r[:3]) + r[3].encode() + b"\0" for r in rows))
            blocks.append((rows[0][0], rows[0][1], max(r[2] for r in rows), len(raw)))
            data.write(raw)

        rows, count, before = [], 0, None
        for c, s, e, n, strand, rgb in items:
            if before is not None and (c, s, e) < before:
                raise EngineError("Items of a bigBed file come in the order of chrom, start and end.")
            before = (c, s, e)
            if rows and (len(rows) == BLOCK_ITEMS or c not in chroms):
                close(rows)
                rows = []
            if c not in chroms:
                chroms[c] = len(chroms)
                longest.append(0)
            longest[-1] = max(longest[-1], e)
            rows.append((chroms[c], s, e, f"{n or ''}\t0\t{strand or '.'}\t{s}\t{e}\t{rgb or '0'}"))
            count += 1
        if rows:
            close(rows)
        key = max([1, *(len(c.encode()) for c in chroms)])
        leaves = [c.encode().ljust(key, b"\0") + struct.pack("<2I", i, longest[i]) for c, i in chroms.items()]
        tree, _ = _levels(leaves, 64 + 32, key + 8, lambda below, at: below[0][:key] + struct.pack("<Q", at))
        tree = struct.pack("<4I2Q", CHROM_TREE, NODE_ITEMS, key, 8, len(chroms), 0) + tree
        at, places = 64 + len(tree) + 8, []
        for c, s, e, size in blocks:
            places.append(struct.pack("<4I2Q", c, s, c, e, at, size))
            at += size

        def above(below: list[bytes], place: int) -> bytes:
            ends = [struct.unpack_from("<4I", b) for b in below]
            return struct.pack("<4IQ", *min(e[:2] for e in ends), *max(e[2:] for e in ends), place)

        index, _ = _levels(places, at + 48, 32, above)
        head = struct.pack("<IHH3QHH2QII", BIGBED, 4, 0, 64, 64 + len(tree), at, 9, 9, 0, 0, 1 << 16, 0).ljust(64, b"\0")
        yield head + tree + struct.pack("<Q", count)
        data.seek(0)
        while piece := data.read(COPY):
            yield piece
        yield struct.pack("<2IQ4IQ2I", RTREE, NODE_ITEMS, len(blocks), 0, 0, len(chroms), 0, at, BLOCK_ITEMS, 0) + index


class BigBedWriter(FolderWriter):
    """Rows: chrom, start, end, name, strand, rgb, in the order of the first three."""

    SUFFIX = ".bb"

    def content(self, rows: Iterator) -> Iterator[bytes]:
        return bigbed_file(rows)


class BigBedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigbed_sink"

    def writer(self, schema, overwrite: bool) -> BigBedWriter:  # noqa: ANN001
        return BigBedWriter(self.options, overwrite)


class TwoBitSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "twobit_sink"

    def writer(self, schema, overwrite: bool) -> TwoBitWriter:  # noqa: ANN001
        return TwoBitWriter(self.options, overwrite)


def write_twobit(records: DataFrame, path: str, overwrite: bool = False) -> None:
    """name and seq as a folder of 2bit files, one for each partition."""
    records.sparkSession.dataSource.register(TwoBitSink)
    records.select("name", "seq").write.format("twobit_sink").mode("overwrite" if overwrite else "append").save(path)


def write_bigbed(items: DataFrame, path: str, overwrite: bool = False) -> None:
    """chrom, start, end, name, strand, rgb as a folder of bigBed files, one for each partition, whose rows Spark sorts."""
    items.sparkSession.dataSource.register(BigBedSink)
    items.select("chrom", "start", "end", "name", "strand", "rgb").sortWithinPartitions("chrom", "start", "end").write.format("bigbed_sink").mode("overwrite" if overwrite else "append").save(path)
