"""BGZF as a splittable source and as a sink: gzip in blocks of up to 64 KB, each of which says how long it is.

A file is dealt out in ranges of bytes. A task finds the first block of its range by itself (headers that lead from one to the next), so no index is made beforehand; records begin where a separator does, and one that goes on beyond a range is read to its end by the task that has its beginning.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kmerloom.model import EngineError
from kmerloom.sources.ranges import Ranges, files_under
from kmerloom.sources.sinks import FolderWriter

#: How a block begins, what most blocks hold, and the empty block that ends a file.
MAGIC = b"\x1f\x8b\x08\x04"
MOST, PAYLOAD = 1 << 16, 0xFF00
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
CORRUPT = "Corrupt BGZF block table: compress the file with bgzip again."
#: Compressed bytes of a range, bytes that are asked for at a time, headers that must lead to each other before a place counts as a block's.
SPLIT, AHEAD, CHAIN = 32 << 20, 1 << 20, 4
ROWS, TEXT = 4096, 16 << 20


class Window:
    """A file of which the part read last is at hand, so that headers one after the other cost no request each."""

    def __init__(self, file: Ranges, ahead: int = AHEAD):
        self.file, self.ahead, self.at, self.data = file, ahead, 0, b""

    def get(self, at: int, size: int) -> bytes:
        if not (self.at <= at and at + size <= self.at + len(self.data)):
            self.at, self.data = at, self.file.read(at, max(size, self.ahead))
        return self.data[at - self.at : at - self.at + size]


def block_size(window: Window, at: int) -> tuple[int, int] | None:
    """Bytes of the block at a place, and of its header; None where there is no block."""
    head = window.get(at, 12)
    if len(head) < 12 or head[:4] != MAGIC:
        return None
    extra = window.get(at + 12, struct.unpack_from("<H", head, 10)[0])
    place = 0
    while place + 4 <= len(extra):
        tag, size = extra[place : place + 2], struct.unpack_from("<H", extra, place + 2)[0]
        if tag == b"BC" and size == 2 and place + 6 <= len(extra):
            total = struct.unpack_from("<H", extra, place + 4)[0] + 1
            return (total, 12 + len(extra)) if total > 12 + len(extra) + 8 or total == len(END) else None
        place += 4 + size
    return None


def unpacked(window: Window, at: int, size: int, header: int) -> bytes:
    """The content of a block, checked against its length and its checksum."""
    block = window.get(at, size)
    if len(block) < size:
        raise EngineError(CORRUPT)
    crc, length = struct.unpack_from("<2I", block, size - 8)
    try:
        out = zlib.decompress(block[header : size - 8], -15, max(1, length))
    except zlib.error as e:
        raise EngineError(f"{CORRUPT} ({e})") from None
    if len(out) != length or zlib.crc32(out) != crc:
        raise EngineError(CORRUPT)
    return out


def first_block(window: Window, start: int, end: int) -> int | None:
    """Where the first block at or after `start`, and before `end`, begins. A place counts if a chain of headers leads on from it, or to the file's end."""
    if start == 0:
        return 0
    at = start
    while at < end:
        data = window.get(at, min(MOST, end - at) + 3)
        found = data.find(MAGIC)
        if found < 0:
            at += max(1, len(data) - 3)
            continue
        at += found
        if at >= end:
            return None
        place, links = at, 0
        while links < CHAIN and place < window.file.size and (size := block_size(window, place)):
            place, links = place + size[0], links + 1
        if links == CHAIN or (links and place == window.file.size):
            return at
        at += 1
    return None


def blocks(window: Window, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the blocks from `at` to the file's end."""
    while at < window.file.size:
        size = block_size(window, at)
        if size is None:
            raise EngineError(CORRUPT)
        yield at, unpacked(window, at, *size)
        at += size[0]


def records(file: Ranges, start: int, end: int, separator: bytes, ahead: int = AHEAD) -> Iterator[bytes]:
    """The records of a range: the one that the file begins with, and those whose separator begins in a block that begins in the range. What lies after the last separator is a record unless it is empty."""
    window = Window(file, ahead)
    at = first_block(window, start, min(end, file.size))
    if at is None:
        return
    buffer, scan = bytearray(), 0
    own = None  # how many bytes of `buffer` are of blocks of the range; None while they still come
    begun = start == 0  # whether `buffer` begins with a record of this range
    for place, content in blocks(window, at):
        if place >= end and own is None:
            own = len(buffer)
        buffer += content
        while True:
            cut = buffer.find(separator, scan)
            if cut < 0 and own is None and len(buffer) >= len(separator):
                # What can't be the start of a separator needn't be looked at again, nor kept where no record has begun.
                scan = len(buffer) - len(separator) + 1
                if not begun:
                    del buffer[:scan]
                    scan = 0
                break
            if cut < 0:
                scan = max(scan, len(buffer) - len(separator) + 1)
                if own is not None and not begun and scan >= own:
                    return
                break
            if begun:
                yield bytes(buffer[:cut])
            if own is not None and cut >= own:
                return
            begun = True
            gone = cut + len(separator)
            del buffer[:gone]
            scan, own = 0, None if own is None else own - gone
    if begun and buffer:
        yield bytes(buffer)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class BgzfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.separator = options["path"], options.get("lineSep", "\n").encode()
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[Part]:
        out = []
        for path, size in files_under(self.path):
            out += [Part(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        def batch(values: list[bytes]) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n, pa.string()), pa.array([partition.start] * n, pa.int64()), pa.array([v.decode("utf-8", "replace") for v in values], pa.string())], names=["file", "block", "value"])

        with Ranges(partition.path) as file:
            rows, size = [], 0
            for value in records(file, partition.start, partition.end, self.separator, min(AHEAD, max(MOST, self.split))):
                rows.append(value)
                size += len(value)
                if len(rows) >= ROWS or size >= TEXT:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def packed(data: bytes, level: int = 6) -> bytes:
    """One block."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<2I", zlib.crc32(data), len(data))


class BgzfWriter(FolderWriter):
    """A file for each task, rows in order, each with the separator after it."""

    SUFFIX = ".gz"

    def content(self, rows: Iterator) -> Iterator[bytes]:
        separator, buffer = self.options.get("linesep", self.options.get("lineSep", "\n")).encode(), bytearray()
        for row in rows:
            buffer += row[0].encode() + separator if row[0] is not None else b""
            while len(buffer) >= PAYLOAD:
                yield packed(bytes(buffer[:PAYLOAD]))
                del buffer[:PAYLOAD]
        if buffer:
            yield packed(bytes(buffer))
        yield END


class Bgzf(DataSource):
    """Format `bgzf`. Read: file, block (the range's first byte) and value, in order inside a range; options path, lineSep, split (compressed bytes of a range). Write: one text column."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "file string, block long, value string"

    def reader(self, schema) -> BgzfReader:  # noqa: ANN001
        return BgzfReader(self.options)

    def writer(self, schema, overwrite: bool) -> BgzfWriter:  # noqa: ANN001
        return BgzfWriter(self.options, overwrite)


def is_bgzf(head: bytes) -> bool:
    """Whether a file's first bytes are those of a block."""
    return block_size(Window(Ranges(head)), 0) is not None


def read_bgzf(spark: SparkSession, path: str, separator: str = "\n", split: int = SPLIT) -> DataFrame:
    """Records of a BGZF file, or of a folder of them, by many tasks: file, block, value."""
    spark.dataSource.register(Bgzf)
    return spark.read.format("bgzf").option("lineSep", separator).option("split", split).load(path)


def split_for(path: str, tasks: int) -> int:
    """Compressed bytes of a range that deal a file, or a folder, out to about so many tasks: a block's at least, SPLIT at most."""
    return max(MOST, min(SPLIT, -(-sum(size for _, size in files_under(path)) // max(1, tasks))))


def write_bgzf(text: DataFrame, path: str, separator: str = "\n", overwrite: bool = False) -> None:
    """The one text column of a table as a folder of BGZF files, one for each partition, rows in order."""
    text.sparkSession.dataSource.register(Bgzf)
    text.write.format("bgzf").option("lineSep", separator).mode("overwrite" if overwrite else "append").save(path)
