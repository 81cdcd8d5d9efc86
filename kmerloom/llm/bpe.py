"""Byte-level BPE encoding and decoding.

A short piece's merges run on a list of its pairs' ranks, a long one's on a segment tree over its byte positions: each leaf holds the rank of the pair that starts there, each inner node the smaller of its two, so that the root holds the leftmost pair of least rank. A merge changes the live neighbours' leaves, each in as many steps as the tree is high.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import documents, field, only
from kmerloom.llm.textkit import give_back, parts

#: Pieces that a worker remembers: twice so many, the older half goes first. None is longer than so many characters, which bounds their bytes.
REMEMBERED, LONGEST = 200_000, 64
#: Ids that are decoded at a time, and bytes of decoded texts in a batch: Arrow's offsets have 32 bits.
IDS, BATCH_BYTES = 1 << 18, 1 << 29
#: Bytes up to which a piece is merged on a list: its smallest rank is found faster than a tree is kept.
SHORT = 64
NEVER = 1 << 62


def read_ranks(path: str) -> bytes:
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def ranks_of(file: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in file.splitlines() if x)}


def encode_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece, in steps each as long as the piece."""
    rank_of, at = ranks.get, list(range(len(piece) + 1))
    pairs = [rank_of(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) != NEVER:
        i = pairs.index(least)
        del at[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = rank_of(piece[at[i] : at[i + 2]], NEVER)
        if i:
            pairs[i - 1] = rank_of(piece[at[i - 1] : at[i + 1]], NEVER)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:], strict=False)]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece; every single byte has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return encode_short(piece, ranks)
    bits = max(1, (n - 1).bit_length())
    size, low = 1 << bits, (1 << bits) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NEVER] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    rank_of = ranks.get
    while (least := tree[1]) != NEVER:
        i = least & low
        j = after[i]
        end = after[i] = after[j]
        here = there = NEVER
        if end < n:
            before[end] = i
            rank = rank_of(piece[i : after[end]])
            if rank is not None:
                here = rank << bits | i
        changes = [(size + j, NEVER), (size + i, here)]
        if (h := before[i]) >= 0:
            rank = rank_of(piece[h:end])
            if rank is not None:
                there = rank << bits | h
            changes.append((size + h, there))
        for k, value in changes:
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Pieces(dict):
    """Little-endian 32-bit ids of pieces, worked out when first asked for; a bounded number is remembered."""

    def __init__(self, ranks: dict[bytes, int], limit: int = REMEMBERED):
        self.ranks, self.limit, self.older = ranks, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(encode_piece(piece.encode(), self.ranks), "<i4").tobytes()
            if len(piece) > LONGEST:
                return ids
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _pieces(file: bytes) -> Pieces:
    return Pieces(ranks_of(file))


def _encode(text: str, out: str, file, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ids_of = regex.compile(pattern).findall, _pieces(file.value).__getitem__
        for batch in parts(batches):
            ids = [b"".join(map(ids_of, find(x))) if x else b"" for x in batch.column(text).to_pylist()]
            at = np.zeros(len(ids) + 1, np.int64)
            np.cumsum([len(x) // 4 for x in ids], out=at[1:])
            flat = np.frombuffer(b"".join(ids), "<i4")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], names=[*batch.schema.names, out])
        give_back()

    return run


def encode(df: DataFrame, text: str = "text", out: str = "ids", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the array of token ids of each whole text.

    Each match of the pattern is encoded for itself; no special tokens. ranks: path of a rank file, which the driver reads. Null and empty texts have no ids; texts of any length are encoded whole. A column of df with the name `out` is replaced. Repeated rows and empty tables are no special case.
    """
    df = only(df, [text], [out])
    file = df.sparkSession.sparkContext.broadcast(read_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return df.mapInArrow(_encode(text, out, file, pattern), T.StructType([*df.schema.fields, field(out, "array<int>")]))


@lru_cache(maxsize=2)
def _table(file: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each id's begin and how many they are; ids without a token have none."""
    tokens = {i: t for t, i in ranks_of(file).items()}
    sizes = np.zeros(max(tokens, default=-1) + 1, np.int64)
    for i, t in tokens.items():
        sizes[i] = len(t)
    return np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(sizes))), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode_ids(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The bytes of a run of ids."""
    blob, begin, size = table
    lengths = size[ids]
    shift = begin[ids] - (np.cumsum(lengths) - lengths)
    return blob[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def _bounded(batches: Iterator[pa.RecordBatch], ids: str, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Parts of batches that decode to BATCH_BYTES at most, or are one row."""
    for batch in parts(batches):
        column = batch.column(ids)
        at = np.asarray(column.offsets).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes[np.asarray(column.values)[at[0] : at[-1]]])])[at - at[0]]
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BATCH_BYTES, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _decode(ids: str, out: str, file):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(file.value)
        for batch in _bounded(batches, ids, table[2]):
            column = batch.column(ids)
            if column.null_count:
                column = pa.array([x or [] for x in column.to_pylist()], column.type)
            at = np.asarray(column.offsets).astype(np.int64)
            flat = np.asarray(column.values)[at[0] : at[-1]]
            at -= at[0]
            sizes = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(table[2][flat], out=sizes[1:])
            data = np.empty(int(sizes[-1]), np.uint8)
            for lo in range(0, len(flat), IDS):
                hi = min(lo + IDS, len(flat))
                data[sizes[lo] : sizes[hi]] = decode_ids(flat[lo:hi], table)
            texts = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(sizes[at].astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])
        give_back()

    return run


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """df with the bytes (binary; any run of ids need not be whole UTF-8) of each array of ids; a null array has none. A column of df with the name `out` is replaced."""
    df = only(df, [ids], [out])
    file = df.sparkSession.sparkContext.broadcast(read_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return df.mapInArrow(_decode(ids, out, file), T.StructType([*df.schema.fields, field(out, "binary")]))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
