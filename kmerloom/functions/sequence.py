"""Sequences and k-mers: column expressions for small jobs and their SQL checks, NumPy over Arrow batches for whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Codes of bytes: A 0, C 1, G 2, T and U 3 in either case, all else 4.
CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i
CODES[[ord("U"), ord("u")]] = 3
#: Multipliers of the 32-bit k-mer hash.
HASH_LOW, HASH_HIGH, HASH_STEP = 0x9E3779B1, 0x85EBCA6B, 0x2B591E5B
WORD32 = 0xFFFFFFFF
HALF_BITS = 26


def normalise(seq: Column) -> Column:
    """Bases in upper case, U as T, anything else N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


#: Of bytes: the base of each letter, and those that are no letters.
LETTER_BASES = bytes.maketrans((LETTERS + LETTERS.upper()).encode(), (("ACGT" * 7)[:26] * 2).encode())
NO_LETTERS = bytes(b for b in range(256) if chr(b) not in LETTERS + LETTERS.upper())


def _letters(text: pa.Array) -> pa.Array:
    # Bytes of letters beyond ASCII are none of A-Z.
    return pa.array([b"" if t is None else t.translate(LETTER_BASES, NO_LETTERS) for t in text.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())


def letters_as_bases(text: Column) -> Column:
    """A stand-in for sequence data: a text's ASCII letters, each as the base at its place in the alphabet mod 4."""
    return F.arrow_udf(_letters, "string")(text)


def _squeeze(seq: bytes) -> bytes:
    return len(seq).to_bytes(8, "little") + pa.compress(seq, "zstd", asbytes=True)


def squeezed_length(data: pa.Buffer) -> int:
    return int.from_bytes(data[:8].to_pybytes(), "little")


def unsqueezed(data: pa.Array) -> pa.Array:
    """The sequences of squeezed_pieces()."""
    return pa.array([None if x is None else pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in data.to_pylist()], pa.binary()).cast(pa.string())


def squeezed_pieces(seq: Column, piece: int, more: int) -> Column:
    """An array of the pieces of a sequence, each of `piece` bases and `more` that follow, in some two bits a base, to be dealt out."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [_squeeze(x[i : i + piece + more]) for i in range(0, max(1, len(x)), piece)] for x in column.cast(pa.binary()).to_pylist()], pa.list_(pa.binary()))

    return F.arrow_udf(run, "array<binary>")(seq)


def text_as_bases(text: Column) -> Column:
    """As letters_as_bases, but what is not a letter stays as N, which no k-mer crosses."""
    return F.translate(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", "0")), LETTERS + "0", ("ACGT" * 7)[:26] + "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def packed(kmer: Column) -> Column:
    """A k-mer as a base-4 number, exact for all k up to 26."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def hash32(kv: Column) -> Column:
    """The 32-bit avalanche hash of a packed k-mer that value sampling uses. Products stay below 2^63."""
    mask = F.lit(WORD32).cast("long")
    low, high = kv % (1 << HALF_BITS), F.floor(kv / (1 << HALF_BITS)).cast("long")
    h = (low * HASH_LOW).bitwiseAND(mask).bitwiseXOR((high * HASH_HIGH).bitwiseAND(mask))
    h = h.bitwiseXOR(F.shiftright(h, 15))
    h = (h * HASH_STEP).bitwiseAND(mask)
    return h.bitwiseXOR(F.shiftright(h, 13))


def hash32_array(kv: np.ndarray) -> np.ndarray:
    kv = kv.astype(np.uint64)
    mask = np.uint64(WORD32)
    h = (((kv & np.uint64((1 << HALF_BITS) - 1)) * np.uint64(HASH_LOW)) & mask) ^ (((kv >> np.uint64(HALF_BITS)) * np.uint64(HASH_HIGH)) & mask)
    h ^= h >> np.uint64(15)
    h = (h * np.uint64(HASH_STEP)) & mask
    return h ^ (h >> np.uint64(13))


def sampled(kv: Column, scaled: int) -> Column:
    """The FracMinHash filter: about 1 in `scaled` distinct k-mers passes."""
    return F.lit(True) if scaled <= 1 else hash32(kv) < (1 << 32) // scaled


def scaled_for(total_bp: int, cap: int) -> int:
    """The least power of two that keeps total_bp / scaled within the cap."""
    scaled = 1
    while total_bp / scaled > cap:
        scaled *= 2
    return scaled


def batch_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a batch's sequences in a row, and where each starts (and the last ends)."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return CODES[raw], at - at[0]


def pack_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """Base-4 numbers of all windows of k codes, by doubling: a window is two that are packed already."""
    size, have = 1, codes.astype(np.int64)
    for bit in bin(k)[3:]:
        have, size = have[: len(have) - size] * 4**size + have[size:], 2 * size
        if bit == "1":
            have, size = have[:-1] * 4 + codes[size : size + len(have) - 1], size + 1
    return have


def windows(codes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Record and first base (within the batch) of each window of k bases inside one record and without N."""
    if len(codes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    record = np.repeat(np.arange(len(at) - 1), np.diff(at))
    last = len(codes) - k + 1
    pos = np.flatnonzero((bad[k:] == bad[:last]) & (record[:last] == record[k - 1 :]))
    return record[pos], pos


def batch_kmers(codes: np.ndarray, at: np.ndarray, k: int, both: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Record, first base within the batch and packed k-mer of all windows; with `both` also the packed reverse complement."""
    record, pos = windows(codes, at, k)
    if not len(pos):
        return record, pos, pos, pos if both else None
    kv = pack_windows(codes, k)[pos]
    rc = pack_windows((3 - np.minimum(codes, 3))[::-1], k)[::-1][pos] if both else None
    return record, pos, kv, rc
