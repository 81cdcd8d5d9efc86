"""Sharding by jump consistent hashing, in DataFrame functions alone.

A row's shard depends on its key and the number of shards (law `key`): no ring table, and one more shard takes rows only into itself, the fraction 1/(n+1) of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import documents, key_range, only, random_key, range_bits, running_total

#: Fixed value: the multiplier of the generator in Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014).
MULTIPLIER = 2862933555777941757
#: Steps of the generator. A key makes about ln(shards) jumps; a key that made more would raise an error, not get a wrong shard.
STEPS = 160
LOW = 0xFFFFFFFF


def _times_plus_one(high: Column, low: Column) -> tuple[Column, Column]:
    """(key * MULTIPLIER + 1) mod 2^64 on 32-bit halves in longs, so that nothing overflows under ANSI rules."""
    m0, m1, m2, m3 = (MULTIPLIER >> 16 * i & 0xFFFF for i in range(4))
    mask, shift = (lambda c, m: c.bitwiseAND(F.lit(m).cast("long"))), F.shiftleft
    upper = low * m1
    low_sum = low * m0 + shift(mask(upper, 0xFFFF), 16) + 1
    carry = F.shiftright(low_sum, 32) + F.shiftright(upper, 16)
    high_sum = carry + high * m0 + shift(mask(high * m1, 0xFFFF), 16) + low * m2 + shift(mask(low * m3, 0xFFFF), 16)
    return mask(high_sum, LOW), mask(low_sum, LOW)


def jump_hash(key: Column, *shards: int) -> Column:
    """A struct with the shard of a long key for each number of shards: fields s0, s1, ... A null key counts as 0."""
    n = max(shards)
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW).cast("long")).alias("low"), F.lit(0).cast("long").alias("at"),
        *[F.lit(0).cast("long").alias(f"s{i}") for i in range(len(shards))],
    )

    def step(x: Column, _: Column) -> Column:
        going = x["at"] < n
        high, low = _times_plus_one(x["high"], x["low"])
        # The generator's top 31 bits give the next jump from the shard reached.
        jump = F.floor((x["at"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.struct(
            F.when(going, high).otherwise(x["high"]).alias("high"), F.when(going, low).otherwise(x["low"]).alias("low"), F.when(going, jump).otherwise(x["at"]).alias("at"),
            *[F.when(x["at"] < s, x["at"]).otherwise(x[f"s{i}"]).alias(f"s{i}") for i, s in enumerate(shards)],
        )

    steps = min(n + 1, STEPS)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, step,
        lambda x: F.struct(*[F.when(x["at"] >= n, x[f"s{i}"]).otherwise(F.raise_error(F.lit("a key made too many jumps")).cast("long")).cast("int").alias(f"s{i}") for i in range(len(shards))]),
    )


def shard(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Put rows into shards 0 to shards-1. Returned: the key, the columns `keep` and

    size (UTF-8 bytes of the text plus 1, a null text has none), text_crc32 (unsigned, of the UTF-8 bytes; 0 for null), law ('key'), shard, slot (gapless from 0 in each shard, by a random key, then key, size and checksum) and grown_shard (the shard if there were one more).
    A null key is key 0. Texts of any length count whole. Keys may repeat, equal rows get slots of their own. Other columns, whatever their names, are not read. An empty table gives an empty one. Slots are counted over ranges of keys, so no task gets a whole shard.
    """
    df = only(df, [key, text, *keep]).select(key, text, *keep)
    total = df.count()
    rows = df.withColumns({"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, "text_crc32": F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")), "law": F.lit("key"), "__jump": jump_hash(F.col(key), shards, shards + 1), "__key": random_key(F.col(key))})
    if text not in keep:
        rows = rows.drop(text)
    rows = rows.withColumns({"shard": F.col("__jump.s0"), "grown_shard": F.col("__jump.s1"), "__range": key_range(F.col("__key"), range_bits(F.lit(total // shards)))}).drop("__jump")
    rows = running_total(rows, ["shard"], "__range", [F.col("__key"), F.col(key), F.col("size"), F.col("text_crc32")], F.lit(1), "slot")
    return rows.select(key, *keep, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    return shard(documents(spark, sf_dir), shards)


#: In SQL: a recursion over the jumps of each key, slots in the order of the same random key, and the checksum byte by byte.
OP10_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text, CAST(coalesce(doc_id, 0) AS HUGEINT) AS key, coalesce(strlen(text), 0) + 1 AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS k FROM documents),
jumps AS (
  SELECT DISTINCT key, key AS state, CAST(0 AS BIGINT) AS j FROM docs
  UNION ALL
  SELECT key, now, CAST(floor(least((j + 1) * (2147483648.0::DOUBLE / CAST(now // 8589934592 + 1 AS DOUBLE)), 1e15)) AS BIGINT) FROM (SELECT key, j, (state * {MULTIPLIER} + 1) % 18446744073709551616 AS now FROM jumps WHERE j <= 16)),
put AS (SELECT key, CAST(max(j) FILTER (WHERE j < 16) AS INTEGER) AS shard, CAST(max(j) FILTER (WHERE j < 17) AS INTEGER) AS grown_shard FROM jumps GROUP BY key),
steps AS (SELECT i, i AS v, 0 AS n FROM range(0, 256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM steps WHERE n < 8),
lookup AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE n = 8),
bytes AS (SELECT DISTINCT text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS b FROM documents WHERE text IS NOT NULL),
crc AS (SELECT text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda x, y: xor(x >> 8, t[CAST(xor(x, y) & 255 AS BIGINT) + 1])), 4294967295) AS c FROM bytes, lookup)
SELECT doc_id, CAST(size AS BIGINT) AS size, coalesce(c, 0) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id, size, c) - 1 AS slot, grown_shard
FROM docs JOIN put USING (key) LEFT JOIN crc ON crc.text = docs.text"""
