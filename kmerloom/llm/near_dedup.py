"""Near-duplicates by b-bit MinHash: of 192 minima the low 4 bits are kept and packed; bands of minima give candidates, bit counts of the packed signatures estimate their similarity with chance collisions taken out, and what is near enough is confirmed on the full shingle sets.

Texts with equal shingle sets form one class first, so copies cost a row and are never paired; sets are told apart by 128 bits of BLAKE2. In each bucket of a band classes are paired with the bucket's least class only. Then components are formed; in a bucket that still holds several, its members outside the largest one are compared with all the others that are in another component, in blocks. So every pair that shares a bucket is either in one component or compared.

A bucket of n classes, m of them outside its largest component, costs n pairs for the star and m * n comparisons of packed signatures at most; what is near by these is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import discard, documents, field, materialize, only
from kmerloom.llm.components import components
from kmerloom.llm.textkit import give_back, mix, parts, slices, words

#: 38 bands of 5 minima: two sets at similarity 0.8 share no band with a chance of (1 - 0.8^5)^38 = 3e-7.
BANDS, BAND_ROWS, HASHES, BITS = 38, 5, 192, 4
#: Estimates have a standard deviation of 0.03 at similarity 0.8: those so far below the threshold, 6.7 of them, are not confirmed.
SLACK = 0.2
#: Of one bucket so many classes are compared in one block, or as many as have so many shingles together: that bounds a task's memory.
BLOCK, BLOCK_SHINGLES = 1000, 4_000_000
#: Tasks over which the pairs of one center are spread.
SPREAD = 64
#: Classes are numbered by so many hexadecimal digits of their digest, and where two have one number by a hash of the digest.
NUMBER = 15
ODD = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**31, size=(HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Lowest bit of each 4-bit field of a 64-bit number.
LOWEST = 0x1111111111111111


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """Row and sorted distinct 64-bit shingle hashes of each text; None without words. A text with fewer words than `size` is one shingle."""
    for s in slices(column):
        w = words(s)
        h = w.hashes()
        n = len(h)
        key = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size):
            key += mix(h[j : n - size + 1 + j] + ODD * np.uint64(j)) if n >= size else np.uint64(0)
        key = mix(key)
        for i in range(s.hi - s.lo):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= size:
                yield s.lo + i, np.unique(key[a : b - size + 1])
            elif b > a:
                own = mix(h[a:b] + ODD * np.arange(b - a, dtype=np.uint64)).sum(keepdims=True)
                yield s.lo + i, mix(own + np.uint64(b - a))
            else:
                yield s.lo + i, None


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (MULTIPLIERS * x[at : at + 2048]).min(axis=1), out=out)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """Low bits of rows of minima, 16 to a number."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), -1, 64 // BITS)
    return (low << (np.uint64(BITS) * np.arange(64 // BITS, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def bands(m: np.ndarray) -> np.ndarray:
    rows = m[:, : BANDS * BAND_ROWS].astype(np.uint64).reshape(len(m), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * ODD, rows.shape[:2])
    for j in range(BAND_ROWS):
        key = mix(key + rows[:, :, j])
    return key


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            n = batch.num_rows
            prints, counts, m, some = [None] * n, np.zeros(n, np.int64), np.zeros((n, HASHES), np.uint32), np.zeros(n, bool)
            for i, x in shingle_sets(batch.column("__text"), size):
                if x is not None:
                    some[i], counts[i], m[i] = True, len(x), minima(x)
                    prints[i] = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            at = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64))) for x in (np.ascontiguousarray(bands(m[some])), np.ascontiguousarray(pack(m[some])))]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__hash"), pa.array(prints, pa.binary()), pa.array(counts), *lists], names=["__id", "__hash", "__digest", "n_shingles", "__bands", "__bits"])
        give_back()

    return run


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity: equal fields of two packed signatures, less those equal by chance."""

    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift in (1, 2):  # any bit of a field, at its lowest place
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
        return F.bit_count(d.bitwiseAND(F.lit(LOWEST).cast("long"))).cast("int")

    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return ((F.lit(HASHES) - differ) / F.lit(float(HASHES)) - chance) / (1 - chance)


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keep = np.zeros(batch.num_rows, bool)
            for (i, x), (_, y) in zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size), strict=True):
                if x is not None and y is not None:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        give_back()

    return run


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that are compared, and those that they are compared with."""
    one = table.column("one").to_numpy(zero_copy_only=False)
    return np.flatnonzero(one), np.flatnonzero(~one)


def _open(least: float):
    """Of one block of a bucket the members that have a likely partner in another component. Two members outside the largest component meet in two blocks, and count in one."""
    chance = 2.0**-BITS
    most = int(HASHES - HASHES * (least * (1 - chance) + chance))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, root, big = table.column("__set").to_numpy(), table.column("root").to_numpy(), table.column("big")[0].as_py()
        bits = np.array(table.column("__bits").to_pylist(), np.int64).view(np.uint64).reshape(len(root), -1)
        one, two = _sides(table)
        wanted = np.zeros(len(root), bool)
        for i in one:
            rest = two[(root[two] != root[i]) & ((root[two] == big) | (node[two] > node[i]))]
            d = bits[rest] ^ bits[i]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            near = rest[np.bitwise_count(d & np.uint64(LOWEST)).sum(axis=1) <= most]
            wanted[near] = True
            wanted[i] |= len(near) > 0
        return table.filter(pa.array(wanted)).select(["band", "low", "high", "one", "big", "__set", "root", "__bits"])

    return run


def _join_up(size: int, percent: int, least: float):
    """Links between components in one block of a bucket, on full sets. A link makes two components one, so a block of n members has fewer than n links to tell; which pairs are measured is up to the estimate, as everywhere."""
    chance = 2.0**-BITS
    most = int(HASHES - HASHES * (least * (1 - chance) + chance))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, first_root, big = table.column("__set").to_numpy(), table.column("root").to_numpy(), table.column("big")[0].as_py()
        root = first_root.copy()
        bits = np.array(table.column("__bits").to_pylist(), np.int64).view(np.uint64).reshape(len(node), -1)
        sets = [x for _, x in shingle_sets(table.column("text").combine_chunks(), size)]
        sizes = np.array([len(x) for x in sets])
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        mark = np.zeros(int(number.max()) + 1, np.int32)
        one, two = _sides(table)
        found = []
        for i in one:
            rest = two[(root[two] != root[i]) & ((first_root[two] == big) | (node[two] > node[i]))]
            d = bits[rest] ^ bits[i]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            rest = rest[np.bitwise_count(d & np.uint64(LOWEST)).sum(axis=1) <= most]
            if not len(rest):
                continue
            own = number[begin[i] : begin[i] + sizes[i]]
            mark[own] = 1
            n = sizes[rest]
            first = np.cumsum(n) - n
            both = np.add.reduceat(mark[number[np.repeat(begin[rest] - first, n) + np.arange(int(n.sum()))]], first)
            mark[own] = 0
            for j in rest[100 * both >= percent * (n + sizes[i] - both)]:
                if root[j] != root[i]:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    root[root == root[j]] = root[i]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def numbered(classes: DataFrame) -> DataFrame:
    """classes with numbers `__set` that no two share: of those with one number all but one get a hash of their digest. There are about n^2 / 2^61 of these among n classes."""
    double = classes.groupBy("__set").agg(F.count(F.lit(1)).alias("__count")).filter("__count > 1").select("__set")
    if double.isEmpty():
        return classes
    first = classes.join(double, "__set", "left_semi").groupBy("__set").agg(F.min("__digest").alias("__first"))
    out = classes.join(first, "__set", "left")
    return materialize(out.withColumn("__set", F.when(F.col("__digest") != F.col("__first"), F.xxhash64("__digest")).otherwise(F.col("__set"))).drop("__first"), "near-classes")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id, kept, and __hash (of the text, to tell rows of one key apart).

    Words are runs of anything but white space, A-Z lower-cased. A text's set holds its distinct shingles of `shingle` words; with fewer words the whole text is one. Texts are linked if 100 * intersection >= percent * union. component_id: least key that can be reached over links, its own included; kept: key = component_id.
    Texts of any length are read whole. Null texts and texts without words have n_shingles 0, are linked with nothing and kept. Null keys are above all others; a component of null keys alone has a null component_id, and all of it is kept. Rows with equal keys are kept or dropped by the same rule. Other columns are not read; an empty table gives an empty one.
    Equal sets are known by equal 128-bit digests and not compared; links between different sets are confirmed on the full sets.
    """
    kind = only(df, [key, text]).schema[key].dataType
    df = only(df, [key, text]).select(F.col(key).alias("__id"), F.col(text).alias("__text"), F.xxhash64(F.col(text)).alias("__hash"))
    schema = T.StructType([T.StructField("__id", kind), field("__hash", "long"), field("__digest", "binary"), field("n_shingles", "long"), field("__bands", "array<long>"), field("__bits", "array<long>")])
    rows = materialize(df.mapInArrow(_sign(shingle), schema), "near-rows")
    classes = rows.filter("__digest IS NOT NULL").groupBy("__digest").agg(F.min("__id").alias("__least"), F.min(F.struct("__id", "__hash")).alias("__row"), F.first("__bands").alias("__bands"), F.first("__bits").alias("__bits"), F.first("n_shingles").alias("n"))
    classes = numbered(materialize(classes.withColumn("__set", F.conv(F.substring(F.hex("__digest"), 1, NUMBER), 16, 10).cast("long")), "near-classes"))
    each = classes.select("__set", "n", F.explode("__bands").alias("band"))
    buckets = each.groupBy("band").agg(F.min("__set").alias("center"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    members = materialize(each.join(buckets, "band").filter("__set <> center"), "near-members")
    bits = classes.select("__set", "__bits")

    def near(pairs: DataFrame) -> DataFrame:
        a, b = (bits.select(F.col("__set").alias(x), F.col("__bits").alias(f"bits_{x}")) for x in "ab")
        pairs = pairs.join(a, "a").join(b, "b")
        return pairs.filter(likeness(F.col("bits_a"), F.col("bits_b")) >= percent / 100 - SLACK).select("a", "b")

    # The texts of all classes that share a bucket, one row for each class, fetched once.
    wanted = materialize(members.select(F.explode(F.array("center", "__set")).alias("__set")).distinct().join(classes.select("__set", F.col("__row.__id").alias("i"), F.col("__row.__hash").alias("__hash")), "__set").select("__set", "__hash", F.coalesce(F.col("i").cast("string"), F.lit("")).alias("__at")), "near-wanted")
    full = df.select("__text", "__hash", F.coalesce(F.col("__id").cast("string"), F.lit("")).alias("__at")).hint("shuffle_merge").join(wanted, ["__at", "__hash"])
    texts = materialize(full.groupBy("__set").agg(F.first("__text").alias("text")), "near-texts")
    discard(wanted)
    a, b = (texts.select(F.col("__set").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    stars = near(members.select(F.col("center").alias("a"), F.col("__set").alias("b")).distinct()).withColumn("at", F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int"))
    stars = materialize(stars, "near-stars")
    # A center's text goes to each task that has pairs of it, not along with each pair through one task.
    heads = stars.select("a", "at").distinct().join(a, "a")
    links = materialize(stars.join(heads, ["a", "at"]).join(b, "b").mapInArrow(_confirm(shingle, percent), "a long, b long"), "near-links")
    roots = materialize(components(links), "near-roots")
    # What a bucket's members other than the center may have in common: only pairs across components are open.
    rest = members.join(roots.withColumnRenamed("node", "__set"), "__set", "left").withColumn("root", F.coalesce("root", "__set"))
    load = lambda count, shingles: F.ceil(F.greatest(count / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    shares = rest.groupBy("band", "root").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("shingles"))
    torn = shares.groupBy("band").agg(F.max(F.struct("count", "shingles", "root")).alias("most"), F.sum("count").alias("count"), F.sum("shingles").alias("shingles")).filter(F.col("count") > F.col("most.count"))
    torn = torn.select("band", F.col("most.root").alias("big"), load(F.col("count"), F.col("shingles")).alias("parts"), load(F.col("count") - F.col("most.count"), F.col("shingles") - F.col("most.shingles")).alias("few"))
    rest = rest.join(torn, "band").join(bits, "__set")
    # Blocks: parts of the members outside the largest component by parts of all members.
    own = lambda n, seed: F.pmod(F.xxhash64("__set", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda low, high, one: F.struct(low.alias("low"), high.alias("high"), F.lit(one).alias("one"))
    places = F.concat(F.transform(every("few"), lambda i: place(i, own("parts", 0), False)), F.when(F.col("root") != F.col("big"), F.transform(every("parts"), lambda i: place(own("few", 1), i, True))).otherwise(F.array()))
    rest = rest.withColumn("place", F.explode(places)).select("band", "place.low", "place.high", "place.one", "big", "__set", "root", "__bits")
    least = percent / 100 - SLACK
    opened = materialize(rest.groupBy("band", "low", "high").applyInArrow(_open(least), rest.schema), "near-open")
    more = materialize(opened.join(texts, "__set").groupBy("band", "low", "high").applyInArrow(_join_up(shingle, percent, least), "a long, b long").distinct(), "near-links")
    if more.limit(1).count():
        roots = materialize(components(links.unionByName(more)), "near-roots")
    discard(members, texts, opened)
    own = classes.select("__digest", "__set", "__least").join(roots.withColumnRenamed("node", "__set"), "__set", "left").withColumn("root", F.coalesce("root", "__set"))
    least = own.groupBy("root").agg(F.min("__least").alias("component_id"))
    named = own.join(least, "root").select("__digest", "component_id")
    # Rows without words have no class and don't meet in a join; copies of one text may be a third of all rows, which adaptive execution splits.
    rows = rows.select("__id", "__hash", "__digest", "n_shingles")
    out = rows.filter("__digest IS NOT NULL").join(named, "__digest").drop("__digest")
    out = out.unionByName(rows.filter("__digest IS NULL").drop("__digest").withColumn("component_id", F.col("__id")))
    return out.select(F.col("__id").alias(key), "n_shingles", "component_id", F.col("__id").eqNullSafe(F.col("component_id")).alias("kept"), "__hash")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), shingle=2).drop("__hash")
