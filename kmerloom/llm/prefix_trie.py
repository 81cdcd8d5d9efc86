"""A trie of conversation prefixes. A count-min sketch of prefix digests screens them: a prefix with an estimate of one is proved to be of one conversation, and its node is made where the row stands. Only prefixes that may be shared are shuffled and grouped exactly.

A prefix has one 128-bit digest: the exclusive or, over its turns, of hashes of place and content. Digests of all prefixes thus are running totals, which are put together over ranges of a conversation: no task needs a conversation as a whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import WORD, discard, field, materialize, only, running_total
from kmerloom.llm.textkit import mix

#: A conversation starts with up to MOST_SHARED turns of the first conversation of its BLOCK.
BLOCK, MOST_SHARED = 20, 3
#: Rows of the sketch, and cells of a row: CELLS_PER_PREFIX for each prefix, MOST_CELLS at most. A cell is a byte that stops at 2, so the sketch that executors get has 16 MB at most; with more prefixes than cells more of them are grouped exactly, and the result is the same.
SKETCH_ROWS, CELLS_PER_PREFIX, MOST_CELLS = 4, 8, 1 << 22
#: Cells that travel together while sketches are added up.
CELL_BLOCK = 1 << 14
#: Ids of a node's conversations travel in pieces of so many characters.
PIECE = 1 << 16
KEY = ["depth", "k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _cells(k1: np.ndarray, k2: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each digest in each row of the sketch."""
    a, b = mix(k1.view(np.uint64)), mix(k2.view(np.uint64)) | np.uint64(1)
    return [(mix(a + np.uint64(r) * b) >> np.uint64(64 - bits)).astype(np.int64) for r in range(SKETCH_ROWS)]


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in names]


def _sketched(bits: int):
    """A partition's own sketch, in blocks that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SKETCH_ROWS, 1 << bits), np.uint8)
        for batch in batches:
            for row, at in zip(table, _cells(*_longs(batch, "k1", "k2"), bits), strict=True):
                hit, n = np.unique(at, return_counts=True)
                row[hit] = np.minimum(2, row[hit] + np.minimum(n, 2))
        blocks = table.reshape(-1, min(CELL_BLOCK, 1 << bits))
        for i in np.flatnonzero(blocks.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([zlib.compress(blocks[i].tobytes(), 1)], pa.binary())], names=["block", "cells"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that lie side by side with the same number, added up; one is held at a time."""
    now, total = None, None

    def close():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "cells"])

    for batch in batches:
        for i, cells in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
            cells = np.frombuffer(zlib.decompress(cells.as_py()), np.uint8)
            if i != now:
                if now is not None:
                    yield close()
                now, total = i, cells.copy()
            else:
                total = np.minimum(2, total + cells)
    if now is not None:
        yield close()


def count_min(prefixes: DataFrame, bits: int) -> np.ndarray:
    """The sketch of the digests k1, k2: SKETCH_ROWS rows of 2^bits cells, counted up to 2."""
    schema = "block long, cells binary"
    blocks = prefixes.select("k1", "k2").mapInArrow(_sketched(bits), schema).repartition("block").sortWithinPartitions("block").mapInArrow(_added, schema)
    width = min(CELL_BLOCK, 1 << bits)
    out = np.zeros(((SKETCH_ROWS << bits) // width, width), np.uint8)
    for r in blocks.toLocalIterator():
        out[r.block] = np.frombuffer(zlib.decompress(bytes(r.cells)), np.uint8)
    return out.reshape(SKETCH_ROWS, 1 << bits)


def _screen(bits: int, shared):
    """Adds shared (whether the prefix may be of several conversations) and parent_shared (the same of the prefix without its last turn; the root always may)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            k1, k2, p1, p2, depth = _longs(batch, "k1", "k2", "p1", "p2", "depth")
            own, above = (np.min([row[at] for row, at in zip(table, _cells(a, b, bits), strict=True)], axis=0) > 1 for a, b in ((k1, k2), (p1, p2)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(above | (depth == 1))], names=[*batch.schema.names, "shared", "parent_shared"])

    return run


def turn_hashes(place: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn's place and its content."""
    return F.xxhash64(place, a, b), F.xxhash64(b, F.lit("turn"), a, place)


def narrow_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns without their texts: conv, turn, a and b (120 bits of SHA-256 of role and text), words, and mark, which tells equal rows apart."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256)
    lanes = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    rows = df.filter(F.col(conv).isNotNull())
    return rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), lanes[0].alias("a"), lanes[1].alias("b"), F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("mark"))


def prefixes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: conv and length, and their prefixes of one turn or more: conv, depth, k1 and k2 (digest), p1 and p2 (digest without the last turn), words (of the last turn), last.

    Turns are sorted by ranges of conversation and turn, so a conversation of any length, or one turn that occurs without end, is spread over tasks; the places inside ranges and what earlier ranges hold are put together afterwards.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = materialize(narrow_turns(df, conv, turn, role, text), "trie-turns")
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("mark")]
    ranged = materialize(turns.repartitionByRange(tasks, "conv", *order).withColumn("part", F.spark_partition_id()), "trie-ranges")
    discard(turns)
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("conv"))}), "trie-counts")
    placed = ranged.withColumn("at", F.row_number().over(inside).cast("long") - 1).join(counts, ["conv", "part"]).withColumn("at", F.col("at") + F.col("before"))

    # The first turns of each block's first conversation, MOST_SHARED at most, with the hashes they have at the start of any conversation.
    first = placed.filter((F.col("conv") % BLOCK == 0) & (F.col("at") < MOST_SHARED))
    h1, h2 = turn_hashes(F.col("at") + 1, F.col("a"), F.col("b"))
    heads = first.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", h1.alias("h1"), h2.alias("h2"), "words"))).alias("head"))
    convs = counts.groupBy("conv").agg(F.max("total").alias("total")).withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1), "base": F.col("conv") - F.col("conv") % BLOCK})
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", 1, F.col("h").cast("int"))))
    convs = convs.select("conv", "total", "h", "head", F.size("head").cast("long").alias("taken")).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("total") - F.col("h")))
    convs = materialize(convs, "trie-conversations")

    def folded(name: str, upto: Column) -> Column:
        return F.aggregate(F.slice("head", 1, upto), F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(t[name]))

    whole = [folded(h, F.size("head")).alias(x) for h, x in (("h1", "from1"), ("h2", "from2"))]
    own = placed.drop("total").join(convs.select("conv", "h", "taken", "length", *whole), "conv").filter("at >= h").withColumn("depth", F.col("at") - F.col("h") + F.col("taken") + 1)
    h1, h2 = turn_hashes(F.col("depth"), F.col("a"), F.col("b"))
    own = own.withColumns({"h1": h1, "h2": h2})
    running = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = materialize(own.select("conv", "part", "depth", "length", "words", "from1", "from2", "h1", "h2", F.bit_xor("h1").over(running).alias("x1"), F.bit_xor("h2").over(running).alias("x2")), "trie-running")
    ends = own.groupBy("conv", "part").agg(F.max_by("x1", "depth").alias("e1"), F.max_by("x2", "depth").alias("e2"))
    sofar = ends.select("conv", "part", *[F.coalesce(F.bit_xor(f"e{i}").over(earlier), F.lit(0)).alias(f"e{i}") for i in (1, 2)])
    lanes = {f"k{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"e{i}")).bitwiseXOR(F.col(f"from{i}")) for i in (1, 2)}
    columns = ["conv", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "words", (F.col("depth") == F.col("length")).alias("last")]
    tails = own.join(sofar, ["conv", "part"]).withColumns(lanes).select(*columns)
    starts = convs.select("*", F.posexplode("head").alias("i", "t")).select("conv", "length", (F.col("i") + 1).cast("long").alias("depth"), "t.*", folded("h1", F.col("i") + 1).alias("k1"), folded("h2", F.col("i") + 1).alias("k2")).select(*columns)
    out = materialize(starts.unionByName(tails), "trie-prefixes")
    discard(ranged, counts, own)
    return convs.select("conv", "length"), out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of node and conversation: the ids of a node joined by commas, in pieces."""
    names, now, ids, size = [*KEY, "conv", "ids"], None, [], 0

    def close():
        return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in (*now, ids[0])], pa.array([",".join(map(str, ids))])], names=names)

    for batch in batches:
        for *key, conv in zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv")], strict=True):
            if ids and (key != now or size > PIECE):
                yield close()
                ids, size = [], 0
            now = key
            ids.append(conv)
            size += len(str(conv)) + 1
    if ids:
        yield close()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: the SHA-256 of each node's ids, as they stream by."""
    now, state, done = None, None, []

    def out():
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in list(zip(*[k for k, _ in done], strict=True)) or [[]] * 3], pa.array([v for _, v in done], pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield out()
        done = []
    if now is not None:
        done.append((now, state.hexdigest()))
        yield out()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """depth, k1, k2 and ends_sha256 of the conversations `conv` that end at a node. A node's ids are sorted and joined by ranges first; the hash of a node is one chain by its nature and streams over these pieces, so no task holds them."""
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.select(*KEY, "conv").repartitionByRange(tasks, *KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_pieces, "depth long, k1 long, k2 long, conv long, ids string")
    return pieces.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A conversation begins with the first h turns of the first one of its block of 20 (h from its id's checksum) and goes on with its own turns after its first h. Turns go by `turn`, null first; equal turns by a digest of role and text. A null role or text is empty; rows of a null conversation are left out. Repeated rows are turns of their own. Texts of any length count whole. Other columns, of any name, are not read. An empty table has no conversation and gives no node, not even the root.
    """
    df = only(df, [conv, turn, role, text])
    convs, all_ = prefixes(df, conv, turn, role, text)
    bits = max(8, min(CELLS_PER_PREFIX * max(1, all_.count()), MOST_CELLS).bit_length() - 1)
    sketch = df.sparkSession.sparkContext.broadcast(count_min(all_, bits))
    screened = all_.mapInArrow(_screen(bits, sketch), T.StructType([*all_.schema.fields, field("shared", "boolean"), field("parent_shared", "boolean")]))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    roots = convs.select("conv", *[zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "words")], (F.col("length") == 0).alias("last"), no.alias("parent_shared"))
    shared = materialize(screened.filter("shared").drop("shared").unionByName(roots), "trie-shared")
    single = screened.filter("NOT shared")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]

    nodes = materialize(shared.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("parent_shared").alias("parent_shared")), "trie-nodes")
    below = nodes.filter("parent_shared").select(*above).unionByName(single.filter("parent_shared").select(*above)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes_ = nodes.join(below, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "value": (F.col("n_convs") - 1) * F.col("words")})
    known = materialize(nodes_, "trie-children")
    discard(nodes)
    # The smallest member of a node is that of its longer prefixes that it has too: each conversation owns the end of its own path. What it owns is added up once, then over the members of each node.
    owned = known.select(F.col("conv_id").alias("conv"), "value", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf")).unionByName(single.filter("last").select("conv", zero.alias("value"), F.lit(1).alias("leaf")))
    owned = owned.groupBy("conv").agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaves"))
    sums = shared.join(owned, "conv", "left").groupBy(*KEY).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("all_saved"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("n_leaves"))
    earlier = running_total(known.withColumn("__range", F.floor(F.col("depth") / 4096)), ["conv_id"], "__range", [F.col("depth")], F.col("value"), "earlier").drop("__range")
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    up = ["depth", "p1", "p2"]
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id")
    long_ = lambda c: F.col(c).cast("long").alias(c)
    many = earlier.join(sums, KEY).join(ends_hashes(shared.filter("last")), KEY, "left").join(parents, up, "left").withColumn("saved_tokens", F.col("all_saved") - F.col("earlier"))
    many = many.select("conv_id", "depth", parent, long_("n_convs"), long_("n_children"), long_("n_leaves"), long_("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    one = single.filter("parent_shared").join(parents, up, "left").unionByName(single.filter("NOT parent_shared").withColumn("above", F.col("conv")))
    sha = F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS))
    one = one.select(F.col("conv").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), sha.alias("ends_sha256"))
    return many.unionByName(one)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: In SQL: each node's value goes to all prefixes of its smallest member; the checksum of an id byte by byte.
OP13_SQL = f"""
WITH RECURSIVE steps AS (SELECT i, i AS v, 0 AS n FROM range(0, 256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM steps WHERE n < 8),
lookup AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE n = 8),
ids AS (SELECT DISTINCT conv_id AS c, list_transform(regexp_extract_all(CAST(conv_id AS VARCHAR), '.'), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda x, y: xor(x >> 8, t[CAST(xor(x, y) & 255 AS BIGINT) + 1])), 4294967295) % {MOST_SHARED + 1} AS h FROM ids, lookup),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS ord, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (SELECT convs.c, 0 AS own, ord, role, text FROM convs JOIN turns ON turns.c = convs.c - convs.c % {BLOCK} AND ord < h UNION ALL SELECT c, 1, ord, role, text FROM convs JOIN turns USING (c) WHERE ord >= h),
chain AS (SELECT c, row_number() OVER w AS depth, md5(CAST(list(md5(length(role) || ':' || role || text)) OVER w AS VARCHAR)) AS k, len(regexp_extract_all(text, '{WORD}')) AS words, count(*) OVER (PARTITION BY c) AS n FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, ord ROWS UNBOUNDED PRECEDING)),
rows_ AS (
  SELECT c, depth, k, lag(k, 1, 'root') OVER (PARTITION BY c ORDER BY depth) AS up, words, depth = n AS last FROM chain
  UNION ALL SELECT c, 0, 'root', NULL, 0, c NOT IN (SELECT c FROM chain) FROM convs),
nodes AS (SELECT depth, k, min(c) AS conv_id, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM rows_ GROUP BY depth, k),
children AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, k)),
under AS (SELECT r.depth, r.k, CAST(sum((x.n_convs - 1) * x.words) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves FROM full_ x JOIN rows_ r ON r.c = x.conv_id AND r.depth <= x.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN under u USING (depth, k) LEFT JOIN full_ p ON p.depth = f.depth - 1 AND p.k = f.up"""
