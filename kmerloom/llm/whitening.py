"""Embedding whitening: a pivoted Cholesky factor of the centred scatter, then one-sided Jacobi rotations of the columns of that triangular factor. The rotated columns' norms give the eigenvalues, the normalised columns the components.

Spark does what grows with the rows: distinct vectors, sums, scatter, projections. The driver holds matrices of dimension by dimension only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kmerloom.llm.common import discard, field, materialize, only
from kmerloom.llm.textkit import parts

COMPONENTS = 16
#: Entries become whole numbers: floor(SCALE * c) + SHIFT. What lies beyond LIMIT on either side counts as LIMIT.
SCALE, SHIFT, LIMIT = 64, 1_000_000, float(1 << 61)
#: Tasks whose matrices the driver adds up itself; more are added up in tasks first.
FAN_IN = 64


def whole_numbers(vector: Column) -> Column:
    """The entries of a vector as whole numbers."""

    def entry(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))
        return F.floor(scaled).cast("long") + SHIFT

    return F.transform(vector, entry)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they suffice, else in Python's integers."""
    most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
    if n * most + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviation(z: np.ndarray) -> list[int | None]:
    """Sums of squares of the rows, exact; null where a long can't hold one."""
    if z.dtype != object and len(z) and z.shape[1] * max(abs(int(z.min())), abs(int(z.max()))) ** 2 < 1 << 62:
        return (z * z).sum(1).tolist()
    exact = (z.astype(object) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def add_up(tables: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of doubles, a row `part` for each. Where many tasks have one, they are added up in about the root of their number of tasks first, so neither a task nor the driver gets all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("part"):
                total += np.frombuffer(x.as_buffer(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    tasks = tables.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = math.isqrt(tasks) + 1
        tables = tables.repartition(tasks).mapInArrow(run, "part binary")
    return sum((np.frombuffer(bytes(r.part), float) for r in tables.toLocalIterator()), np.zeros(size))


def _products(width: int, n: int, sums: list[int], project: Callable[[np.ndarray], np.ndarray]):
    """Sums, over the vectors of a partition, of what `project` makes of the centred vector (its entries, then their products)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in parts(batches, 4096):
            y = project((centred(_matrix(batch.column("x"), width), n, sums) / n).astype(float))
            now = np.concatenate([y.sum(0), (y.T @ y).ravel()])
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def cholesky(v: np.ndarray) -> np.ndarray:
    """G with G G' = v, its columns by falling pivot, as many as v has rank: triangular up to the order of the rows, which is v's."""
    a, size = v.astype(float).copy(), len(v)
    order, factor = np.arange(size), np.zeros((size, size))
    least = size * np.finfo(float).eps * max(a.diagonal().max(initial=0), 0)
    for k in range(size):
        p = k + int(a.diagonal()[k:].argmax())
        if a[p, p] <= least:
            return _in_order(factor[:, :k], order)
        for matrix in (a, a.T, factor, order):
            matrix[[k, p]] = matrix[[p, k]]
        factor[k, k] = math.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return _in_order(factor, order)


def _in_order(factor: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(factor)
    out[order] = factor
    return out


def jacobi(g: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of g g', by rotations that make the columns of g orthogonal. Pairs of columns that have none in common are rotated together."""
    g, columns = g.copy(), g.shape[1]
    ring = [*range(columns), *([-1] if columns % 2 else [])]
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring), strict=False) if a >= 0 and b >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = (np.array([x[i] for x in pairs], int) for i in (0, 1))
            left, right = g[:, p], g[:, q]
            a, b, c = (left**2).sum(0), (right**2).sum(0), (left * right).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            turn = off > 1e-15
            worst = max(worst, off.max(initial=0))
            zeta = (b - a) / np.where(turn, 2 * c, 1)
            t = np.where(turn, np.copysign(1, zeta) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            cos = 1 / np.hypot(1, t)
            g[:, p], g[:, q] = cos * left - cos * t * right, cos * t * left + cos * right
        if worst <= 1e-15:
            break
    norms = np.sqrt((g**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


def _whiten(key: str, width: int, shared):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        n, sums, to, explained = model["n"], model["sums"], model["to"], model["explained"]
        k = len(explained)
        for batch in parts(batches):
            z = centred(_matrix(batch.column("x"), width), n, sums)
            rows = pa.array(np.repeat(np.arange(len(z)), k))
            w = (z / n).astype(float) @ to
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(rows), pa.array(np.tile(np.arange(1, k + 1), len(z)), pa.int32()), pa.array(np.full(len(z) * k, n), pa.int64()), pa.array(deviation(z), pa.int64()).take(rows), pa.array(w.ravel()), pa.array(np.tile(explained, len(z))), pa.array(np.full(len(z) * k, model["error"]))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: for each row and component the key, component (from 1), n, deviation, whitened, explained and identity_error.

    Rows whose vector is null, is empty or holds a null or an entry that isn't finite are left out, and so are those whose length isn't that of most of the others (of equally frequent lengths the greatest). Entries become whole numbers x (whole_numbers()). The fit is over distinct x vectors: n of them with sums S. Rows that repeat, and null keys, are rows of their own in the result.
    deviation is the exact sum of (n * x - S)^2, null if a long can't hold it. Components are eigenvectors of the covariance of x with an eigenvalue above 0, as far as rounding can tell: there are none if all vectors are equal, and then, as for an empty table, the result is empty. identity_error is measured over the fit list: the largest entry of the whitened covariance minus the identity.
    Other columns are not read.
    """
    spark = df.sparkSession
    schema = T.StructType([df.schema[key], field("component", "int"), field("n", "long"), field("deviation", "long"), field("whitened", "double"), field("explained", "double"), field("identity_error", "double")])
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    df = only(df, [key, vector]).select(key, vector).filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~odd)
    common = df.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common["width"]
    rows = df.filter(F.size(vector) == width).select(key, whole_numbers(F.col(vector)).alias("x"))
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    totals = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, sums = totals[0]["n"], [int(Decimal(r["s"])) for r in sorted(totals, key=lambda r: r["i"])]
    scatter = add_up(fit.mapInArrow(_products(width, n, sums, lambda y: y), "part binary"), width + width * width)
    covariance = scatter[width:].reshape(width, width) / n
    values, vectors = jacobi(cholesky(covariance))
    k = min(components, len(values))
    to = vectors[:, :k] / np.sqrt(values[:k])
    if k == 0:
        discard(fit)
        return spark.createDataFrame([], schema)
    again = add_up(fit.mapInArrow(_products(width, n, sums, lambda y: y @ to), "part binary"), k + k * k) / n
    error = float(np.abs(again[k:].reshape(k, k) - np.outer(again[:k], again[:k]) - np.eye(k)).max())
    discard(fit)
    # Two arrays of dimension by components and some numbers for each dimension.
    model = spark.sparkContext.broadcast({"n": n, "sums": sums, "to": to, "explained": values[:k] / np.trace(covariance), "error": error})
    return rows.mapInArrow(_whiten(key, width, model), schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
