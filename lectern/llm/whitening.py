"""Embedding whitening by TSQR: exact sums centre the rows, each partition is reduced to a triangle, triangles merge in a tree.

A vector's entry c becomes the whole number floor(scale * c) + shift. The fit list holds every distinct vector once; sums are
exact whole numbers, so a row is centred without rounding away its digits, however large the shift. QR of the centred rows of a
partition gives a d x d triangle R, stacked triangles are reduced again (FAN_IN at a time), and the singular values s and right
vectors of the last R give variances s^2 / n and components: the covariance itself is never formed.

What reaches the driver is d sums and one d x d triangle. Rows whose vector is null, or holds null or non-finite entries, are
dropped; so are rows of another length than the commonest (the longer one of ties). Repeated rows and vectors keep a result each
but count once in the fit; a null vec_id stays. A component without variance (less than what rounding leaves of the largest)
can't be whitened and is left out, so a single distinct vector, like an empty table, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

SCALE, SHIFT, COMPONENTS, FAN_IN, BLOCK = 64, 1_000_000, 16, 8, 4096
LARGEST = 2**61  # scaled entries beyond it count as it
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    n: int
    sums: list[int]
    axes: np.ndarray  # d x components: unit eigenvectors of the covariance
    variance: np.ndarray  # of the components, falling
    total: float  # the covariance's trace


def whole_vectors(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, x array<long>: the rows that can be used."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("embedding").isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(LARGEST)), F.lit(-LARGEST)) + shift).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    d = lengths.first()
    return rows.filter(F.size("x") == (d.d if d else 0))


def matrix(column) -> np.ndarray:
    """rows x d of an Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the whole part is taken off in whole numbers, only the rest is rounded."""
    low = np.array([s // n for s in sums], np.int64)
    return (x - low).astype(np.float64) - np.array([(s % n) / n for s in sums])


def exact_sums(fitted: DataFrame) -> tuple[int, list[int]]:
    """(rows, sums by dimension): a partition sends its sums, in two halves so that none overflows."""

    def run(batches):
        n, high, low = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                h, l = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)
                n, high, low = n + len(x), h if high is None else high + h, l if low is None else low + l
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["i", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fitted.mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(wide("n"), wide("high"), wide("low")).orderBy("i").collect()
    return (int(rows[0].n), [(int(r.high) << 31) + int(r.low) for r in rows]) if rows else (0, [])


def triangle(*parts: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def factors(fitted: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """part, r: the triangle of each partition's centred rows, which are reduced BLOCK at a time."""

    def run(batches):
        from pyspark import TaskContext

        r = np.zeros((0, len(sums)))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = triangle(r, centred(matrix(batch.column("x").slice(at, BLOCK)), n, sums))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    return fitted.mapInArrow(run, "part long, r binary")


def merged(parts: DataFrame, d: int) -> DataFrame:
    """One level of the tree: FAN_IN triangles to one."""

    def run(rows):
        r = triangle(*(np.frombuffer(b, np.float64).reshape(-1, d) for b in rows.column("r").to_pylist()))
        return pa.table({"part": pa.array([rows.column("to")[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return parts.withColumn("to", F.floor(F.col("part") / FAN_IN)).groupBy("to").applyInArrow(run, "part long, r binary")


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit | None, DataFrame]:
    """(the fit, the fit list) of whole_vectors(): equal vectors meet once, after each partition has dropped its own copies."""
    fitted = materialize(rows.select("x").distinct(), "fit-list")
    n, sums = exact_sums(fitted)
    if not n:
        return None, fitted
    parts = materialize(factors(fitted, n, sums), "triangles")
    last = parts.agg(F.max("part")).first()[0]
    while last > 0:
        parts, last = merged(parts, len(sums)), last // FAN_IN
    r = np.frombuffer(parts.first().r, np.float64).reshape(-1, len(sums))
    _, s, vt = np.linalg.svd(r)
    rank = int((s > s[0] * np.finfo(float).eps * max(len(sums), len(r))).sum()) if s[0] > 0 else 0
    k = min(components, rank)
    return Fit(n, sums, vt[:k].T.copy(), s[:k] ** 2 / n, float((s**2).sum() / n)), fitted


def projected(x: np.ndarray, own: Fit) -> np.ndarray:
    """rows x components of unit variance over the fit list."""
    return centred(x, own.n, own.sums) @ own.axes / np.sqrt(own.variance)


def identity_error(fitted: DataFrame, own: Fit) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity: means first, then products of centred rows."""
    k = len(own.variance)

    def means(batches):
        total = np.zeros(k)
        for batch in batches:
            total += projected(matrix(batch.column("x")), own).sum(axis=0) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = {r.i: r.v for r in fitted.mapInArrow(means, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    mean = np.array([sums[i] / own.n for i in range(k)])

    def products(batches):
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(matrix(batch.column("x")), own) - mean
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    off = F.sum("v") / own.n - F.when(F.col("i") % (k + 1) == 0, 1.0).otherwise(0.0)
    return fitted.mapInArrow(products, "i int, v double").groupBy("i").agg(F.abs(off).alias("v")).agg(F.max("v")).first()[0]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - sum)^2, exact; null where it is too large for a long."""
    mid = centred(x, n, sums)
    if len(mid) and float(np.abs(mid).max()) ** 2 * x.shape[1] * float(n) ** 2 < 2**62:
        low, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
        return (((x - low) * n - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: SCHEMA. One fit serves all rows; a component's sign is arbitrary, but one."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = whole_vectors(vectors, scale, shift)
    own, fitted = fit(rows, components)
    if own is None or not len(own.variance):
        return spark.createDataFrame([], SCHEMA)
    k, error = len(own.variance), identity_error(fitted, own)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column("x"))
                m = len(x)
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                said = deviations(x, own.n, own.sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n)), pa.array(said, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(projected(x, own).ravel()), pa.array(np.tile(own.variance / own.total, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, SCHEMA)
