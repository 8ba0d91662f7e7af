"""Whitening of embeddings on their leading principal components.

1. Entries become whole numbers ``x = floor(256 * c)``; the *fit list* is each distinct vector
   once, staged as Parquet. Its size ``n`` and sums ``S`` are exact integers: every task adds the
   upper and lower 32 bits apart, Spark adds the tasks' rows.
2. The covariance is summed from centred rows, ``(n * x - S) / n``, one row of the matrix for each
   dimension and task, which Spark adds by dimension. Only the d x d matrix reaches the driver.
3. There, Householder reflections make it tridiagonal, Sturm counts bisect its largest
   eigenvalues, inverse iteration gives their vectors, and vectors of eigenvalues that lie close
   together are made orthogonal in every step.
4. Mean and components (d x 5 numbers) are broadcast; every row is projected where it lies.

Defined results: rows whose vector is null, or has a null or non-finite entry, are left out; a
null ``vec_id`` stays null. Repeated vectors count once in the fit and keep a row each. Components
without variance (fewer than four dimensions, or too few distinct vectors) have no rows; so an
empty table, or one distinct vector, gives an empty result. ``deviation`` is null where the exact
sum passes 64 bits. Vectors of different lengths raise a ``ValueError``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import table
from timedtext.session import stage_table

SCALE = 256
COMPONENTS = 4
LONG = 1 << 63
EPS = np.finfo(float).eps
WHITENED = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double,"
    " explained double, identity_error double"
)


def scaled(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x of the rows with a whole, finite vector."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    good = vectors.filter(F.col(column).isNotNull()).filter(~bad)
    return good.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length as one int64 matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` exactly: 64-bit where it fits, else Python's integers."""
    widest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * widest + max(map(abs, sums)) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def sums_of(size: int):
    """Upper and lower halves of the sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            x = matrix(batch.column(0), size)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array(high), pa.array(low)], names=["dim", "high", "low"]
        )

    return run


def scatter_of(size: int, n: int, sums: list[int]):
    """Rows of the sum of products of centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            c = centred(matrix(batch.column(0), size), n, sums).astype(float) / n
            total += c.T @ c
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size)), pa.array(list(total))], names=["dim", "products"]
        )

    return run


def add_rows(key, rows):
    return rows.iloc[:1].assign(products=[np.sum(np.stack(list(rows.products)), axis=0)])


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix."""
    a, d = v.copy(), len(v)
    mirrors = []
    for k in range(d - 2):
        u = a[k + 1 :, k].copy()
        norm = np.linalg.norm(u)
        u[0] += norm if u[0] >= 0 else -norm
        length = np.linalg.norm(u)
        u = u / length if length else u
        mirrors.append(u)
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: float) -> int:
    """How many eigenvalues of the tridiagonal matrix are under ``at`` (Sturm)."""
    tiny = EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0)) + np.finfo(float).tiny
    n, q = 0, 1.0
    for k, d in enumerate(diagonal):
        q = d - at - (off[k - 1] ** 2 / q if k else 0.0)
        if abs(q) < tiny:
            q = -tiny
        n += q < 0
    return n


def largest(diagonal: np.ndarray, off: np.ndarray, number: int) -> list[float]:
    """The largest eigenvalues, falling, by bisection to the last bits."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    slack = 4 * EPS * max(abs(low), abs(high))
    low, high = low - slack, high + slack
    out = []
    for k in range(number):
        a, b = low, high
        while b - a > 2 * EPS * max(abs(a), abs(b)) and a < (a + b) / 2 < b:
            mid = (a + b) / 2
            if count_below(diagonal, off, mid) >= len(diagonal) - k:
                b = mid
            else:
                a = mid
        high = b
        out.append((a + b) / 2)
    return out


def solve(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A tridiagonal system by elimination with row exchanges; zero pivots become tiny."""
    n = len(diagonal)
    tiny = EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0)) + np.finfo(float).tiny
    main, up, up2, b = diagonal.copy(), np.append(off, 0.0), np.zeros(n), right.copy()
    for k in range(n - 1):
        low, under, over = off[k], main[k + 1], up[k + 1]
        if abs(low) > abs(main[k]):
            factor = main[k] / low
            main[k], main[k + 1] = low, up[k] - factor * under
            up[k], up2[k], up[k + 1] = under, over, -factor * over
            b[k], b[k + 1] = b[k + 1], b[k] - factor * b[k + 1]
        else:
            main[k] = main[k] if abs(main[k]) > tiny else tiny
            factor = low / main[k]
            main[k + 1] = under - factor * up[k]
            b[k + 1] -= factor * b[k]
    x = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        pivot = main[k] if abs(main[k]) > tiny else tiny
        x[k] = (b[k] - up[k] * x[k + 1] - up2[k] * x[k + 2]) / pivot
    return x[:n]


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors, one a row; those of close eigenvalues are orthogonalised in each step."""
    rng = np.random.default_rng(12)
    near = 1e-3 * max(abs(values[0]), np.finfo(float).tiny)
    found: list[np.ndarray] = []
    for k, value in enumerate(values):
        first = k
        while first and values[first - 1] - values[first] < near:
            first -= 1
        x = rng.standard_normal(len(diagonal))
        for _ in range(6):
            x = solve(diagonal - value, off, x / np.linalg.norm(x))
            for _ in range(2):
                for other in found[first:k]:
                    x = x - (x @ other) * other
        found.append(x / np.linalg.norm(x))
    return np.array(found)


def leading(v: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues of a covariance that are not zero, and their unit vectors as rows."""
    number = min(number, len(v))
    scale = np.abs(v).max(initial=0.0)
    if not number or not scale:
        return np.zeros(0), np.zeros((0, len(v)))
    diagonal, off, mirrors = tridiagonal(v / scale)
    values = largest(diagonal, off, number)
    values = [e for e in values if e > 64 * len(v) * EPS * values[0]]
    out = vectors_of(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        u = mirrors[k]
        out[:, k + 1 :] -= 2 * np.outer(out[:, k + 1 :] @ u, u)
    return np.array(values) * scale, out


def moments(projection):
    """Count, mean and centred products of the whitened rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n, sums, weights = projection.value
        parts = []
        for batch in batches:
            if batch.num_rows:
                w = centred(matrix(batch.column(0), size), n, sums).astype(float) / n @ weights
                c = w - w.mean(0)
                parts.append((len(w), w.mean(0), c.T @ c))
        if parts:
            count, mean, products = merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([count]), pa.array([mean]), pa.array([products.ravel()])],
                names=["count", "mean", "products"],
            )

    return run


def merged(parts: list[tuple]) -> tuple:
    """Moments of all parts together."""
    count, mean, products = parts[0]
    for n, m, p in parts[1:]:
        gap = m - mean
        products = products + p + np.outer(gap, gap) * (count * n / (count + n))
        mean = mean + gap * (n / (count + n))
        count += n
    return count, mean, products


def projected(projection, explained: np.ndarray, error: float):
    """Every row, once for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n, sums, weights = projection.value
        k = weights.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            c = centred(matrix(batch.column(1), size), n, sums)
            widest = max(abs(int(c.max())), abs(int(c.min())))
            exact = c if size * widest * widest < LONG else c.astype(object)
            deviation = [int(v) if v < LONG else None for v in (exact * exact).sum(1)]
            rows = np.arange(len(c))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(rows, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(c))),
                    pa.array(np.full(len(c) * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(rows, k))),
                    pa.array((c.astype(float) / n @ weights).ravel()),
                    pa.array(np.tile(explained, len(c))),
                    pa.array(np.full(len(c) * k, error)),
                ],
                names=[f.split()[0] for f in WHITENED.split(", ")],
            )

    return run


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows of ``WHITENED`` for each vector and each of its leading components."""
    spark = vectors.sparkSession
    rows = scaled(vectors, column)
    fit = stage_table(rows.select("x").distinct(), "fit")
    n, size, longest = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if size != longest:
        raise ValueError("vectors of different lengths")
    if not size:
        return spark.createDataFrame([], WHITENED)
    found = fit.mapInArrow(sums_of(size), "dim bigint, high bigint, low bigint")
    found = found.groupBy("dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    sums = [(r.high << 32) + r.low for r in sorted(found, key=lambda r: r.dim)]
    products = "dim bigint, products array<double>"
    found = fit.mapInArrow(scatter_of(size, n, sums), products).groupBy("dim").applyInPandas(add_rows, products).collect()
    covariance = np.array([r.products for r in sorted(found, key=lambda r: r.dim)]) / n
    covariance = (covariance + covariance.T) / 2
    values, directions = leading(covariance, components)
    if not len(values):
        return spark.createDataFrame([], WHITENED)
    weights = directions.T / np.sqrt(values)
    projection = spark.sparkContext.broadcast((size, n, sums, weights))
    found = fit.mapInArrow(moments(projection), "count bigint, mean array<double>, products array<double>").collect()
    k = len(values)
    parts = [(r["count"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)) for r in found]
    count, _, spread = merged(parts)
    error = float(np.abs(spread / count - np.eye(k)).max())
    return rows.mapInArrow(projected(projection, values / np.trace(covariance), error), WHITENED)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
