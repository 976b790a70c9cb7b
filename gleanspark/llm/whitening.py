"""Embedding whitening: principal components of all vectors, to double precision, and every vector's coordinates in them.

The covariance is summed by tasks, a matrix each, and added up by rows of the matrix.  Its eigenvectors start in float32 and
are corrected by the iteration of Ogita and Aishima: from the residuals of orthogonality and of diagonality, by matrix products
in extended precision, each round squares the error.  Eigenvalues that are too close for the first-order correction form
a cluster; its invariant subspace is corrected as a whole, and a small eigenproblem, shifted so that only the differences are
left, turns the vectors within it.  Only sums, the matrix and the components are on the driver: they grow with the dimension,
not with the rows.

Defined cases: vectors that are null or hold null or non-finite entries, and empty ones, are dropped, and so are those whose
number of entries is not the usual one (the most frequent); repeated rows count each, and null or repeated ids are returned as
they are; floor(64 * c) counts as 2^40 beyond that, either way; a deviation beyond a long is null; components without variance
(under 10^-12 of the trace; all of them for fewer than two different vectors) are not returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.vectors import finite, matrix, scaled_floor, sums_by_key, usual_size

#: Fixed values of the integer grid: x = floor(64 * c) + 1,000,000.
GRID, SHIFT, MOST = 64, 1_000_000, 1 << 40
#: Components under this share of the trace have no variance; rounds of the correction at most; rows that a step takes up.
NO_VARIANCE, ROUNDS, STEP = 1e-12, 12, 4096


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns) of a symmetric matrix, correct to double precision."""
    d, scale = len(v), float(np.trace(v)) / max(1, len(v))
    if scale <= 0:
        return np.zeros(d), np.eye(d)
    a = (np.asarray(v, dtype=np.longdouble) / scale + (np.asarray(v, dtype=np.longdouble) / scale).T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm, eye = np.sqrt((a * a).sum()), np.eye(d, dtype=np.longdouble)
    for _ in range(ROUNDS):
        r = eye - x.T @ x
        s = x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        unsure = 2 * (np.sqrt(((s - np.diag(np.diag(s))) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
        small = np.finfo(np.longdouble).eps * d
        if unsure <= 16 * small * norm:  # what is left is rounding
            break
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > unsure
        step = np.triu(np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2))
        step += np.triu(r - step, 1).T  # both halves add up to r, or rounding over a small gap would spoil the angles
        x = x + x @ step
        cuts = np.flatnonzero(values[:-1] - values[1:] > unsure) + 1
        clusters = [j for j in np.split(np.arange(d), cuts) if len(j) > 1]
        for j in clusters:
            q, middle = x[:, j], values[j].mean()
            inner = q.T @ (a @ q - middle * q)
            inner = (inner + inner.T) / 2
            size = np.abs(inner).max()
            if size > small:
                q = q @ np.linalg.eigh((inner / size).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
                x[:, j] = q + q @ (np.eye(len(j), dtype=np.longdouble) - q.T @ q) / 2
    values = np.array([x[:, i] @ a @ x[:, i] / (x[:, i] @ x[:, i]) for i in range(d)])
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return np.maximum(values[order], 0).astype(np.float64) * scale, x.astype(np.float64)


def _deviations(batch: pa.RecordBatch, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact as long as the result fits a long: what overflows on the way comes back in two's complement."""
    wrapped = np.array([s & (2**64 - 1) for s in sums], dtype=np.uint64).astype(np.int64)
    return matrix(batch.column("x"), len(sums)) * np.int64(n) - wrapped


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, STEP):
            yield batch.slice(i, STEP)


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance (divisor n) of ``x`` over all rows; the only things collected are the d rows of the matrix."""
    d = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in _steps(batches):
            y = _deviations(batch, n, sums) / n
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["key", "part"])

    found = {r.key: r.total for r in sums_by_key(rows.select("x").mapInArrow(products, "key int, part array<double>")).collect()}
    return np.array([found[i] for i in range(d)]) / n


def whitening(table: DataFrame, most: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to ``most``."""
    spark = table.sparkSession
    kind = dict(table.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = table.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")).where(finite(F.col("v")))
    d = usual_size(good, "v")
    rows = good.where(F.size("v") == d).select("id", F.transform(scaled_floor(F.col("v"), GRID, MOST), lambda c: c + SHIFT).alias("x"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            x = matrix(batch.column("x"), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, len(x))), pa.array(np.arange(d, dtype=np.int32)), pa.array(x.sum(0))], names=["n", "dim", "s"])

    by_dim = rows.select("x").mapInArrow(added, "n long, dim int, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = by_dim.orderBy("dim").collect() if d else []
    if not found:
        return spark.createDataFrame([], schema)
    n, sums = found[0].n, [int(r.s) for r in found]
    values, vectors = eigenvectors(covariance(rows, n, sums))
    total = float(values.sum())
    keep = [i for i in range(min(most, d)) if total > 0 and values[i] > NO_VARIANCE * total]
    if not keep:
        return spark.createDataFrame([], schema)
    towards = vectors[:, keep] / np.sqrt(values[keep])
    k = len(keep)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, plain = np.zeros((k, k)), np.zeros((1, k))
        for batch in _steps(batches):
            w = (_deviations(batch, n, sums) / n) @ towards
            square += w.T @ w
            plain += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(np.vstack([square, plain]).tolist(), pa.list_(pa.float64()))], names=["key", "part"])

    parts = {r.key: np.array(r.total) / n for r in sums_by_key(rows.select("x").mapInArrow(squares, "key int, part array<double>")).collect()}
    second = np.array([parts[i] for i in range(k)]) - np.outer(parts[k], parts[k])
    error, explained = float(np.abs(second - np.eye(k)).max()), values[keep] / total

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            y = _deviations(batch, n, sums)
            near = (y.astype(float) ** 2).sum(1)
            deviation = pa.array((y * y).sum(1), mask=(near > 9.2e18) | (np.abs(matrix(batch.column("x"), d).astype(float) * n - np.array(sums, dtype=float)).max(1) > 3e9))
            m, w = batch.num_rows, (y / n) @ towards
            row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(pa.array(row)), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", key)
