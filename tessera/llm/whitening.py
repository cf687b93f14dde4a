"""Whitening of embeddings by a randomised range finder.

All rows are whole numbers x (scaled and rounded down), so their sums are exact. A random basis of a few more columns than the
wanted components is multiplied by the covariance of all centred rows, again and again (power passes). Each pass also gives
the covariance within the basis: its eigenvectors (Rayleigh-Ritz) are the components, and the residuals of the covariance on
them tell how far they are off. Where residuals against the gaps between eigenvalues are still above TOLERANCE after PASSES
passes, the basis grows to the full dimension, for which one pass is exact. Tasks send one matrix of dimension times
columns each; matrices are added in groups of FAN tasks until FAN are left, in order of the tasks.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do those of another length
than the most frequent one (the longer of equally frequent ones). Components without variance (fewer rows than components, equal rows)
are left out: they can't be scaled. Rows of one id are rows each, ids may be null; a deviation beyond a long is null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read
from .topk import finite

#: Columns of the random basis beyond the components, power passes before the basis grows, and the error of a component's
#: direction (residual over gap) that is taken for double precision.
OVERSAMPLING, PASSES, TOLERANCE = 10, 4, 1e-12
#: Matrices of tasks that are added at a time, and that the driver gets at most.
FAN = 64


def whole(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that take part, floor(scale * c) of each of their components)."""
    rows = np.flatnonzero(np.asarray(column.is_valid()) & (np.asarray(column.value_lengths().fill_null(0)) == dim))
    flat = column.take(pa.array(rows)).flatten()
    y = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dim)
    good = np.isfinite(y).all(axis=1)
    return rows[good], np.floor(scale * y[good])


def integers(y: np.ndarray, most: float) -> np.ndarray:
    """y as 64-bit integers, or as Python's where most isn't below 2^62."""
    return y.astype(np.int64) if most < 2.0**62 else np.array([[int(v) for v in r] for r in y.tolist()], object).reshape(y.shape)


def added(rows: DataFrame, term: Callable[[np.ndarray], tuple], dim: int, scale: float) -> tuple | None:
    """The sum of term over the batches of all rows (embedding): a tuple of arrays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = whole(batch.column(0), dim, scale)[1]
            if len(y):
                t = term(y)
                total = t if total is None else tuple(a + b for a, b in zip(total, t))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(total, 5)], pa.binary())], names=["part", "sums"])

    def merged(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((p, s) for batch in group for p, s in zip(batch["part"].to_pylist(), batch["sums"].to_pylist()))
        total = pickle.loads(got[0][1])
        for _, s in got[1:]:
            total = tuple(a + b for a, b in zip(total, pickle.loads(s)))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([pickle.dumps(total, 5)], pa.binary())], names=["part", "sums"])

    have = cut(rows.select("embedding").mapInArrow(sums, "part int, sums binary"))
    while have.count() > FAN:
        have = cut(have.groupBy(F.floor(F.col("part") / FAN).cast("int").alias("group")).applyInArrow(merged, "part int, sums binary"))
    total = None
    for r in have.orderBy("part").toLocalIterator():
        t = pickle.loads(r["sums"])
        total = t if total is None else tuple(a + b for a, b in zip(total, t))
    return total


@dataclass
class Fit:
    """What whitens: n rows of dim components, their sums (of floor(scale * c)), the components as columns, and eigenvalues."""

    scale: float
    dim: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    grown: bool

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, y: np.ndarray) -> np.ndarray:
        return (y - self.mean) @ self.components / np.sqrt(self.values)


def fit(vectors: DataFrame, k: int = 8, scale: float = 1024.0, oversampling: int = OVERSAMPLING, passes: int = PASSES, tolerance: float = TOLERANCE) -> Fit | None:
    """The first k components of all vectors (embedding). None without vectors."""
    lengths = vectors.filter(finite(F.col("embedding")) & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("dim")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    if first is None:
        return None
    dim, n = int(first["dim"]), int(first["count"])
    (sums,) = added(vectors, lambda y: (integers(y, float(np.abs(y).max()) * len(y)).sum(axis=0).astype(object),), dim, scale)
    mean = np.array([int(s) / n for s in sums])

    def pass_over(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times basis, and the trace of the covariance."""

        def term(y: np.ndarray) -> tuple:
            c = y - mean
            return c.T @ (c @ basis), np.array((c * c).sum())

        z, trace = added(vectors, term, dim, scale)
        return z / n, float(trace) / n

    def ritz(basis: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Values and vectors within the basis, falling, and the worst error of a direction."""
        inner = basis.T @ z
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        off = np.linalg.norm(z @ turn[:, :k] - (basis @ turn[:, :k]) * values[:k], axis=0)
        gaps = np.abs(values[:k, None] - values[None, :])
        np.fill_diagonal(gaps, np.inf)
        gap = gaps.min(axis=1)
        return values[:k], (basis @ turn)[:, :k], float((off / np.maximum(gap, np.finfo(float).tiny)).max())

    columns = min(dim, k + oversampling)
    basis = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, columns)))[0]
    error = np.inf
    for _ in range(passes if columns < dim else 0):
        z, trace = pass_over(basis)
        values, components, error = ritz(basis, z)
        if error <= tolerance:
            break
        basis = np.linalg.qr(z)[0]
    grown = not error <= tolerance
    if grown:
        basis = np.eye(dim)
        z, trace = pass_over(basis)
        values, components, _ = ritz(basis, z)
    real = values > dim * 10 * np.finfo(float).eps * max(float(values[0]), 0.0) if len(values) else np.zeros(0, bool)
    components, values = components[:, real], values[real]
    sign = np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    return Fit(scale, dim, n, [int(s) for s in sums], components * sign, values, trace, grown)


def identity_error(vectors: DataFrame, fitted: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""

    def term(y: np.ndarray) -> tuple:
        w = fitted.whitened(y)
        return w.T @ w, w.sum(axis=0)

    products, sums = added(vectors, term, fitted.dim, fitted.scale)
    covariance = products / fitted.n - np.outer(sums, sums) / fitted.n**2
    return float(np.abs(covariance - np.eye(len(fitted.values))).max()) if len(fitted.values) else 0.0


WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, k: int = 8, scale: float = 1024.0, **settings) -> DataFrame:
    """vectors: vec_id, embedding. A row for each vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    fitted = fit(vectors, k, scale, **settings)
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], WHITE)
    error, n, m, sums = identity_error(vectors, fitted), fitted.n, len(fitted.values), fitted.sums
    explained = fitted.values / fitted.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, y = whole(batch.column(1), fitted.dim, fitted.scale)
            if not len(at):
                continue
            most = float(np.abs(y).max()) * n + max(abs(s) for s in sums)
            dev = integers(y, fitted.dim * most * most * 2) * n
            dev = dev - np.array(sums, dtype=dev.dtype)
            dev = (dev * dev).sum(axis=1)
            dev = pa.array([int(v) if v < 2**63 else None for v in dev.tolist()], pa.int64())
            each = pa.array(np.repeat(np.arange(len(at)), m))
            fixed = [pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * m, n))]
            out = [batch.column(0).take(pa.array(at)).take(each), *fixed, dev.take(each), pa.array(fitted.whitened(y).reshape(-1)), pa.array(np.tile(explained, len(at))), pa.array(np.full(len(at) * m, error))]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(rows, WHITE)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
