"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 11).

The covariance V of the distinct vectors is never formed: all that is asked of the cluster are products V Q with a narrow matrix
Q, sums over blocks of centred X^T (X Q).  A Chebyshev polynomial of V, evaluated by its three-term recurrence, keeps the
unwanted end of the spectrum small and lets the leading directions grow; QR makes the basis orthonormal again, Rayleigh-Ritz turns
it to the eigenvectors in its span, and the residuals V u - e u certify them.  The driver holds matrices of
``dimensions x basis`` and nothing that grows with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rankeval.llm.vectors import valid
from rankeval.sources.staging import stage

PACK = 4096  # vectors in a block
TASK_BYTES = 1 << 27  # of blocks that one task of a pass reads, about
CERTIFIED = 1e-13  # of the largest eigenvalue
ACCEPTED = 1e-10  # where rounding lets the residuals fall no further
GROWTH = 3e7  # of the wanted directions against the others, in one round
PATIENCE = 5  # rounds with one basis; then it is made twice as wide
WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

Apply = Callable[[np.ndarray], np.ndarray]


# --- the subspace iteration: dense algebra on matrices of few columns ---


def chebyshev(apply: Apply, q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """A polynomial in V of this degree times ``q``: at most 1 in size on [low, high] relative to its value at ``top``."""
    half, mid = (high - low) / 2, (high + low) / 2
    first = factor = half / (top - mid)
    before, now = q, (apply(q) - mid * q) * (factor / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - factor)
        before, now = now, (apply(now) - mid * now) * (2 * following / half) - factor * following * before
        factor = following
    return now


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def leading(apply: Apply, dim: int, k: int, basis: int) -> Spectrum:
    """The ``k`` leading eigenpairs of a symmetric positive semidefinite matrix that is given by its products.

    Rounds of filter, QR and Rayleigh-Ritz go on until all ``k`` residuals are certified.  Where eigenvalues lie too close together
    for the basis it grows, at most to the whole space, which needs one product.  A matrix of zeros gives zeros.
    """
    passes, rounds, last, stalled = 0, 0, math.inf, 0
    rng = np.random.default_rng(11)

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return apply(q)

    width = min(dim, basis)
    q = np.eye(dim) if width == dim else np.linalg.qr(rng.standard_normal((dim, width)))[0]
    while True:
        image = counted(q)
        ritz = q.T @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        top = float(values[0])
        residual = float(np.linalg.norm(image[:, :k] - q[:, :k] * values[:k], axis=0).max())
        stalled = stalled + 1 if residual > last / 2 else 0
        if residual <= CERTIFIED * top or top <= 0 or width == dim or (stalled >= 2 and residual <= ACCEPTED * top):
            return Spectrum(np.maximum(values[:k], 0), q[:, :k], residual / top if top > 0 else 0.0, passes)
        last, rounds = residual, rounds + 1
        # what lies below the basis is damped; where the basis ends in the same cluster of values, what lies below that
        high = float(values[-1]) if values[-1] < (1 - 1e-5) * values[k - 1] else 0.98 * float(values[k - 1])
        if high > 1e-12 * top:
            growth = math.acosh(max(2 * float(values[k - 1]) / high - 1, 1.0))
            degree = min(32, max(4, math.ceil(math.log(GROWTH) / max(growth, 1e-9))))
            image = chebyshev(counted, q, degree, 0.0, high, top)
        if rounds % PATIENCE == 0:
            width = min(dim, 2 * width)
            image = np.hstack([image, rng.standard_normal((dim, width - image.shape[1]))])
        q = np.linalg.qr(image)[0]


# --- passes over the rows ---


def _integers(table: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``x``, floor(scale component) as integers, of the rows that take part."""
    rows = valid(table, id_col, vector_col).select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(fit: DataFrame, dim: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for a in range(0, len(x), PACK):
                part = x[a : a + PACK]
                narrow = -(1 << 31) <= part.min() and part.max() < 1 << 31
                yield pa.RecordBatch.from_pydict({"n": [len(part)], "data": [part.astype("<i4" if narrow else "<i8").tobytes()]})

    return fit.mapInArrow(task, "n long, data binary")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = data.as_py()
            yield np.frombuffer(data, "<i4" if len(data) == 4 * n * dim else "<i8").reshape(n, dim)


def _exact_sums(blocks: DataFrame, dim: int) -> list[int]:
    """Per dimension the exact sum of all entries."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for x in _blocks(batches, dim):
            wide = float(np.abs(x.astype(float)).max()) * len(x) >= 1 << 62
            total = [a + int(b) for a, b in zip(total, x.sum(0, dtype=object if wide else np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total, pa.decimal128(38, 0))], names=["i", "s"])

    sums = blocks.mapInArrow(task, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()  # one row per dimension
    return [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]


def _summed(blocks: DataFrame, dim: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of a matrix of this shape.  Tasks add up their blocks, the cells of their sums are then added by
    Spark, so the driver gets one matrix however many tasks there are."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _blocks(batches, dim):
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    cells = blocks.mapInArrow(task, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    return out.reshape(shape)


@dataclass
class Whitening:
    """A fitted transform: ``sums`` and ``n`` give the exact mean, ``vectors`` and ``values`` the components with variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # quotients of integers, rounded once

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the exact sum over dimensions of (n x - S)^2."""
        n, s = self.n, np.array(self.sums, object)
        reach = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max((abs(v) for v in self.sums), default=0)
        if reach * reach * max(1, x.shape[1]) < 1 << 63:
            return ((n * x.astype(np.int64) - s.astype(np.int64)) ** 2).sum(1).tolist()
        return [int(v) for v in ((n * x.astype(object) - s) ** 2).sum(1)]


def fit(rows: DataFrame, dim: int, k: int, basis: int = 32) -> Whitening | None:
    """Fit on each distinct ``x`` once; None without rows."""
    blocks = stage(_packed(rows.select("x").distinct(), dim))
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n * dim * 8 / TASK_BYTES))
    blocks = blocks.coalesce(tasks)
    sums = _exact_sums(blocks, dim)
    mean = np.array([s / n for s in sums])
    trace = float(_summed(blocks, dim, (1, 1), lambda x: np.square(x - mean).sum().reshape(1, 1))[0, 0]) / n

    def apply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(blocks, dim, q.shape, product) / n

    found = leading(apply, dim, min(k, dim), max(basis, 2 * k))
    varied = found.values > 1e-12 * trace if trace > 0 else np.zeros(len(found.values), bool)
    model = Whitening(n, sums, found.values[varied], found.vectors[:, varied], trace, 0.0, found.residual, found.passes)
    width = int(varied.sum())
    if width:
        def moments(x: np.ndarray) -> np.ndarray:
            z = model.transform(x)
            return np.vstack([z.T @ z, z.sum(0)])

        total = _summed(blocks, dim, (width + 1, width), moments) / n
        covariance = total[:-1] - np.outer(total[-1], total[-1])
        model.identity_error = float(np.abs(covariance - np.eye(width)).max())
    return model


def whiten(table: DataFrame, k: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row and component (from 1, by falling eigenvalue) the whitened coordinate: ``vec_id``, ``component``, ``n`` (distinct
    vectors), ``deviation`` (exact), ``whitened``, ``explained`` (share of the total variance), ``identity_error``.

    Vectors become integers floor(scale x); each distinct one counts once in the mean and the covariance, all rows are
    transformed.  Rows with a null id, or a vector that is null, empty or holds null or non-finite entries, are left out, and so are
    vectors of another length than most have (of lengths equally frequent the shorter).  A repeated row gives its rows again.  Components
    without variance (a share below 1e-12) are left out: with one distinct vector, or none, there are no rows.  Entries beyond 64 bits
    count as the limit.
    """
    rows = stage(_integers(table, scale, id_col, vector_col))
    some = rows.select(F.size("x").alias("d")).limit(1).collect()
    dim = some[0]["d"] if some else 0
    model = fit(rows, dim, k) if dim else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], WHITENED)
    width, explained = len(model.values), model.values / model.trace

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            m = len(x)
            deviations = pa.array([d for d in model.deviations(x) for _ in range(width)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column(0).to_numpy(), width)), pa.array(np.tile(np.arange(1, width + 1), m), pa.int32()),
                pa.array(np.full(m * width, model.n)), deviations, pa.array(model.transform(x).ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * width, model.identity_error)),
            ], names=[c.split()[0] for c in WHITENED.split(", ")])

    return rows.mapInArrow(task, WHITENED)
