"""Vectors in packed blocks: bounded rows of binary columns that one task multiplies at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LIMB = 20  # bits of a limb of a large component
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def valid(table: DataFrame, id_col: str, vector_col: str, nonzero: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """``row``, ``vec_id`` and ``v`` (doubles) of the rows that take part, and the columns ``more``: id and vector not null, the
    vector not empty, all its components finite; with ``nonzero`` not all of them 0."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, vec_id, matrix)`` of a batch of ``row``, ``vec_id``, ``v``, one for each length of its vectors."""
    row, ids, v = (batch.column(i) for i in range(3))
    row, ids = row.to_numpy(), ids.to_numpy()
    sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        which = np.flatnonzero(sizes == d)
        yield row[which], ids[which], flat[starts[which][:, None] + np.arange(d)]


def best(k: int, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray):
    """The ``k`` highest scores of each line, ties to smaller ids; all arguments have the shape of ``scores``."""
    order = np.lexsort((rows, ids, -scores))[:, :k]
    return tuple(np.take_along_axis(a, order, 1) for a in (scores, ids, rows))


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integral doubles as digits of ``LIMB`` bits, lowest first, each with its number's sign."""
    out, rest = [], x
    while rest.any() or not out:
        higher = np.trunc(rest / (1 << LIMB))
        out.append(rest - higher * (1 << LIMB))
        rest = higher
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of integral doubles, as exact 64-bit integers.

    Rows whose products may pass 2^53 are multiplied limb by limb; what passes 64 bits counts as the limit it passes.
    """
    largest = [np.abs(m).max(1, initial=0) for m in (q, c)]
    if not len(q) or not len(c) or largest[0].max() * largest[1].max() * q.shape[1] < EXACT:
        return (q @ c.T).astype(np.int64)
    out = np.zeros((len(q), len(c)), np.int64)
    big = largest[1] * largest[0].max() * q.shape[1] >= EXACT
    out[:, ~big] = products(q, c[~big]) if (~big).any() else 0
    total = np.zeros((len(q), int(big.sum())), object)
    for i, a in enumerate(_limbs(q)):
        for j, b in enumerate(_limbs(c[big])):
            part = (a @ b.T).astype(np.int64)
            if part.any():
                total += part.astype(object) * (1 << LIMB * (i + j))
    out[:, big] = np.clip(total, LEAST, MOST).astype(np.int64)
    return out
