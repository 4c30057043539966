"""Exact top-k by integer inner product, pruned with segment statistics (operator 6).

A vector's segments have means and deviations; x.y is at most the sum over segments of m (mean mean + deviation deviation),
m the segment's length, which equals a lower bound on the distance of x and y.  Bounds are taken from few long segments
to many short ones; products are computed for the pairs that no level rules out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from rankeval.llm.vectors import EXACT, LEAST, matrices, products, valid
from rankeval.sources.staging import stage

BLOCK = "dim int, n int, rows binary, ids binary, data binary"
LEVELS = (4, 16)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the means and deviations of its segments, scaled so that a product of two rows is the bound."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        part = x[:, a:b]
        out += [part.mean(1) * np.sqrt(b - a), part.std(1) * np.sqrt(b - a)]
    return np.stack(out, 1)


class Queries:
    """A block of queries with the best candidates so far, of all blocks that it has met.

    Scores are compared as doubles while they lie below 2^53; of larger ones the doubles choose, with room for their rounding, and
    exact integers decide.
    """

    def __init__(self, k: int, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.k, self.rows, self.ids, self.x = k, rows, ids, x
        self.largest = np.abs(x).max(initial=0)
        self.levels = [segment_statistics(x, s) for s in LEVELS]
        self.score = np.full((len(x), k), -np.inf)
        self.exact = np.full((len(x), k), LEAST)
        self.vec = np.full((len(x), k), np.iinfo(np.int64).max)
        self.row = np.full((len(x), k), -1)

    def meet(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, levels: list[np.ndarray]) -> None:
        least = self.score[:, -1:]
        open_ = self.rows[:, None] != rows[None]
        for own, other in zip(self.levels, levels):  # coarse to fine
            bound = own @ other.T
            open_ &= bound + (np.abs(bound) * 1e-9 + 1) >= least
            if not open_.any():
                return
        which = np.flatnonzero(open_.any(1))
        large = self.largest * np.abs(x).max(initial=0) * x.shape[1] >= EXACT
        if large or open_.mean() > 0.05:
            scores = self.x[which] @ x.T
        else:
            q, c = np.nonzero(open_[which])
            scores = np.full((len(which), len(x)), -np.inf)
            scores[q, c] = np.einsum("ij,ij->i", self.x[which][q], x[c])
        scores[~open_[which]] = -np.inf
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
        if scores.shape[1] > 4 * self.k:  # only what reaches the k-th highest, ties with it included
            least = np.partition(scores, -self.k, axis=1)[:, -self.k]
            if large:
                least = least - np.abs(least) * 1e-9
            width = int((scores >= least[:, None]).sum(1).max())
            if width < scores.shape[1]:
                at = np.argsort(-scores, axis=1, kind="stable")[:, :width]
                scores = np.take_along_axis(scores, at, 1)
        found = scores > -np.inf
        if large:
            exact = np.take_along_axis(products(self.x[which], x), at, 1)
        else:
            exact = np.where(found, scores, 0).astype(np.int64)
        state = [np.concatenate([own[which], new], 1) for own, new in zip(
            (self.score, self.exact, self.vec, self.row), (scores, np.where(found, exact, LEAST), ids[at], rows[at]))]
        score, exact, vec, row = state
        order = np.lexsort((row, vec, ~exact, score == -np.inf))[:, : self.k]
        self.score[which], self.exact[which], self.vec[which], self.row[which] = (np.take_along_axis(a, order, 1) for a in state)

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.score > -np.inf)
        columns = [self.rows[q], self.ids[q], self.row[q, j], self.vec[q, j], self.exact[q, j]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q_row", "query_id", "c_row", "vec_id", "score"])


def _blocks(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length, components floor(scale x), in four bytes where they fit."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, x in matrices(batch):
                x = np.floor(x * scale)
                for a in range(0, len(row), size):
                    s = slice(a, a + size)
                    kind = "<i4" if np.abs(x[s]).max(initial=0) < 1 << 31 else "<f8"
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([x.shape[1]], pa.int32()), "n": pa.array([len(row[s])], pa.int32()), "rows": [row[s].tobytes()],
                        "ids": [ids[s].tobytes()], "data": [x[s].astype(kind).tobytes()],
                    })

    return rows.mapInArrow(task, BLOCK)


def _unpack(parts: list[dict]):
    d = parts[0]["dim"]
    join = lambda name: np.frombuffer(b"".join(p[name] for p in parts), "<i8")
    kind = lambda p: "<i4" if len(p["data"]) == 4 * p["n"] * d else "<f8"
    return join("rows"), join("ids"), np.concatenate([np.frombuffer(p["data"], kind(p)).astype(float).reshape(-1, d) for p in parts])


def search(
    table: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = 2048, spread: int = 64,
) -> DataFrame:
    """The ``k`` highest integer products of each query (ids divisible by ``every``) with all rows but its own:
    ``query_id``, ``rank``, ``vec_id``, ``score``; equal scores to smaller ids.

    Candidates and queries are packed into blocks; each block of candidates meets each block of queries, dealt by
    (query block, candidate block mod ``spread``).  A tile gets its queries once; a task holds them, one block of candidates and
    the queries' best so far.  Vectors that are null, empty or hold null or non-finite components take no part, nor do null
    ids; vectors of different lengths do not meet; a repeated id is a row of its own.  Scores beyond 64 bits count as the limit.
    """
    rows = stage(valid(table, id_col, vector_col))
    queries = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-queries.count() // block))
    asked = stage(_blocks(queries, scale, block).withColumn("g", F.monotonically_increasing_id()).withColumn("g", F.pmod(F.hash("g"), F.lit(groups))))
    asks = asked.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("side", F.lit(0))
    held = _blocks(rows, scale, block).withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int")).withColumn("side", F.lit(1))
    held = held.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cols = ["g", "dim", "s", "side", "n", "rows", "ids", "data"]
    tiles = asks.select(cols).unionByName(held.select(cols)).repartition("g", "dim", "s").sortWithinPartitions("g", "dim", "s", "side")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, best_so_far = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if key != (now := (r["g"], r["dim"], r["s"])):
                    if best_so_far:
                        yield best_so_far.found()
                    key, parts, best_so_far = now, [], None
                if r["side"] == 0:
                    parts.append(r)
                elif parts:
                    best_so_far = best_so_far or Queries(k, *_unpack(parts))
                    ids_and_x = _unpack([r])
                    best_so_far.meet(*ids_and_x, [segment_statistics(ids_and_x[2], s) for s in LEVELS])
        if best_so_far:
            yield best_so_far.found()

    found = tiles.mapInArrow(task, "q_row long, query_id long, c_row long, vec_id long, score long")
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "c_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
