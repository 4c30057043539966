"""Approximate nearest neighbours over shifted Hilbert orderings of projected vectors (operator 7).

Each of several curves projects the vectors to a few directions of its own, shifts them and sorts them by Hilbert key; Spark's
range partitioning does the sort, and consecutive vectors are packed into blocks.  A query meets the blocks within a window
around its own on every curve; what they find is merged and ranked by the exact inner product.  The window's width is read
off a bounded sample of queries whose true neighbours are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from rankeval.llm.vectors import best, matrices, valid
from rankeval.sources.staging import stage

BLOCK = "part int, no long, curve int, dim int, n int, rows binary, ids binary, data binary"
FOUND = "q_row long, query_id long, c_row long, vec_id long, score double"
HELD = 1 << 16  # queries whose best a task keeps before it writes them out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points with coordinates below 2^bits, one point per row.

    Gray-code method: from the highest bit down, coordinates whose bit is set invert the lower bits of the first
    coordinate, others exchange them with it; then the bits are interleaved and the Gray code undone.
    """
    x = cells.T.astype(np.uint64).copy()
    n, one = len(x), np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(n):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = one << np.uint64(bits - 1)
    while q > one:
        flip ^= np.where((x[-1] & q) != 0, q - one, 0).astype(np.uint64)
        q >>= one
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_keys(x: np.ndarray, curve: int, dims: int, bits: int) -> np.ndarray:
    """Keys of a matrix's rows on one curve: directions and shift are drawn from the curve's number.

    Rows are taken at length 1, so a projection on an orthonormal direction is about normal with deviation d^-1/2; four
    deviations to each side are cut into 2^bits cells.
    """
    rng = np.random.default_rng([7, curve, x.shape[1]])
    basis = np.linalg.qr(rng.standard_normal((x.shape[1], min(dims, x.shape[1]))))[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = unit @ basis * np.sqrt(x.shape[1]) / 8 + 0.5 + rng.uniform(-0.125, 0.125, basis.shape[1])
    return hilbert_keys(np.clip(np.floor(at * (1 << bits)), 0, (1 << bits) - 1).astype(np.int64), bits)


def _keyed(rows: DataFrame, curves: int, dims: int, bits: int) -> DataFrame:
    schema = "curve int, dim int, key long, row long, vec_id long, v array<double>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, x in matrices(batch):
                n, d = x.shape
                v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), pa.array(x.ravel()))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, c), pa.int32()), pa.array(np.full(n, d), pa.int32()), pa.array(curve_keys(x, c, dims, bits)), pa.array(row), pa.array(ids), v],
                        names=["curve", "dim", "key", "row", "vec_id", "v"],
                    )

    return rows.mapInArrow(task, schema)


def _ordered(keyed: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` consecutive vectors of one curve and length; ``at``: the block's place among all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, held, key = TaskContext.get().partitionId(), 0, [], None

        def close():
            nonlocal no, held
            rows, ids, v = (b"".join(h[i].tobytes() for h in held) for i in range(3))
            out = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "no": [no], "curve": pa.array([key[0]], pa.int32()), "dim": pa.array([key[1]], pa.int32()),
                "n": pa.array([len(rows) // 8], pa.int32()), "rows": [rows], "ids": [ids], "data": [v],
            })
            no, held = no + 1, []
            return out

        for batch in batches:
            curve, dim = (batch.column(i).to_numpy() for i in range(2))
            cuts = [0, *(np.flatnonzero((np.diff(curve) != 0) | (np.diff(dim) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and key != (curve[a], dim[a]):
                    yield close()
                key = (curve[a], dim[a])
                row, ids = (batch.column(i).to_numpy()[a:b] for i in (3, 4))
                x = batch.column(5).slice(a, b - a).flatten().to_numpy().reshape(b - a, dim[a])
                while len(row):
                    room = size - sum(len(h[0]) for h in held)
                    held.append((row[:room], ids[:room], x[:room]))
                    row, ids, x = row[room:], ids[room:], x[room:]
                    if sum(len(h[0]) for h in held) == size:
                        yield close()
        if held:
            yield close()

    order = ["dim", "curve", "key", "row"]
    blocks = stage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(task, BLOCK))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("blocks")).withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    return blocks.join(parts.select("part", "base"), "part").withColumn("at", F.col("base") + F.col("no")).drop("part", "no", "base")


class Nearest:
    """The best candidates so far of the queries that a task has met."""

    def __init__(self, k: int):
        self.k, self.state = k, {}

    def meet(self, qrow, qid, q, row, ids, x) -> None:
        scores = q @ x.T
        scores[qrow[:, None] == row[None]] = -np.inf
        k = min(self.k, scores.shape[1])
        least = np.partition(scores, -k, axis=1)[:, -k]
        for i, r in enumerate(qrow.tolist()):
            old = self.state.get(r)
            bound = max(least[i], old[1][-1]) if old and len(old[1]) == self.k else least[i]
            at = np.flatnonzero((scores[i] >= bound) & (scores[i] > -np.inf))
            if not len(at):
                continue
            s, v, c = scores[i, at], ids[at], row[at]
            if old:
                new = ~np.isin(c, old[3])  # another curve may have brought it
                s, v, c = np.concatenate([old[1], s[new]]), np.concatenate([old[2], v[new]]), np.concatenate([old[3], c[new]])
            s, v, c = best(self.k, s[None], v[None], c[None])
            self.state[r] = (qid[i], s[0], v[0], c[0])

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.state:
            rows = [(r, i, c, v, s) for r, (i, ss, vs, cs) in self.state.items() for s, v, c in zip(ss, vs, cs)]
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[n.split()[0] for n in FOUND.split(", ")])
        self.state = {}


def _unpack(r: dict):
    return np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"])


def _meet(tiles: DataFrame, k: int) -> DataFrame:
    """Best of queries over rows sorted by tile, in each the candidates' block first and blocks of queries after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, key, block = Nearest(k), None, None
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if r["asks"] == 0:
                    key, block = (r["dim"], r["tile"]), _unpack(r)
                elif key == (r["dim"], r["tile"]):
                    near.meet(*_unpack(r), *block)
                    if len(near.state) > HELD:
                        yield from near.take()
        yield from near.take()

    cols = ["dim", "tile", "asks", "rows", "ids", "data"]
    return tiles.repartition("dim", "tile").sortWithinPartitions("dim", "tile", "asks").select(cols).mapInArrow(task, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "c_row")
    once = found.groupBy("q_row", "query_id", "c_row", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asking(blocks: DataFrame, every: int) -> DataFrame:
    """Blocks reduced to their queries."""
    schema = "at long, curve int, dim int, n int, rows binary, ids binary, data binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, ids, x = _unpack(r)
                own = ids % every == 0
                if own.any():
                    yield pa.RecordBatch.from_pydict({
                        "at": [r["at"]], "curve": pa.array([r["curve"]], pa.int32()), "dim": pa.array([r["dim"]], pa.int32()), "n": pa.array([int(own.sum())], pa.int32()),
                        "rows": [rows[own].tobytes()], "ids": [ids[own].tobytes()], "data": [np.ascontiguousarray(x[own]).tobytes()],
                    })

    return blocks.select("at", "curve", "dim", "n", "rows", "ids", "data").mapInArrow(task, schema)


def window_width(rows: DataFrame, blocks: DataFrame, every: int, k: int, recall: float, sample: int) -> int:
    """Blocks to each side so that ``recall`` of the true neighbours of at most ``sample`` queries (smallest hash of their
    row) lie inside the window of some curve."""
    asked = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id", "row")).limit(sample).toArrow()
    queries = list(matrices(b) for b in asked.combine_chunks().to_batches())
    queries = [q for group in queries for q in group]  # at most `sample` vectors go with the tasks

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(k)
        for batch in batches:
            for row, ids, x in matrices(batch):
                for qrow, qid, q in queries:
                    if q.shape[1] == x.shape[1]:
                        near.meet(qrow, qid, q, row, ids, x)
        yield from near.take()

    truth = _top(rows.mapInArrow(task, FOUND), k).select("q_row", "c_row")
    places = "row long, at long, curve int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, curve, packed in zip(*(c.to_pylist() for c in batch.columns)):
                r = np.frombuffer(packed, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.full(len(r), at)), pa.array(np.full(len(r), curve), pa.int32())], names=["row", "at", "curve"])

    where = blocks.select("at", "curve", "rows").mapInArrow(place, places)
    pairs = truth.join(where.select(F.col("row").alias("q_row"), F.col("at").alias("qa"), "curve"), "q_row")
    pairs = pairs.join(where.select(F.col("row").alias("c_row"), F.col("at").alias("ca"), "curve"), ["c_row", "curve"])
    away = pairs.groupBy("q_row", "c_row").agg(F.min(F.abs(F.col("qa") - F.col("ca"))).alias("away"))
    return int(away.agg(F.percentile("away", F.lit(recall))).first()[0] or 0) + 1


def search(
    table: DataFrame, every: int = 20, k: int = 20, curves: int = 4, dims: int = 8, bits: int = 6, block: int = 1024,
    recall: float = 0.95, sample: int = 256, window: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest found of each query (ids divisible by ``every``) among all rows but its own: ``query_id``, ``rank``,
    ``vec_id`` and ``score``, the inner product in double precision; equal scores to smaller ids.

    ``window``: blocks to each side of the query's own on each curve; where it is not given, it is fitted so that the
    neighbours of a bounded sample reach ``recall``.  All rows are on every curve.  Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do null ids; vectors of different lengths do not meet; a repeated
    id is a row of its own; with fewer candidates than ``k`` all that the windows hold are returned.
    """
    rows = stage(valid(table, id_col, vector_col, nonzero=True))
    blocks = stage(_ordered(_keyed(rows, curves, dims, bits), block))
    if window is None:
        window = window_width(rows, blocks, every, k, recall, sample)
    ends = blocks.groupBy("dim", "curve").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    asks = _asking(blocks, every).join(ends, ["dim", "curve"])
    tile = F.explode(F.sequence(F.greatest(F.col("at") - window, F.col("lo")), F.least(F.col("at") + window, F.col("hi"))))
    asks = asks.withColumn("tile", tile).withColumn("asks", F.lit(1))
    held = blocks.withColumn("tile", F.col("at")).withColumn("asks", F.lit(0))
    cols = ["dim", "tile", "asks", "rows", "ids", "data"]
    return _top(_meet(held.select(cols).unionByName(asks.select(cols)), k), k).select("query_id", "rank", "vec_id", "score")
