"""Hard-negative mining by a secondary sort (operator 12).

Anchors are a stated query set that is scored against all rows in blocks, twice.  The first round finds each anchor's
positives, which fix the windows of scores in which its hard negatives lie; the second keeps per window the first few
rows of a block that lie in it.  Pairs travel as packed keys (anchor, descending score, kind, id): Spark deals them by anchor and
sorts them, so a task streams over them in the order in which windows open and fill, and holds an anchor's open windows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from rankeval.llm.vectors import LEAST, matrices, products, valid
from rankeval.sources.staging import stage

BLOCK = "g int, dim int, rows binary, ids binary, labels binary, scores binary, data binary"
PAIR = "a_row long, anchor_id long, row long, vec_id long, score long"
PACKED = "a_row long, anchor_id long, key binary"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_SIGN = 1 << 63
_ALL = (1 << 64) - 1


def pack_key(anchor: int, score: int, negative: bool, vec_id: int, row: int) -> bytes:
    """Keys that sort, byte by byte, by anchor, falling score, positives before negatives, id and row."""
    parts = (anchor + _SIGN, _ALL - (score + _SIGN)), (int(negative),), (vec_id + _SIGN, row + _SIGN)
    return b"".join(x.to_bytes(1 if i == 1 else 8, "big") for i, p in enumerate(parts) for x in p)


def unpack_key(key: bytes) -> tuple[int, int, bool, int, int]:
    number = lambda a: int.from_bytes(key[a : a + 8], "big")
    return number(0) - _SIGN, _ALL - number(8) - _SIGN, key[16] == 1, number(17) - _SIGN, number(25) - _SIGN


def first(k: int, group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the first ``k`` of each group: highest score, then smallest id, then row."""
    order = np.lexsort((rows, ids, ~score, group))
    ranked = group[order]
    start = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[place < k]


class Kept:
    """The first ``k`` pairs of each line so far, over all blocks that have been met."""

    def __init__(self, k: int):
        self.k, self.held = k, [np.zeros(0, np.int64) for _ in range(4)]  # line, score, id, row

    def meet(self, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` and ``fits`` have a line per group and a column per row of the block."""
        if scores.shape[1] > self.k:  # a score below the block's k-th of its line is out
            masked = np.where(fits, scores, LEAST)
            fits = fits & (masked >= np.partition(masked, -self.k, axis=1)[:, -self.k, None])
        line, at = np.nonzero(fits)
        self.held = [np.concatenate(x) for x in zip(self.held, (line, scores[line, at], ids[at], rows[at]))]
        keep = first(self.k, *self.held)
        self.held = [x[keep] for x in self.held]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores from ``low`` to ``high`` hundredths of a positive's, as integers; empty (first above last) below 0."""
    return -(-low * score // 100), high * score // 100


def _blocks(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """Vectors of one group and length in blocks of at most ``size``, components floor(scale x)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for g in np.unique(groups := whole.column(5).to_numpy()).tolist():
                batch = whole.filter(pa.array(groups == g))
                for at, ids, x in matrices(pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), *batch.columns[1:3]], names=["row", "vec_id", "v"])):
                    x = np.floor(x * scale)
                    row, labels = (batch.column(i).to_numpy()[at] for i in (0, 3))
                    scores = batch.column(4).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                    for a in range(0, len(at), size):
                        s = slice(a, a + size)
                        numbers = {"rows": row, "ids": ids, "labels": labels, "scores": scores, "data": x}
                        kinds = {"data": "<i4"} if np.abs(x[s]).max() < 1 << 31 else {"data": "<f8"}
                        packed = {n: pa.array([v[s].astype(kinds.get(n, "<i8")).tobytes()], pa.binary()) for n, v in numbers.items()}
                        yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "dim": pa.array([x.shape[1]], pa.int32()), **packed})

    return rows.select("row", "vec_id", "v", "label", "scores", "g").mapInArrow(task, BLOCK)


class Unpacked:
    """The vectors of blocks laid end to end."""

    def __init__(self, parts: list[dict]):
        whole = lambda name: np.frombuffer(b"".join(p[name] for p in parts), "<i8")
        self.rows, self.ids, self.labels = whole("rows"), whole("ids"), whole("labels")
        self.scores = whole("scores").reshape(len(self.rows), -1)
        kind = lambda p: "<f8" if len(p["data"]) == len(p["rows"]) * p["dim"] else "<i4"
        self.x = np.concatenate([np.frombuffer(p["data"], kind(p)).astype(float).reshape(-1, p["dim"]) for p in parts])


def _meet(anchors: DataFrame, others: DataFrame, groups: int, spread: int, kept: Callable[[Unpacked], object]) -> DataFrame:
    """``PAIR``s that ``kept`` holds after each group of anchors has met each block, dealt by (group, block mod ``spread``): a tile
    holds its anchors once and meets its blocks one after the other."""
    asks = anchors.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("side", F.lit(0))
    held = others.withColumn("s", F.pmod(F.xxhash64("rows"), F.lit(spread)).cast("int"))
    held = held.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("side", F.lit(1))
    cols = ["dim", "g", "s", "side", "rows", "ids", "labels", "scores", "data"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, state = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if key != (now := (r["dim"], r["g"], r["s"])):
                    if state is not None:
                        yield state.pairs()
                    key, parts, state = now, [], None
                if r["side"] == 0:
                    parts.append(r)
                elif parts:
                    state = state or kept(Unpacked(parts))
                    state.meet(Unpacked([r]))
        if state is not None:
            yield state.pairs()

    tiles = asks.select(cols).unionByName(held.select(cols)).repartition("dim", "g", "s").sortWithinPartitions("dim", "g", "s", "side")
    return tiles.mapInArrow(task, PAIR)


def _pairs(anchors: Unpacked, line: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    columns = [anchors.rows[line], anchors.ids[line], rows, ids, score]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PAIR.split(", ")])


class Positives:
    """The first ``k`` other rows of each anchor's label."""

    def __init__(self, k: int, anchors: Unpacked):
        self.a, self.kept = anchors, Kept(k)

    def meet(self, block: Unpacked) -> None:
        fits = (self.a.labels[:, None] == block.labels) & (self.a.rows[:, None] != block.rows)
        if fits.any():
            self.kept.meet(products(self.a.x, block.x), fits, block.ids, block.rows)

    def pairs(self) -> pa.RecordBatch:
        return _pairs(self.a, *self.kept.held)


class Negatives:
    """The first ``k`` rows of other labels in each of the anchors' windows."""

    def __init__(self, k: int, low: int, high: int, anchors: Unpacked):
        self.a, self.kept = anchors, [Kept(k) for _ in range(anchors.scores.shape[1])]
        edges = [window(x, low, high) for x in anchors.scores.ravel().tolist()]
        self.windows = np.array(edges, np.int64).reshape(*anchors.scores.shape, 2)

    def meet(self, block: Unpacked) -> None:
        other = self.a.labels[:, None] != block.labels
        scores = products(self.a.x, block.x)
        for j, kept in enumerate(self.kept):
            fits = other & (scores >= self.windows[:, j, :1]) & (scores <= self.windows[:, j, 1:])
            if fits.any():
                kept.meet(scores, fits, block.ids, block.rows)

    def pairs(self) -> pa.RecordBatch:
        line, score, ids, rows = (np.concatenate(x) for x in zip(*(k.held for k in self.kept)))
        _, once = np.unique(np.stack([line, rows]), axis=1, return_index=True)
        return _pairs(self.a, line[once], score[once], ids[once], rows[once])


def stream(keys: Iterator[tuple[int, bytes]], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """``MINED`` rows of (anchor id, key) in the order of the keys: a positive opens its window, a negative goes to the open
    windows that reach down to it and up to its score, a window closes when it is full or all scores left lie below it."""
    at, windows = None, []
    for anchor_id, key in keys:
        anchor, score, negative, vec_id, _ = unpack_key(key)
        if anchor != at:
            at, windows = anchor, []
        if not negative:
            lo, hi = window(score, low, high)
            if lo <= hi:
                windows.append([lo, hi, 0, vec_id, score])
            continue
        windows = [w for w in windows if w[0] <= score and w[2] < negatives]
        for w in windows:
            if score <= w[1]:
                w[2] += 1
                yield anchor_id, w[3], w[2], vec_id, w[4], score


def _packed(pairs: DataFrame, negative: bool) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, _, row, ids, score = (c.to_pylist() for c in batch.columns)
            keys = [pack_key(x, s, negative, i, r) for x, r, i, s in zip(a, row, ids, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["a_row", "anchor_id", "key"])

    return pairs.mapInArrow(task, PACKED)


def mine(
    table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 2048, spread: int = 16,
) -> DataFrame:
    """Per anchor (ids divisible by ``every``) and positive the first ``negatives`` rows of another label whose score lies between
    ``low`` and ``high`` hundredths of the positive's: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``.

    A score is the integer product of components floor(scale x); higher ones come first, equal ones by smaller id.  An anchor's
    positives are its first ``positives`` other rows of its label.  Rows with a null id or label, or a vector that is null, empty
    or holds null or non-finite components, take no part; vectors of different lengths do not meet; a repeated id is a row of its
    own, also as an anchor; an anchor without positives, or whose positives score below 0, gives no row, nor does an empty table.  All rows
    of a window count, however many share a score.  Scores beyond 64 bits count as the limit.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("a window lies between 0 and 100 hundredths of its positive's score")
    label = F.col(label_col).cast("long").alias("label")
    rows = valid(table, id_col, vector_col, more=[label]).where(F.col("label").isNotNull())
    rows = stage(rows.withColumn("scores", F.array().cast("array<long>")).withColumn("g", F.lit(0)))
    asked = rows.where(F.col("vec_id") % every == 0)
    groups = max(1, -(-asked.count() // block))
    asked = asked.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    packed = lambda df: _blocks(df.repartition("g").sortWithinPartitions("g"), scale, block)
    others = stage(_blocks(rows, scale, block))
    found = _meet(packed(asked), others, groups, spread, lambda a: Positives(positives, a))
    order = Window.partitionBy("a_row").orderBy(F.col("score").desc(), "vec_id", "row")  # at most spread x positives rows
    best = stage(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"))
    # the places of missing positives hold a score whose window is empty
    scores = best.groupBy("a_row").agg(F.collect_list("score").alias("found"))
    scores = scores.select("a_row", F.concat("found", F.array_repeat(F.lit(-1).cast("long"), F.lit(positives) - F.size("found"))).alias("scores"))
    open_ = asked.drop("scores").join(scores, F.col("row") == F.col("a_row"))
    near = _meet(packed(open_), others, groups, spread, lambda a: Negatives(negatives, low, high, a))
    keys = _packed(best, False).unionByName(_packed(near, True)).repartition("a_row").sortWithinPartitions("key").select("anchor_id", "key")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MINED.split(", ")]
        kinds = [pa.int32() if n == "rank" else pa.int64() for n in names]
        pairs = (p for batch in batches for p in zip(*(c.to_pylist() for c in batch.columns)))
        out = []
        for r in stream(pairs, negatives, low, high):
            out.append(r)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return keys.mapInArrow(task, MINED)
