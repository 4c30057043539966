"""A quality classifier: histogram gradient-boosted trees over document statistics (operator 9).

The trees are fitted on the statistics of a bounded sample of labelled documents and kept as arrays, one row of nodes per
tree, which numpy walks for a whole batch at a time.  Every document is scored in one pass over the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankeval.llm.arrow_rows import keep, slices

STATISTICS = (
    "log_bytes letters upper digits spaces points symbols bars bangs beyond_ascii byte_entropy log_words word_length word_spread "
    "distinct_words commonest_word same_as_before capital_words long_words marked_words distinct_pairs log_lines line_length "
    "repeated_lines ended_lines short_lines sentence_length"
).split()
_BYTES = np.arange(256)
_CLASSES = {
    "letters": ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 128), "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digits": (_BYTES >= 48) & (_BYTES <= 57), "spaces": np.isin(_BYTES, [9, 10, 11, 12, 13, 32]), "points": np.isin(_BYTES, list(b".,;:?'\"-()")),
    "symbols": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{}~")), "bars": _BYTES == 124, "bangs": _BYTES == 33, "beyond_ascii": _BYTES >= 128,
}
_MATRIX = np.stack([_CLASSES[n] for n in STATISTICS[1:10]]).astype(float)


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, zero where they have no base; null counts as empty."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    share = counts[counts > 0] / n
    out = [np.log1p(len(data)), *(_MATRIX @ counts / n), -float(share @ np.log2(share)) if len(data) else 0.0]
    words = data.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    top = Counter(words).most_common(1)
    out += [
        np.log1p(len(words)), lengths.mean(), lengths.std(), len(set(words)) / w, top[0][1] / w if top else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / w, sum(map(bytes.isupper, words)) / w, (lengths > 20).sum() / w,
        sum(not x[-2:].isalnum() and len(x) > 3 and x[-2:-1] in b"!*%&$#|?" for x in words) / w, len(set(zip(words, words[1:]))) / w,
    ]
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    ends = counts[46] + counts[33] + counts[63]
    out += [
        np.log1p(len(lines)), len(data) / m, 1 - len(set(lines)) / m, sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / m,
        sum(len(x) < 30 for x in lines) / m, len(words) / max(1, ends),
    ]
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: node i's children are 2i + 1 and 2i + 2; a row goes right where its bin
    is above the node's.  ``edges``: per statistic the values between bins."""

    edges: np.ndarray
    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int16)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        bins, rows, raw = self.bins(x), np.arange(len(x)), np.full(len(x), self.base)
        depth = (self.value.shape[1] + 1).bit_length() - 2 if len(self.value) else 0
        for feature, above, value in zip(self.feature, self.above, self.value):
            node = np.zeros(len(x), np.int32)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > above[node])
            raw += value[node]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, n_bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boost logistic loss.  Without rows the score is 1 for all; with one label it is that label's smoothed share."""
    if not len(y):
        return Trees(np.zeros((len(STATISTICS), 0)), np.zeros((0, 1), int), np.zeros((0, 1), int), np.zeros((0, 1)), 40.0)
    edges = np.quantile(x, np.arange(1, n_bins) / n_bins, axis=0).T
    p = (y.sum() + 1) / (len(y) + 2)
    nodes, first_leaf = 2 ** (depth + 1) - 1, 2**depth - 1
    model = Trees(edges, np.zeros((trees, nodes), int), np.full((trees, nodes), n_bins), np.zeros((trees, nodes)), float(np.log(p / (1 - p))))
    if len(np.unique(y)) < 2:
        return model
    bins, (n, d) = model.bins(x), x.shape
    flat = bins + np.arange(d) * n_bins
    raw = np.full(n, model.base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h = y - q, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (d * n_bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(v, d), width * d * n_bins).reshape(width, d, n_bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gs, hs) = hist, (v[:, :, -1:] for v in hist)
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(hl < least) | (hs - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            split = gain.reshape(width, -1).max(1) > 1e-9
            model.feature[t, first : first + width] = np.where(split, best // n_bins, 0)
            model.above[t, first : first + width] = np.where(split, best % n_bins, n_bins)
            node = 2 * node + 1 + (bins[np.arange(n), model.feature[t, node]] > model.above[t, node])
        leaf = node - first_leaf
        gs, hs = (np.bincount(leaf, v, 2**depth) for v in (g, h))
        model.value[t, first_leaf:] = rate * gs / (hs + ridge)
        raw += model.value[t, node]
    return model


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: CRC-32 of the id as text leaves 2 when divided by 4 (a null id as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Trees:
    """Fit on at most ``max_rows`` labels of documents that are not held out, those with the smallest hash of their id.

    Null labels and labels of other documents are left out; a document with several labels counts once for each.
    """
    doc = F.col(id_col).cast("long").alias("labelled")
    known = labels.select(doc, F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("labelled")))
    known = known.join(docs.select(doc), "labelled", "left_semi")
    # at most max_rows pairs of numbers go through the driver, and as many rows of statistics come back
    sample = known.orderBy(F.xxhash64("labelled"), "labelled", "y").limit(max_rows)
    sample = docs.sparkSession.createDataFrame(sample.toArrow())
    texts = docs.select(doc, F.col(text_col).alias("t")).join(F.broadcast(sample), "labelled").select("t", "y", "labelled")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1), batch.column(2)], names=["x", "y", "labelled"])

    found = texts.mapInArrow(task, "x array<float>, y int, labelled long").toArrow().sort_by([("labelled", "ascending"), ("y", "ascending")])
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return fit(x, found.column("y").to_numpy().astype(float))


def _scores(model: Trees, texts: list[str | None]) -> np.ndarray:
    x = np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(STATISTICS))
    return model.scores(x.astype(float))


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of whole texts; the model is a few hundred kilobytes and goes with the tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(model, part.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(task, "doc_id long, score double")


def classify(
    docs: DataFrame, labels: DataFrame, least_score: float = 0.7, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``, from its text alone.

    Null and empty texts are scored like any other, repeated rows alike; without labels every score is 1.
    """
    model = learn(docs, labels, max_rows, id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least_score).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least_score: float = 0.7, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least_score``."""
    model = learn(docs, labels, max_rows, id_col, text_col)
    return keep(docs, text_col, lambda texts: _scores(model, texts) >= least_score)
