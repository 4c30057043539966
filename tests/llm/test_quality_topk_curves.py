import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankeval.llm import curves, quality, topk
from rankeval.llm.queries import ORACLES, QUERIES, op9
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label.sum()
    return (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(label) - pos))


def test_query_9_tells_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    rows = op9(spark, MID).collect()
    assert len(rows) == docs.count() and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    test = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    score, label = map(np.array, zip(*test))
    assert 0 < label.sum() < len(label) and auc(score, label) > 0.95


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    lies = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, lies))
    assert a == b


def test_trees_as_arrays_walk_like_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    model = quality.fit(x, y, trees=20)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    bins = model.bins(x[:50])
    for i in range(50):
        raw = model.base
        for t in range(20):
            node = 0
            while 2 * node + 1 < model.value.shape[1]:
                node = 2 * node + 1 + (bins[i, model.feature[t, node]] > model.above[t, node])
            raw += model.value[t, node]
        assert abs(1 / (1 + np.exp(-raw)) - model.scores(x[i : i + 1])[0]) < 1e-12


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 1), (2, 1)], [(99, 0)], [(1, 0), (2, 1), (2, 0), (None, 1)]])
def test_quality_without_usable_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (2, "", 1), (None, "x" * 100_000, 1)], "doc_id long, text string, score int")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = quality.classify(docs, table).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(docs.limit(0), table).count() == 0
    assert quality.accepted(docs, table).columns == docs.columns


def test_query_6_against_sql(spark):
    assert compare(spark, connect(SF), QUERIES["op6_exact_topk"], ORACLES["op6_exact_topk"], SF) is None


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, `c.row` string")


def odd_rows(rng, n=300, d=12):
    rows = [(i, [float(v) for v in rng.integers(-3, 4, d)]) for i in range(n)]
    rows += [(7, None), (100, []), (200, [1.0, None] + [0.0] * (d - 2)), (300, [float("nan")] * d), (400, [float("inf")] * d), (None, [1.0] * d)]
    return rows + [(100, [1.0] * d), (0, [2.0] * d), (500, [1.0, 2.0]), (501, [1.0, 3.0]), (600, [0.0] * d)]


def brute(rows, every, k, number, nonzero=False):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and not (nonzero and not any(v))]
    out = []
    for q, (i, v) in enumerate(good):
        if i % every == 0:
            scores = sorted((-sum(number(a) * number(b) for a, b in zip(v, w)), j) for c, (j, w) in enumerate(good) if c != q and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_topk_with_odd_rows_ties_and_repeats(spark):
    rows = odd_rows(np.random.default_rng(2))
    got = sorted(map(tuple, topk.search(vectors(spark, rows).repartition(5), every=20, k=10, block=16, spread=3).collect()))
    assert got == brute(rows, 20, 10, lambda x: int(np.floor(1024 * x)))
    assert topk.search(vectors(spark, [])).count() == 0
    assert topk.search(vectors(spark, [(0, [1.0]), (1, [2.0])]), every=1, k=5).count() == 2


def test_topk_of_large_components_is_exact(spark):
    """Products beyond 2^53 that differ in their last digits, beside small ones."""
    rng = np.random.default_rng(21)
    rows = [(i, [1e6 + float(rng.integers(0, 9)) / 1024, -1e6 + float(rng.integers(0, 5)) / 1024, float(rng.integers(0, 3))]) for i in range(60)]
    rows += [(100 + i, [float(rng.integers(-3, 4)) for _ in range(3)]) for i in range(60)] + [(200, [1e6, 1e6, 0.0]), (201, [3e6, 1.0, 1.0])]
    as_double = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(as_double(rows).repartition(3), every=5, k=10, block=16, spread=3).collect()))
    assert got == brute(rows, 5, 10, lambda x: int(np.floor(1024 * x)))
    limit = topk.search(as_double([(0, [1e15]), (1, [1e15]), (2, [-1e15]), (3, [1 / 1024])]), every=10, k=3).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(limit, key=lambda r: r["rank"])] == [(1, 2**63 - 1), (3, 1024 * 10**15), (2, -(2**63))]


def test_segment_bounds_never_undercut():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 30)), rng.normal(size=(50, 30))
    for s in (1, 4, 7, 30, 99):
        assert (topk.segment_statistics(x, s) @ topk.segment_statistics(y, s).T >= x @ y.T - 1e-9).all()


def test_hilbert_keys_are_a_walk_through_all_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = curves.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_curve_search_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 6000)] + 0.3 * rng.normal(size=(6000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = curves.search(vectors(spark, rows).repartition(4), every=20, k=20, block=64).collect()
    q = np.arange(0, 6000, 20)
    s = x[q].astype(float) @ x.T.astype(float)
    s[np.arange(len(q)), q] = -np.inf
    want = {(int(a), int(b)) for a, row in zip(q, np.argsort(-s, axis=1)[:, :20]) for b in row}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) / len(want) >= 0.9
    assert all(abs(r["score"] - s[r["query_id"] // 20, r["vec_id"]]) < 1e-9 for r in got)
    assert all(sorted(r["rank"] for r in got if r["query_id"] == i) == list(range(1, 21)) for i in (0, 20, 5980))


def test_curve_search_of_few_odd_rows_is_exact(spark):
    rows = odd_rows(np.random.default_rng(5), n=60)
    got = sorted(map(tuple, curves.search(vectors(spark, rows), every=20, k=7, window=99).collect()))
    assert got == brute(rows, 20, 7, float, nonzero=True)
    assert curves.search(vectors(spark, [])).count() == 0
    assert curves.search(vectors(spark, [(0, [1.0])])).count() == 0


def test_query_7_recall(spark):
    rows = QUERIES["op7_curve_neighbours"](spark, SF).collect()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want = {(a, b) for a, _, b, _ in brute([(r["vec_id"], r["embedding"]) for r in e], 20, 20, float)}
    assert len({(r["query_id"], r["vec_id"]) for r in rows} & want) / len(want) >= 0.9
