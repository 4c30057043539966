from collections import Counter

import numpy as np
import pytest

from rankeval.llm import whitening
from rankeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, `x` string")


def brute(rows, k=4, scale=256):
    good = [(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    lengths = Counter(len(x) for _, x in good)
    d = min(lengths, key=lambda m: (-lengths[m], m))
    good = [(i, x) for i, x in good if len(x) == d]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        z = (np.array(x, float) - np.array([s / n for s in sums])) @ vectors
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out.setdefault(i, []).append((deviation, z))
    return n, values, values / np.trace(centred.T @ centred / n), out


def check(found, rows, k=4):
    n, values, explained, want = brute(rows, k)
    values = values[explained > 1e-12]
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], []).append(r)
    assert got.keys() == want.keys()
    signs = None
    for i, each in want.items():
        assert len(got[i]) == len(each) * len(values)
        if len(each) > 1:
            continue
        mine = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, len(values) + 1)) and {r["n"] for r in mine} == {n} and {int(r["deviation"]) for r in mine} == {each[0][0]}
        z, w = np.array([r["whitened"] for r in mine]), each[0][1][: len(values)] / np.sqrt(values)
        signs = np.sign(z * w) if signs is None else signs
        assert np.allclose(z, signs * w, atol=1e-7)
        assert np.allclose([r["explained"] for r in mine], explained[: len(values)], rtol=1e-9)
        assert len({r["identity_error"] for r in mine}) == 1 and mine[0]["identity_error"] < 1e-9


def test_query_11_against_eigenvectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    found = QUERIES["op11_whitening"](spark, SF)
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(found.collect(), [(r["vec_id"], r["embedding"]) for r in e])


@pytest.mark.parametrize("d", [3, 12, 50])
def test_odd_rows_copies_and_repeats(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, [float(v) for v in rng.normal(size=d) * (1 + np.arange(d))]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(2000 + i, [1e-9 if j else -1e-9 for j in range(d)]) for i in range(30)]
    rows += [(5000, None), (5001, []), (5002, [None] * d), (5003, [float("nan")] * d), (5004, [float("inf")] * d), (None, [1.0] * d), (5005, [1.0] * (d + 1)), (5, [2.0] * d)]
    check(whitening.whiten(frame(spark, rows).repartition(5)).collect(), rows)


def test_rank_and_scale(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rows = [(i, [float(i % 5), 1.0, 2.0 * (i % 5)]) for i in range(40)]  # a line
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    rows = [(i, [1e7 * ((i * j) % 11) for j in range(1, 7)]) for i in range(50)]  # deviations near 64 bits
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_iteration_needs_no_gap():
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    for values in (np.linspace(2, 1, 90), np.ones(90), np.r_[np.full(60, 3.0), np.zeros(30)], np.r_[5, 4, 3, 2, np.full(86, 1.999)], 0.5 ** np.arange(90), np.zeros(90), np.r_[1, np.zeros(89)]):
        v = (turn * values) @ turn.T
        found = whitening.leading(lambda q: v @ q, 90, 4, 32)  # noqa: B023
        assert np.allclose(found.values, sorted(values)[::-1][:4], atol=1e-9)
        assert np.abs(v @ found.vectors - found.vectors * found.values).max() < 1e-9 and np.allclose(found.vectors.T @ found.vectors, np.eye(4))
        assert found.passes < 400


def test_filter_damps_what_is_below():
    values = np.linspace(0, 2, 201)
    out = whitening.chebyshev(lambda q: values[:, None] * q, np.ones((201, 1)), 12, 0.0, 1.0, 2.0)[:, 0]
    assert abs(out[-1] - 1) < 1e-9 and np.abs(out[values <= 1]).max() < 1e-6
