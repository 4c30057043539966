import numpy as np
import pytest

from rankeval.llm import negatives, vectors
from rankeval.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, score int, `a_row` string")


def brute(rows, every, k_pos, k_neg, low=50, high=95, scale=256):
    good = [(i, [int(np.floor(scale * x)) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, z == y) for c, (j, w, z) in enumerate(good) if c != a and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2]][:k_pos]:
            fit = [(n, x) for n, x, same in scored if not same and low * -p <= 100 * -n <= high * -p][:k_neg]
            out += [(i, j, r, x, -p, -n) for r, (n, x) in enumerate(fit, 1)]
    return sorted(out)


def odd_rows(rng, n=260, d=8):
    rows = [(i, [float(v) / 4 for v in rng.integers(-1, 4, d)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, [0.5] * d, i % 2) for i in range(150)]  # copies that tie
    rows += [(5, None, 1), (10, [], 1), (15, [1.0, None] + [0.0] * (d - 2), 1), (20, [float("nan")] * d, 1), (25, [float("inf")] * d, 1), (None, [1.0] * d, 1), (30, [1.0] * d, None)]
    return rows + [(0, [1.0] * d, 0), (35, [1.0, 2.0], 1), (36, [1.0, 2.0], 1), (37, [0.5, 1.5], 2), (40, [0.0] * d, 1), (45, [1.0, 1.0, 1.0], 7)]


@pytest.mark.parametrize("block, spread", [(16, 3), (2048, 16)])
def test_odd_rows_ties_copies_and_repeats(spark, block, spread):
    rows = odd_rows(np.random.default_rng(6))
    got = negatives.mine(frame(spark, rows).repartition(5), every=5, positives=4, negatives=3, block=block, spread=spread)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4, 3)


def test_windows_that_touch_the_positive_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 2.0], 2), (3, [1.0, 1.0], 2), (4, [1.0, 0.0], 1), (5, [-1.0, 0.0], 1)]
    got = negatives.mine(frame(spark, rows), every=1, positives=5, negatives=2, low=0, high=100)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1, 5, 2, 0, 100)
    with pytest.raises(ValueError):
        negatives.mine(frame(spark, rows), high=101)


def test_few_rows(spark):
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [(0, [1.0], 1)])).count() == 0
    assert negatives.mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])).count() == 0


def test_large_components_are_exact(spark):
    rows = [(0, [4e6, 3e6], 1), (1, [4e6, 3e6 + 1 / 256], 1), (2, [3.7e6, 2.9e6], 2), (3, [3.7e6, 2.9e6 + 1 / 256], 2), (4, [0.5, 1.0], 1)]
    got = negatives.mine(frame(spark, rows), every=1)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1, 5, 3)


def test_products_are_exact_up_to_the_limits():
    rng = np.random.default_rng(8)
    for bits in (10, 27, 31, 45):
        q, c = (np.floor(rng.uniform(-(2.0**bits), 2.0**bits, (m, 3))) for m in (5, 7))
        c[::2] = np.floor(c[::2] / 2.0**20)
        want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c.tolist()] for x in q.tolist()]
        clipped = [[max(-(2**63), min(2**63 - 1, v)) for v in row] for row in want]
        assert vectors.products(q, c).tolist() == clipped
    assert vectors.products(np.array([[1e300]]), np.array([[1e300], [-1e300]])).tolist() == [[2**63 - 1, -(2**63)]]


def test_keys_sort_as_their_parts():
    rng = np.random.default_rng(9)
    ends = [-(2**63), -1, 0, 1, 2**63 - 1]
    parts = [(int(rng.choice(ends)), int(rng.choice(ends)), bool(rng.integers(2)), int(rng.choice(ends)), int(rng.choice(ends))) for _ in range(300)]
    keys = [negatives.pack_key(*p) for p in parts]
    assert [negatives.unpack_key(k) for k in keys] == parts
    assert [negatives.unpack_key(k) for k in sorted(keys)] == sorted(parts, key=lambda p: (p[0], -p[1], *p[2:]))


def test_query_12_against_sql(spark):
    assert compare(spark, connect(SF), QUERIES["op12_hard_negatives"], ORACLES["op12_hard_negatives"], SF) is None
