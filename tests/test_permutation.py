"""The permutation law: exact draws at any size, and tables with the given margins."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankeval.functions.draws import hypergeometric, log_hypergeometric, share_out, stream, uniforms
from rankeval.functions.stats import _upper_gamma
from rankeval.operators import audit, permutation


def chi_square_tail(drawn, law):
    """Tail probability of the counts of ``drawn`` under ``law`` (value -> probability), cells of few expected draws merged."""
    seen, n = Counter(drawn.tolist()), len(drawn)
    assert set(seen) <= set(law)
    cells, got, want = [], 0, 0.0
    for k in sorted(law):
        got, want = got + seen[k], want + n * law[k]
        if want >= 8:
            cells.append((got, want))
            got, want = 0, 0.0
    if cells:
        cells[-1] = (cells[-1][0] + got, cells[-1][1] + want)
    return _upper_gamma((len(cells) - 1) / 2, sum((g - w) ** 2 / w for g, w in cells) / 2) if len(cells) > 1 else 1.0


def draws(good, bad, take, n=30_000, seed=1):
    full = np.full(n, 0, np.int64)
    return hypergeometric(full + good, full + bad, full + take, stream(seed, np.arange(n)))


@pytest.mark.parametrize("good, bad, take", [(1, 1, 1), (3, 5, 4), (10, 10, 10), (40, 3, 20), (2, 500, 90), (300, 700, 250), (5000, 15, 4000), (1, 10**4, 5 * 10**3)])
def test_draws_follow_the_exact_law(good, bad, take):
    law = {k: math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take) for k in range(max(0, take - bad), min(good, take) + 1)}
    assert chi_square_tail(draws(good, bad, take), law) > 1e-4


@pytest.mark.parametrize("good, bad, take", [(3 * 10**12, 7 * 10**12, 200), (10**6, 10**15, 3 * 10**9), (10**14, 10**14, 50)])
def test_draws_follow_the_law_at_sizes_beyond_any_table(good, bad, take):
    middle = (take + 1) * (good + 1) // (good + bad + 2)
    law = {middle: 1.0}
    for step in (1, -1):  # by the exact ratio of neighbours
        k, p = middle, 1.0
        while p > 1e-12 and max(0, take - bad) <= k + step <= min(good, take):
            up = (good - k) * (take - k) / ((k + 1) * (bad - take + k + 1)) if step > 0 else k * (bad - take + k) / ((good - k + 1) * (take - k + 1))
            k, p = k + step, p * up
            law[k] = p
    total = sum(law.values())
    assert chi_square_tail(draws(good, bad, take), {k: p / total for k, p in law.items()}) > 1e-4


def test_moments_where_the_law_is_wide():
    good, bad, take = 4 * 10**15, 3 * 10**15, 10**15
    x = draws(good, bad, take, 40_000).astype(float)
    p, n = good / (good + bad), good + bad
    mean, deviation = take * p, math.sqrt(take * p * (1 - p) * (n - take) / (n - 1))
    z = (x - mean) / deviation
    assert abs(z.mean()) < 5 / math.sqrt(len(z)) and abs(z.var() - 1) < 5 * math.sqrt(2 / len(z)) and abs((z**4).mean() - 3) < 0.3


def test_log_of_the_law():
    for good, bad, take in ((7, 9, 5), (1000, 50, 400), (10**5, 10**6, 777)):
        lo, hi = max(0, take - bad), min(good, take)
        k = np.unique(np.linspace(lo, hi, 60).astype(int))
        want = [math.log(math.comb(good, int(i))) + math.log(math.comb(bad, take - int(i))) - math.log(math.comb(good + bad, take)) for i in k]
        assert np.allclose(log_hypergeometric(k, good, bad, take), want, rtol=1e-9, atol=1e-9)
    good, bad, take = 4 * 10**12, 6 * 10**12, 10**7
    k = np.arange(4 * 10**6 - 12_000, 4 * 10**6 + 12_001)
    assert abs(np.exp(log_hypergeometric(k, good, bad, take)).sum() - 1) < 1e-8


def test_streams_are_counters():
    key = stream(5, np.arange(1000), 7)
    assert np.array_equal(key[3:4], stream(5, np.array([3]), 7)) and len(np.unique(key)) == 1000
    u = np.concatenate([uniforms(key, i) for i in range(100)])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.005 and abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.02


def test_shares_keep_all_items():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 50, (30, 4, 6))
    take = (pool.sum(-1) * rng.random((30, 4))).astype(np.int64)
    out = share_out(pool, take, stream(np.arange(30)[:, None], np.arange(4)))
    assert (out >= 0).all() and (out <= pool).all() and (out.sum(-1) == take).all()


def rows(n=400):
    rng = np.random.default_rng(4)
    groups = [None if g == 2 else "xy"[g] for g in rng.integers(0, 3, n)]
    return [(g, None if a == 0 else f"a{a}", int(b)) for g, a, b in zip(groups, rng.geometric(0.12, n) - 1, rng.integers(0, 4, n))]


@pytest.mark.parametrize("leaves", [5, 1024])
def test_tables_have_the_given_margins(spark, monkeypatch, leaves):
    """Null groups and values included, however many parts the tree is cut into."""
    monkeypatch.setattr(permutation, "LEAVES", leaves)
    data = rows()
    df = spark.createDataFrame(data, "g string, a string, b int").repartition(3)
    dealt = permutation.deal_tables(df, "a", "b", 8, 3, ["g"])
    assert dealt.columns == ["g", "replicate", "a", "b", "n"]
    got = dealt.collect()
    for replicate in range(8):
        mine = [r for r in got if r["replicate"] == replicate]
        for i in (2, 3):
            have = Counter()
            for r in mine:
                have[r["g"], r[i]] += r["n"]
            assert have == Counter((x[0], x[i - 1]) for x in data)
    again = permutation.deal_tables(df.repartition(7), "a", "b", 8, 3, ["g"]).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    assert len({tuple(sorted((key(r) for r in got if r["replicate"] == i and r["g"] == "x"), key=lambda t: t[2:])) for i in range(8)}) > 1


@pytest.mark.parametrize("leaves", [2, 1024])
def test_a_cell_follows_its_law(spark, monkeypatch, leaves):
    """Each cell of a re-dealt table alone is hypergeometric, also below a path of several parts."""
    monkeypatch.setattr(permutation, "LEAVES", leaves)
    monkeypatch.setattr(permutation, "REPLICATES", 300)
    data = [("a", 0)] * 6 + [("b", 1)] * 5 + [("c", 0)] * 4 + [("d", 2)] * 5 + [("e", 1)] * 3
    df = spark.createDataFrame(data, "a string, b int")
    got = {(r["replicate"], r["a"], r["b"]): r["n"] for r in permutation.deal_tables(df, "a", "b", 1200).collect()}
    for a, size in (("a", 6), ("c", 4), ("e", 3)):
        for b, of in ((0, 10), (1, 8)):
            law = {k: math.comb(of, k) * math.comb(23 - of, size - k) / math.comb(23, size) for k in range(size + 1)}
            assert chi_square_tail(np.array([got.get((i, a, b), 0) for i in range(1200)]), law) > 1e-4


def test_information_keeps_null_groups_and_counted_rows(spark):
    df = spark.createDataFrame(rows(), "g string, a string, b int")
    got = {r["g"]: r for r in audit.permutation_mi(df, "a", "b", 40, 0, ["g"]).collect()}
    assert set(got) == {None, "x", "y"} and all(0 < r["mi_perm_p"] <= 1 and r["mi_null_std"] > 1e-6 for r in got.values())
    counted = df.groupBy("g", "a", "b").agg(F.count("*").alias("c"))
    same = {r["g"]: r for r in audit.permutation_mi(counted, "a", "b", 40, 0, ["g"], "c").collect()}
    assert all(same[g][c] == pytest.approx(got[g][c]) for g in got for c in ("mi_obs", "mi_null_mean", "mi_null_std", "mi_perm_p"))
    tables = permutation.deal_tables(df, "a", "b", 40, 0, ["g"])
    margins = {c: tables.groupBy("g", "replicate", c).agg(F.sum("n").alias("m")) for c in "ab"}
    mi = audit._information(audit.contingency(tables, "a", "b", ["g", "replicate"], "n"), ["g", "replicate"])
    null = {(r["g"], r["replicate"]): r["mi"] for r in permutation.null_information(df, "a", "b", 40, 0, ["g"]).collect()}
    assert all(abs(null[r["g"], r["replicate"]] - r["mi"]) < 1e-9 for r in mi.collect()) and len(null) == 120 and margins["a"].count() > 0


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "g string, a string, b int")
    assert permutation.deal_tables(empty, "a", "b", 5).count() == 0 and audit.permutation_mi(empty, "a", "b", 5, 0, ["g"]).count() == 0
    one = spark.createDataFrame([("x", "a", 1)], "g string, a string, b int")
    assert [tuple(r) for r in permutation.deal_tables(one, "a", "b", 2).collect()] == [(0, "a", 1, 1), (1, "a", 1, 1)]
