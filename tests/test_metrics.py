import math
import random

import pytest
from pyspark.sql import functions as F

from rankeval.operators import audit, debias, metrics, sampling


def brute_auc(rows):
    pos = [(s, w) for s, y, w in rows if y == 1]
    neg = [(s, w) for s, y, w in rows if y == 0]
    if not pos or not neg:
        return math.nan
    win = sum(a * b * ((p > q) + 0.5 * (p == q)) for p, a in pos for q, b in neg)
    return win / sum(a * b for _, a in pos for _, b in neg)


def scored(seed, n=160):
    rng = random.Random(seed)
    return [
        (f"f{rng.randint(0, 25)}", rng.choice(["x", "x", "y"]), round(rng.random(), 1), int(rng.random() < 0.35), rng.randint(0, 7), rng.choice([1.0, 2.5]))
        for _ in range(n)
    ]


SCHEMA = "feed string, g string, s double, y int, pos int, w double"


@pytest.mark.parametrize("hot", [False, True])
def test_auc_with_ties_weights_and_bad_scores(spark, request, hot):
    if hot:
        request.getfixturevalue("split_everything")
    data = scored(1)
    bad = [("f0", "x", math.nan, 1, 0, 1.0), ("f0", "x", None, 1, 0, 1.0), ("f0", "x", math.inf, 0, 0, 1.0)]
    df = spark.createDataFrame(data + bad, SCHEMA)
    plain = {r["g"]: r for r in metrics.auc(df, "s", "y", ["g"]).collect()}
    weighted = {r["g"]: r for r in metrics.auc(df, "s", "y", ["g"], weight="w").collect()}
    for g in ("x", "y"):
        rows = [r for r in data if r[1] == g]
        assert plain[g]["n"] == len(rows) and plain[g]["pos"] == sum(r[3] for r in rows)
        assert plain[g]["auc"] == pytest.approx(brute_auc([(r[2], r[3], 1.0) for r in rows]))
        assert weighted[g]["auc"] == pytest.approx(brute_auc([(r[2], r[3], r[5]) for r in rows]))


def test_auc_properties(spark):
    df = spark.createDataFrame(scored(2), SCHEMA)
    a = metrics.auc(df, "s", "y").first()["auc"]
    assert metrics.auc(df, -F.col("s"), "y").first()["auc"] == pytest.approx(1 - a)
    assert metrics.auc(df, F.exp("s") * 3, "y").first()["auc"] == pytest.approx(a)
    assert metrics.auc(df.withColumn("one", F.lit(7.0)), "s", "y", weight="one").first()["auc"] == pytest.approx(a)
    assert math.isnan(metrics.auc(df.where("y = 1"), "s", "y").first()["auc"])


def brute_ndcg(rows, k):
    """Mean gain over tied scores, places expanded one by one."""
    order = sorted(rows, key=lambda r: -r[0])
    dcg, i = 0.0, 0
    while i < len(order):
        tie = [r for r in order if r[0] == order[i][0]]
        gain = sum(r[1] for r in tie) / len(tie)
        dcg += sum(gain / math.log2(p + 2) for p in range(i, i + len(tie)) if p < k)
        i += len(tie)
    best = sorted((r[1] for r in rows), reverse=True)
    return dcg / sum(y / math.log2(p + 2) for p, y in enumerate(best) if p < k)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ndcg(spark, k):
    data = scored(3)
    df = spark.createDataFrame(data, SCHEMA)
    feeds = {}
    for r in data:
        feeds.setdefault(r[0], []).append((r[2], r[3]))
    want = [brute_ndcg(v, k) for v in feeds.values() if len(v) >= 2 and sum(y for _, y in v) > 0]
    got = metrics.ndcg(df, "feed", "y", "s", k).first()
    assert got["feeds"] == len(want)
    assert got["ndcg"] == pytest.approx(sum(want) / len(want))
    assert 0 <= got["ndcg"] <= 1


def ranks(values):
    return [sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in values]


def pearson(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))


@pytest.mark.parametrize("hot", [False, True])
def test_spearman(spark, request, hot):
    if hot:
        request.getfixturevalue("split_everything")
    data = scored(4)
    df = spark.createDataFrame(data, SCHEMA)
    r = debias.spearman(df, "pos", "s").first()
    want = pearson(ranks([d[4] for d in data]), ranks([d[2] for d in data]))
    assert r["spearman_r"] == pytest.approx(want)
    assert 0 < r["p_value"] <= 1


def test_tail_probabilities(spark):
    from rankeval.functions.stats import _incomplete_beta, _upper_gamma

    # textbook values: t = 2.228, 10 degrees -> 0.05; chi-square 3.841, 1 -> 0.05; 18.307, 10 -> 0.05
    assert _incomplete_beta(5, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-6)
    assert _upper_gamma(0.5, 3.841459 / 2) == pytest.approx(0.05, abs=1e-6)
    assert _upper_gamma(5, 18.307038 / 2) == pytest.approx(0.05, abs=1e-6)


def brute_mi(pairs):
    n = len(pairs)
    ab, a, b = {}, {}, {}
    for x, y in pairs:
        ab[x, y] = ab.get((x, y), 0) + 1
        a[x] = a.get(x, 0) + 1
        b[y] = b.get(y, 0) + 1
    mi = sum(c / n * math.log(c * n / (a[x] * b[y])) for (x, y), c in ab.items())
    chi = sum((ab.get((x, y), 0) - a[x] * b[y] / n) ** 2 / (a[x] * b[y] / n) for x in a for y in b)
    yates = sum(max(0.0, abs(ab.get((x, y), 0) - a[x] * b[y] / n) - 0.5) ** 2 / (a[x] * b[y] / n) for x in a for y in b)
    return mi, chi, yates, (len(a) - 1) * (len(b) - 1)


def test_mutual_information_and_chi_square(spark):
    data = scored(5)
    df = spark.createDataFrame(data, SCHEMA)
    mi, chi, _, dof = brute_mi([(d[2], d[4]) for d in data])
    assert audit.mutual_information(df, "s", "pos").first()["mi"] == pytest.approx(mi)
    assert audit.mutual_information(df, "pos", "s").first()["mi"] == pytest.approx(mi)
    got = audit.chi_square(df, "s", "pos").first()
    assert got["chi2"] == pytest.approx(chi) and got["dof"] == dof
    _, _, yates, _ = brute_mi([(d[1], d[3]) for d in data])
    assert audit.chi_square(df, "g", "y").first()["chi2"] == pytest.approx(yates)


def test_permutation_null_matches_shuffling(spark):
    rng = random.Random(6)
    data = [(rng.choice("abcdef"), rng.randint(0, 4)) for _ in range(300)]
    df = spark.createDataFrame(data, "a string, b int")
    got = audit.permutation_mi(df, "a", "b", 200).first()
    ys = [y for _, y in data]
    nulls = []
    for _ in range(200):
        rng.shuffle(ys)
        nulls.append(brute_mi([(x, y) for (x, _), y in zip(data, ys)])[0])
    mean = sum(nulls) / len(nulls)
    assert got["mi_obs"] == pytest.approx(brute_mi(data)[0])
    assert got["mi_null_mean"] == pytest.approx(mean, rel=0.15)
    assert got["mi_perm_p"] > 0.001
    dependent = df.withColumn("b", F.ascii("a") % 5)
    strong = audit.permutation_mi(dependent, "a", "b", 50).first()
    assert strong["mi_z"] > 10 and strong["mi_perm_p"] == pytest.approx(1 / 51)


def test_quantile_bins_keep_ties_together(spark):
    data = [(float(v),) for v in [1] * 30 + [2] * 5 + list(range(3, 20))]
    out = audit.quantile_bins(spark.createDataFrame(data, "v double"), "v", 8).groupBy("v").agg(F.count_distinct("bin").alias("b"))
    assert {r["b"] for r in out.collect()} == {1}


def test_planted_position_bias_shows(spark):
    rng = random.Random(7)
    data = [(f"f{i // 8}", i % 8, int(rng.random() < 0.6 / (1 + i % 8)), -float(i % 8), rng.random()) for i in range(1600)]
    df = spark.createDataFrame(data, "feed_id string, position_rank int, label int, follows double, free double").withColumn("split", F.lit("train"))
    weighted = debias.ipw_weight(df, debias.propensity(df))
    rows = {r["model"]: r for r in debias.debias_report(weighted, ["follows", "free"]).collect()}
    assert rows["follows"]["spearman_r"] == pytest.approx(-1) and rows["follows"]["r2"] == pytest.approx(1)
    assert abs(rows["free"]["spearman_r"]) < 0.1 and rows["follows"]["ndcg_delta"] == pytest.approx(0)
    assert rows["follows"]["ipw_auc"] < rows["follows"]["raw_auc"]


def test_pair_losses(spark):
    data = [("a", 1, 2.0), ("a", 0, 0.5), ("a", 0, -1.0), ("b", 1, -30.0), ("b", 0, 800.0)]
    df = spark.createDataFrame(data, "g string, y int, s double")
    got = metrics.pair_losses(df, ["g"], "s", "y", tau=2.0).first()
    sp = lambda x: max(x, 0) + math.log1p(math.exp(-abs(x)))
    bce = [(sp(-2.0) + (sp(0.5) + sp(-1.0)) / 2), sp(30.0) + sp(800.0)]
    nce = [math.log(math.exp(1) + math.exp(0.25) + math.exp(-0.5)) - 1, 415.0]
    assert got["bce"] == pytest.approx(sum(bce) / 2) and got["infonce"] == pytest.approx(sum(nce) / 2)


@pytest.mark.parametrize("hot", [False, True])
def test_mined_negatives(spark, request, hot):
    if hot:
        request.getfixturevalue("split_everything")
    rng = random.Random(8)
    # one feed holds a third of all rows
    data = [("big" if rng.random() < 0.34 else f"f{rng.randint(0, 40)}", i, int(rng.random() < 0.4)) for i in range(500)]
    df = spark.createDataFrame(data, "feed string, item int, label int")
    k = 12
    pairs = sampling.mine_negatives(df, "feed", ["item"], k=k)
    again = sampling.mine_negatives(df.repartition(6), "feed", ["item"], k=k)
    got = {}
    for r in pairs.collect():
        got.setdefault((r["anchor_feed"], r["anchor_item"]), []).append(r)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for v in got.values() for r in v}
    label = {i: (f, y) for f, i, y in data}
    for (feed, item), negs in got.items():
        own = sum(1 for f, _, y in data if f == feed and y == 0)
        elsewhere = sum(1 for f, _, y in data if f != feed and y == 1)
        inside = [n for n in negs if n["source"] == "in_session"]
        cross = [n for n in negs if n["source"] == "cross_feed"]
        assert len(inside) == min(k, own) and len(cross) == min(k - len(inside), elsewhere)
        assert len({n["neg_item"] for n in negs}) == len(negs)
        assert all(label[n["neg_item"]] == (feed, 0) for n in inside)
        assert all(label[n["neg_item"]][0] != feed and label[n["neg_item"]][1] == 1 for n in cross)
    assert set(got) == {(f, i) for f, i, y in data if y == 1}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_downsampling_counts(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    ratio = sampling.downsample_negatives(df, ["id"], ratio=2.5)
    assert [r["count"] for r in ratio.groupBy("label").count().orderBy("label").collect()] == [250, 100]
    both = sampling.downsample_negatives(df, ["id"], ratio=2.5, frac=0.25)
    assert both.where("label = 0").count() == 62  # half to even
    assert sampling.downsample_negatives(df, ["id"], ratio=100.0).count() == 1000
    assert sampling.sample_n(df, 37, ["id"]).distinct().count() == 37
    assert sampling.sample_n(df, 5000, ["id"]).count() == 1000


def ranked_rows(spark):
    rng = random.Random(11)
    rows = [(f"f{min(rng.randint(0, 12), 9)}", i, int(rng.random() < 0.3), i % 7, rng.choice([None, 0.0, 0.5, 2.0]), float(i % 5), 1.0) for i in range(200)]
    return spark.createDataFrame([*rows, (None, 900, 1, 0, 3.0, 1.0, 1.0)], "feed string, id int, y int, pos int, u double, v double, same double")


def test_orders_of_a_feed_stage_each_row_once(spark, monkeypatch):
    df, counted = ranked_rows(spark), []
    for name in ("stage", "written"):
        plain = getattr(metrics, name, None)
        monkeypatch.setattr(metrics, name, lambda d, *a, f=plain: (counted.append(d.count()), f(d, *a))[1], raising=False)
    got = metrics.feature_ndcg(df, ["u", "v", "same"], "feed", "y", "pos", ["feed", "id"]).collect()
    assert [r["feature"] for r in got if r["feature"] == "same"] == [] and len(got) == 2
    assert max(counted) <= df.count()


def test_large_feeds_are_counted_first_with_the_same_results(spark, monkeypatch):
    df = ranked_rows(spark)
    few = lambda rows: {r[0]: [round(x, 9) for x in r[1:]] for r in rows}
    report = lambda: few(metrics.feature_ndcg(df, ["u", "v", "same"], "feed", "y", "pos", ["feed", "id"], k=6).collect())
    per_feed = lambda: few(metrics.ndcg_per_feed(df, "feed", "y", "u", 6).collect())
    want = report(), per_feed()
    monkeypatch.setattr(metrics, "_FEED_ROWS", 18)
    assert (report(), per_feed()) == want
    u = metrics.ndcg(df.fillna({"u": 0.0}), "feed", "y", "u", 6).first()
    assert want[0]["u"][0] == u["feeds"] and want[0]["u"][1] == pytest.approx(u["ndcg"])
    display = metrics.ndcg(df.withColumn("d", -F.col("pos")), "feed", "y", "d", 6).first()["ndcg"]
    rand = metrics.ndcg(sampling.random_score(df, ["feed", "id"]), "feed", "y", "random_score", 6, ["seed"]).agg(F.avg("ndcg")).first()[0]
    assert want[0]["u"][2:] == pytest.approx([u["ndcg"] - display, u["ndcg"] - rand])
