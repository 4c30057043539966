import random

import pytest
from pyspark.sql import functions as F

from rankeval.operators import ranges


def rows(seed, n=400):
    rng = random.Random(seed)
    # one group holds most rows, one has a null key
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randint(0, 40), i, rng.randint(1, 9)) for i in range(n)]


def expected(data):
    out = {}
    groups = {}
    for k, v, i, w in data:
        groups.setdefault(k, []).append((v, i, w))
    for k, items in groups.items():
        total = 0
        for place, (v, i, w) in enumerate(sorted(items)):
            out[i] = (place, total)
            total += w
    return out


@pytest.mark.parametrize("hot", [None, "split_everything", "split_shuffled"])
@pytest.mark.parametrize("keyed", [True, False])
def test_prefix_sums(spark, request, hot, keyed):
    if hot:
        request.getfixturevalue(hot)
    data = rows(1)
    df = spark.createDataFrame(data, "k string, v int, i int, w int").repartition(5)
    by = ["k"] if keyed else []
    got = ranges.prefix_sums(df, by, ["v", "i"], {"place": F.lit(1).cast("bigint"), "below": "w"}).collect()
    want = expected(data if keyed else [(None, v, i, w) for _, v, i, w in data])
    assert {r["i"]: (r["place"], r["below"]) for r in got} == want


@pytest.mark.parametrize("hot", ["split_everything", "split_shuffled"])
def test_hot_groups_are_cut(spark, request, hot):
    request.getfixturevalue(hot)
    df = spark.createDataFrame(rows(2), "k string, v int, i int, w int")
    bounds = ranges._hot_bounds(df, ["k"], ["v", "i"])
    cut = ranges._with_buckets(df, ["k"], ["v", "i"], bounds)
    sizes = {r["k"]: (r["b"], r["m"]) for r in cut.groupBy("k", "_bucket").count().groupBy("k").agg(
        F.count("*").alias("b"), F.max("count").alias("m")).collect()}
    assert sizes["hot"][0] > 8 and sizes["hot"][1] < 60


def test_cold_data_uses_the_plain_window(spark):
    df = spark.createDataFrame(rows(3), "k string, v int, i int, w int")
    plan = ranges.ordered_index(df, ["k"], ["v", "i"], "p")._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" not in plan


@pytest.mark.parametrize("hot", [None, "split_everything", "split_shuffled"])
def test_exact_percentiles(spark, request, hot):
    if hot:
        request.getfixturevalue(hot)
    rng = random.Random(4)
    data = [(rng.choice(["x", "x", "x", "y"]), rng.choice([rng.random(), 0.5, None])) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.125, 0.5, 0.95, 1.0]
    got = {r["k"]: r["percentiles"] for r in ranges.exact_percentiles(df, "v", probs, ["k"]).collect()}
    for k in ("x", "y"):
        vals = sorted(v for g, v in data if g == k and v is not None)
        for p, g in zip(probs, got[k]):
            pos = (len(vals) - 1) * p
            lo = int(pos)
            hi = min(lo + 1, len(vals) - 1)
            assert g == pytest.approx(vals[lo] + (vals[hi] - vals[lo]) * (pos - lo), abs=1e-12)


def test_result_does_not_depend_on_partitioning(spark, split_everything):
    df = spark.createDataFrame(rows(5), "k string, v int, i int, w int")
    a = {(r["i"], r["p"]) for r in ranges.ordered_index(df.repartition(1), ["k"], ["v", "i"], "p").collect()}
    b = {(r["i"], r["p"]) for r in ranges.ordered_index(df.repartition(7), ["k"], ["v", "i"], "p").collect()}
    assert a == b


@pytest.mark.parametrize("hot", ["split_everything", "split_shuffled"])
def test_ranges_have_a_fixed_size(spark, request, hot):
    """Four times the rows give four times the ranges, not larger ones, and rows of a cut group lie in order."""
    request.getfixturevalue(hot)
    largest, number = [], []
    for n in (1000, 4000):
        df = spark.range(n).select((F.col("id") % 1000 == 0).cast("int").alias("k"), F.col("id").alias("_c"), F.lit(3).alias("_b"))
        cut = ranges._with_buckets(df, ["k"], ["_c"], ranges._hot_bounds(df, ["k"], ["_c"])).where("k = 0")
        assert cut.where("not _hot or _b <> 3").count() == 0
        sizes = cut.groupBy("_bucket").agg(F.count("*").alias("n"), F.min("_c").alias("lo"), F.max("_c").alias("hi")).orderBy("_bucket").collect()
        assert all(x["hi"] < y["lo"] for x, y in zip(sizes, sizes[1:]))
        largest.append(max(r["n"] for r in sizes))
        number.append(len(sizes))
    assert largest[1] < 2 * largest[0] and number[1] > 3 * number[0]


@pytest.mark.parametrize("hot", ["split_everything", "split_shuffled"])
def test_a_large_null_group_and_many_large_groups(spark, request, hot):
    request.getfixturevalue(hot)
    data = [(None if i % 2 else i % 7, None if i % 50 == 0 else i, 1) for i in range(700)]
    df = spark.createDataFrame(data, "k int, v int, w int")
    got = sorted(((r["k"] is not None, r["k"]), (r["v"] is not None, r["v"]), r["p"]) for r in ranges.prefix_sums(df.where("v is not null"), ["k"], ["v"], {"p": "w"}).collect())
    want, seen = [], {}
    for k, v, _ in sorted((x for x in data if x[1] is not None), key=lambda x: x[1]):
        want.append(((k is not None, k), (v is not None, v), seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    assert got == sorted(want)


@pytest.mark.parametrize("rows_to_a_range", [1 << 20, 24])
def test_table_index(spark, monkeypatch, rows_to_a_range):
    monkeypatch.setattr(ranges, "PLAN", ranges.RangePlan(rows=rows_to_a_range, sample=3, bounds=3))
    data = rows(5)
    df = spark.createDataFrame(data, "k string, v int, i int, w int").repartition(5)
    got = ranges.table_index(df, ["k", "v", "i"], "place", ["i", "w"])
    assert got.columns == ["i", "w", "place"]
    want = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    assert sorted((r["place"], r["i"], r["w"]) for r in got.collect()) == [(p, i, w) for p, (_, _, i, w) in enumerate(want)]
    assert ranges.table_index(df.limit(0), ["k"], "place").collect() == []


def test_score_rows_read_their_input_once(spark):
    from rankeval.sources.writers import score_rows

    seen = spark.sparkContext.accumulator(0)

    def count(part):
        for r in part:
            seen.add(1)
            yield r

    data = [(i, i % 2, "20240101", 0, f"f{i % 7}", f"u{i % 3}", i / 9) for i in range(300)]
    columns = "key long, label long, bizdate string, is_tagged long, feed_id string, user_id string, s double"
    df = spark.createDataFrame(spark.sparkContext.parallelize(data, 5).mapPartitions(count), columns)
    got = score_rows(df, "s", ["key"]).collect()
    assert sorted((r["idx"], r["score"]) for r in got) == [(i, i / 9) for i in range(300)]
    assert seen.value == 300
