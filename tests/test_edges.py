"""Input that simple data do not hold: nulls, ties, half cents, blanks, repeated keys."""

import math

import pytest
from pyspark.sql import functions as F

from rankeval.functions import context, scores
from rankeval.operators import audit, flatten, metrics, quality, sampling


def test_two_decimals_follow_the_stored_value(spark):
    values = [i / 1000 for i in range(0, 3000)] + [0.125, 2.675, 1.005, 0.375, 1e6 + 0.005, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", context.two_decimals(F.col("v")).alias("t")).collect()
    assert [(r["v"], r["t"]) for r in got if r["t"] != f"{r['v']:.2f}"] == []


def test_null_and_nan_have_no_loss(spark):
    df = spark.createDataFrame([(0.5, 1), (None, 1), (float("nan"), 0), (0.5, None)], "p double, y int")
    assert [r[0] for r in df.select(scores.clip(F.col("p"), 0.6, 1.0)).collect()] == [0.6, None, None, 0.6]
    row = metrics.log_loss(df, "p", "y").first()
    assert abs(row["log_loss"] - math.log(2)) < 1e-12 and row["excluded"] == 3
    assert metrics.weighted_ce(df, "p", "y", F.lit(2.0)).first()["excluded"] == 3


def test_auc_leaves_null_labels_out(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (0.5, None)], "s double, y int")
    row = metrics.auc(df, "s", "y").first()
    assert (row["n"], row["pos"], row["neg"], row["auc"]) == (2, 1, 1, 1.0)


def test_null_categories_count(spark):
    rows = [("a", 0), ("a", 1), (None, 0), (None, 0), ("b", 1), ("b", None)]
    df = spark.createDataFrame(rows, "c string, p int")
    named = spark.createDataFrame([(a or "none", -1 if b is None else b) for a, b in rows], "c string, p int")
    for f in (audit.mutual_information, audit.chi_square):
        a, b = (f(x, "c", "p").first() for x in (df, named))
        assert all(abs(x - y) < 1e-12 for x, y in zip(a, b))


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 9])
def test_repeated_keys_are_cut(spark, n):
    df = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "k int, v int")
    first, again = (sorted(map(tuple, sampling.sample_n(x, n, ["k"]).collect())) for x in (df, df.repartition(3)))
    assert len(first) == min(n, 6) and first == again


def test_a_small_slot_limit_gives_the_same_rows(spark, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "k")
    want = sorted(r[0] for r in sampling.sample_n(df, 777, ["k"]).collect())
    monkeypatch.setattr(sampling, "_SLOT_ROWS", 1)
    assert sorted(r[0] for r in sampling.sample_n(df, 777, ["k"]).collect()) == want and len(want) == 777


def test_dates_are_trimmed_and_reach_the_scan(spark, tmp_path):
    days = ["20240101", " 20240103", "20240103 ", "\t20240102", "20240104", "", "  ", None]
    df = spark.createDataFrame([(d,) for d in days], "d string")
    kept = lambda **k: [r[0] for r in df.where(flatten.date_between(F.col("d"), **k)).collect()]
    assert kept(lo="20240102", hi="20240103") == [" 20240103", "20240103 ", "\t20240102", "", "  ", None]
    assert kept(lo="20240102", hi="20240103", keep_blank=False) == [" 20240103", "20240103 ", "\t20240102"]
    assert len(kept(hi="20240101", keep_blank=False)) == 4 and len(kept()) == 8
    df.write.parquet(str(tmp_path / "d"))
    def plan(condition):
        return spark.read.parquet(str(tmp_path / "d")).where(condition)._jdf.queryExecution().executedPlan().toString()

    assert "LessThan(d,20240103!)" in plan(flatten.date_between(F.col("d"), "20240102", "20240103"))
    assert "StringContains(d,x)" in plan(flatten.has_tag(F.col("d"), "x"))


def test_maps_are_compared_by_content(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, m map<string,string>")
    left, right = make([(1, {"a": "1", "b": "2"}), (2, {"a": "1"}), (3, None)]), make([(1, {"b": "2", "a": "1"}), (2, {"a": "2"}), (3, None)])
    rows = quality.reconcile(left, right, ["k"], ["m"]).orderBy("k").collect()
    assert [r["same_m"] for r in rows] == [True, False, True]


def test_reconciled_values_travel_as_fingerprints(spark):
    """Also values that differ only at the end of a long text or by a null inside are told apart, and no long text is shuffled."""
    long = "long text " * 20
    shape = "k int, t string, n struct<a:array<string>,b:struct<c:string,d:int>>, x array<double>, m map<string,string>"
    row = lambda k, t, a, c, x, m: (k, t, (a, (c, 1)), x, m)
    left = [
        row(1, long, [long, None], long, [0.0], {"a": long, "b": "1"}), row(2, long + "a", [long], None, [float("nan")], {"a": long}),
        row(3, "x", None, "c", [1.0], None), (4, None, None, None, None), row(5, long, [long], long, [1.0], {}),
    ]
    right = [
        row(1, long, [long, None], long, [-0.0], {"b": "1", "a": long}), row(2, long + "b", [long], "", [float("nan")], {"a": long + "."}),
        row(3, "y", [], "c", [2.0], {}), (4, None, None, None, None), row(6, long, [long], long, [1.0], {}),
    ]
    l, r = (spark.createDataFrame(rows, shape) for rows in (left, right))
    fields = ["t", "n", "x", "m"]
    same = [f"same_{f}" for f in fields]
    m = quality.reconcile(l, r, ["k"], fields)
    got = {x["k"]: (x["side"], *[x[f] for f in same]) for x in m.collect()}
    assert got == {
        1: ("both", True, True, True, True), 2: ("both", False, False, True, False), 3: ("both", False, False, False, False),
        4: ("both", True, True, True, True), 5: ("only_left", *[None] * 4), 6: ("only_right", *[None] * 4),
    }
    assert {x["k"]: x["left_t"] for x in m.collect()}[2] == long + "a"  # whole values come back
    marks = quality.fingerprinted(l, fields)
    assert [len(x["n"]) for x in marks.where("k in (1, 2, 5)").collect()] == [65] * 3 and marks.where("k = 3").first()["t"] == "x"
    again = quality.reconcile(marks, quality.fingerprinted(r, fields), ["k"], fields)
    assert {x["k"]: (x["side"], *[x[f] for f in same]) for x in again.collect()} == got


def test_reconcile_samples_keeps_no_interests(spark):
    from rankeval.plans.catalog import QUERIES

    staged = spark.read.parquet(*QUERIES["reconcile_samples"](spark, "/root/testdata/sf0.001").inputFiles())
    assert dict(staged.dtypes)["interests"] == "string" and staged.agg(F.max(F.length("interests"))).first()[0] == 65
