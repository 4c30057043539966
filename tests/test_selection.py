"""The cut of a text order, found by prefixes, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from rankeval.operators import selection


@pytest.fixture(params=[5, 65_536])
def few(request, monkeypatch):
    monkeypatch.setattr(selection, "FEW", request.param)
    monkeypatch.setattr(selection, "ALIKE", 4)


def texts(rnd, n):
    shapes = ["", "same", "same", "f{}", "f{}", "feed-{}-x", "ü{}", "😀{}", "f1{}"]
    return [rnd.choice(shapes).format(rnd.randrange(40)) for _ in range(n)]


def test_the_nth_smallest(spark, few):
    data = texts(random.Random(1), 300)
    df = spark.createDataFrame([(t,) for t in data], "k string").repartition(3)
    order = sorted(data)
    for n in (1, 37, 299):
        cut = selection.nth_smallest(df, n)
        assert cut == selection.Cut(order[n - 1], sum(t < order[n - 1] for t in data), data.count(order[n - 1]))
    assert selection.nth_smallest(df, 300) is None and selection.nth_smallest(df.limit(0), 1) is None


def test_first_rows_with_ties_nulls_and_equal_rows(spark, few):
    rnd = random.Random(2)
    data = [(rnd.choice([None, "a", "a", "b"]), rnd.randrange(3)) for _ in range(60)]
    df = spark.createDataFrame(data, "k string, v int").withColumn("m", F.create_map(F.lit("x"), F.col("v")))
    order = sorted(k or "" for k, _ in data)
    for n in (0, 7, 30, 59, 99):
        got = [tuple(r)[:2] for r in selection.first_by(df, F.col("k"), n).collect()]
        assert sorted(k or "" for k, _ in got) == order[:n]
        assert all(got.count(x) <= data.count(x) for x in set(got))
        again = [tuple(r)[:2] for r in selection.first_by(df.repartition(5), F.col("k"), n).collect()]
        assert sorted(again, key=str) == sorted(got, key=str)


def test_only_rows_up_to_the_cut_are_made(spark, few):
    df = spark.range(200).select(F.format_string("f%03d", "id").alias("k"), "id")
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def whole(i):
        made.add(1)
        return i * 2

    out = selection.first_by(df, F.col("k"), 10, lambda rows: rows.where("id % 2 = 1").withColumn("w", whole("id").cast("long")))
    assert sorted(r["w"] for r in out.select("w").collect()) == [2 * i for i in range(1, 20, 2)]
    assert made.value <= 10
