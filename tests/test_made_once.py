"""Rows that are costly to make are made once."""

from pyspark.sql import functions as F

from rankeval.operators import flatten, quality


def counted(spark, data, columns):
    seen = spark.sparkContext.accumulator(0)

    def count(part):
        for r in part:
            seen.add(1)
            yield r

    return spark.createDataFrame(spark.sparkContext.parallelize(data, 3).mapPartitions(count), columns), seen


def test_fixture_pair(spark):
    data = [(f"u{i % 4}", f"f{i:02d}", i, 1) for i in range(40)]  # one label: the fallback reads the rows again
    df, seen = counted(spark, data, "user_id string, feed_id string, itemid int, label int")
    got = quality.pick_fixture_pair(df, F.lit(True), ["feed_id", "itemid"]).collect()
    assert sorted(r["feed_id"] for r in got) == ["f00", "f04"]
    assert seen.value == 40


def test_keys_of_a_feed_cap_are_those_of_its_records(spark):
    card = '[{"itemid":"a","sectionIndex":"0","features":{}},7]'
    data = [
        ("f1", "20240101", "x", card, '[{"name":"n","strength":1}]'), ("f2", "20240101", "x", '[{"itemid":"a"}]', '[{"name":"n"}]'),
        ("f3", "20240101", "x", card, '[{"name":" "}]'), ("f4", "20240101", "x", None, None), ("f5", "20250101", "x", card, '[{"name":"n"}]'),
        ("f6", "20240102", "y", card, '[{"name":"n"}]'), ("f7", "", "x", card, '[{"name":"n"}]'),
        ("f8", "20240102", "x", '[{"sectionIndex":1,"features":"none"}]', '[{"name":"n"}]'), ("f9", "20240102", None, card, "[]"),
    ]
    df = spark.createDataFrame(data, "feed_id string, bizdate string, flight_ids string, candidate_cards string, interests string")
    for args in [("", "", "", False, False), ("", "", "", False, True), ("20240101", "20240102", "x", True, True), ("", "", "", True, False)]:
        keys = flatten._surviving(df.withColumn("_key", F.col("feed_id")), *args).select("_key").collect()
        whole = flatten._inline_feeds(df, *args, 30, 0, 0, 0, rows_of=flatten._one_record).select("feed_id").collect()
        assert sorted(r[0] for r in keys) == sorted(r[0] for r in whole) != []


def test_samples_of_both_sides(spark):
    from rankeval.plans.catalog import QUERIES

    plan = QUERIES["reconcile_samples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "candidate_cards" not in plan and "itemid" in plan
