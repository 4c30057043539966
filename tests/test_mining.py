from rankeval.operators.sampling import mine_negatives


def feeds(sizes):
    """Per feed two clicked rows and as many others as told."""
    return [(f"f{f}", i, int(i < 2)) for f, n in enumerate(sizes) for i in range(n + 2)]


def test_feeds_around_the_wanted_number(spark):
    k = 4
    sizes = [0, 1, 3, 4, 5, 8, 9, 30]
    df = spark.createDataFrame(feeds(sizes), "feed string, item int, label int").repartition(3)
    got = mine_negatives(df, "feed", ["item"], k=k).collect()
    for f, n in enumerate(sizes):
        for item in (0, 1):
            mine = [r for r in got if (r["anchor_feed"], r["anchor_item"]) == (f"f{f}", item)]
            session = {(r["neg_feed"], r["neg_item"]) for r in mine if r["source"] == "in_session"}
            cross = {(r["neg_feed"], r["neg_item"]) for r in mine if r["source"] == "cross_feed"}
            assert len(mine) == k and len(session) == min(n, k) and len(cross) == k - len(session)
            assert all(g == f"f{f}" and 2 <= i < n + 2 for g, i in session)
            assert all(g != f"f{f}" and i < 2 for g, i in cross)


def test_wanted_rows_are_looked_up_without_a_sort(spark):
    """The far larger side of the join by number is neither sorted nor, where a feed has few others, dealt by number at all."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame(feeds([3] * 20), "feed string, item int, label int")
        plan = mine_negatives(df, "feed", ["item"], k=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin [_idx" in plan
    assert "SortMergeJoin [feed#" in plan and "_m#" in plan


def test_tiles_of_the_ring_give_the_pairs_found_by_number(spark, monkeypatch):
    """Feeds of one to five clicks go by tiles, where enough want the same number, and one of a hundred by number."""
    from pyspark.sql import functions as F

    from rankeval.operators import sampling
    from rankeval.sources.staging import scratch_path

    f = F.col("id")
    sized = spark.range(4000).select(
        F.concat(F.lit("f"), f).alias("feed"), F.when(f == 7, 100).otherwise(1 + F.pmod(F.xxhash64(f), F.lit(5))).alias("clicks"),
        F.when(f % 50 == 0, 3).otherwise(F.when(f % 3 == 0, 0).otherwise(f % 4)).alias("others"),
    )
    path = scratch_path(spark, "feeds")
    sized.select("feed", F.explode(F.expr("sequence(1, clicks + others)")).alias("item"), "clicks").select(
        "feed", "item", (F.col("item") <= F.col("clicks")).cast("int").alias("label"), F.date_add(F.lit("2024-01-01"), F.col("item").cast("int")).alias("day")
    ).write.parquet(path)
    df = spark.read.parquet(path)
    key = ["anchor_feed", "anchor_item", "anchor_day", "source", "neg_feed", "neg_item", "neg_day"]
    want = mine_negatives(df, "feed", ["item", "day"], k=4)
    monkeypatch.setattr(sampling, "_POOL_ROWS", 1000)
    monkeypatch.setattr(sampling, "_TILE_PAIRS", 1)
    got = mine_negatives(df, "feed", ["item", "day"], k=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ShuffledHashJoin [_idx" in plan
    assert "FlatMapCoGroupsInArrow" not in want._jdf.queryExecution().executedPlan().toString()
    assert got.dtypes == want.dtypes
    rows = {tuple(r) for r in got.select(key).collect()}
    assert rows == {tuple(r) for r in want.select(key).collect()} and len(rows) == got.count()
    assert {n for a, *_, s, n, _, _ in rows if a == "f7" and s == "cross_feed"}


def test_rows_that_were_numbered_are_not_kept(spark):
    from pathlib import Path

    from pyspark.sql import functions as F

    from rankeval.operators.ranges import table_index
    from rankeval.sources.staging import discard, scratch_path, written

    source = scratch_path(spark, "source")
    spark.range(50).write.parquet(source)
    folder = Path(source.removeprefix("file:")).parent
    before = set(folder.glob("rows-*"))
    got = table_index(spark.read.parquet(source).withColumn("h", F.md5(F.col("id").cast("string"))), ["h"], "at", ["id"])
    assert set(folder.glob("rows-*")) == before and got.count() == 50 and got.agg(F.sum("at")).first()[0] == 49 * 25
    discard(spark.read.parquet("/root/testdata/sf0.001/nation.parquet"))  # not in the scratch folder
    assert spark.read.parquet("/root/testdata/sf0.001/nation.parquet").count() == 25
    kept = written(spark.range(3).toDF("x"), "rows")
    assert kept.count() == 3
