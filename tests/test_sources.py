import json

import pytest
from pyspark.sql import functions as F

from rankeval.operators import quality
from rankeval.sources import readers, store, writers


def test_parquet_paths_and_missing_columns(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit("a")).write.parquet(str(tmp_path / "t" / "deep" / "p1"))
    spark.range(2).write.parquet(str(tmp_path / "t" / "p2"))
    cols = {"id": "bigint", "x": "string", "gone": "double"}
    df = readers.read_parquet(spark, str(tmp_path / "t"), cols)
    assert df.count() == 5 and df.columns == list(cols) and df.where("x is not null").count() == 3
    assert readers.read_parquet(spark, str(tmp_path / "t" / "p2" / "*.parquet"), cols).count() == 2
    with pytest.raises(Exception):
        readers.read_parquet(spark, str(tmp_path / "none")).count()


def test_files_that_store_different_types(spark, tmp_path):
    write = lambda name, value: spark.range(2).select("id", F.expr(value).alias("v"), F.lit("p").alias("w")).write.parquet(str(tmp_path / "t" / name))
    for i, value in enumerate(["cast(id as int)", "id", "cast(id as string)", "named_struct('a', id, 'b', null)", "array(id, id)", "cast(id as double)"]):
        write(f"x{i}", value)
    spark.range(2).write.parquet(str(tmp_path / "t" / "x6"))
    df = readers.read_parquet(spark, str(tmp_path / "t"), {"id": "bigint", "v": "string", "none": "int"})
    got = sorted((r["v"] or "", r["id"]) for r in df.collect())
    assert got == sorted([("0", 0), ("1", 1)] * 3 + [('{"a":0}', 0), ('{"a":1}', 1), ("[0,0]", 0), ("[1,1]", 1), ("0.0", 0), ("1.0", 1), ("", 0), ("", 1)])
    numbers = readers.read_parquet(spark, [str(tmp_path / "t" / f"x{i}") for i in (0, 1, 2)], {"v": "bigint"})
    assert sorted(r["v"] for r in numbers.collect()) == [0, 0, 0, 1, 1, 1]
    plan = readers.read_parquet(spark, str(tmp_path / "t" / "x1"), {"v": "bigint", "w": "string"}).where("v = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v,1)" in plan and "id#" not in plan.split("ReadSchema")[1]


def test_days_are_added_once(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    path = str(tmp_path / "days")
    src = spark.createDataFrame([(d, i) for d in ("20240101", "20240102", "20240103") for i in range(3)], "bizdate string, i int")
    writers.ingest_days(src, path, readers.date_range(spark, "20240101", "20240102"))
    changed = src.withColumn("i", F.col("i") + 100)
    writers.ingest_days(changed, path, readers.date_range(spark, "20240101", "20240104"))
    back = readers.scan_day(spark, path, "20240102")
    assert sorted(r["i"] for r in back.collect()) == [0, 1, 2]
    assert sorted(r["i"] for r in readers.scan_day(spark, path, "20240103").collect()) == [100, 101, 102]
    assert "PartitionFilters: [isnotnull(bizdate" in back._jdf.queryExecution().executedPlan().toString()
    log = {r["day"]: r["rows"] for r in writers.ingested(spark, path).collect()}
    assert log == {"20240101": 3, "20240102": 3, "20240103": 3}
    spark.conf.unset("spark.sql.sources.partitionColumnTypeInference.enabled")


def test_a_run_lost_before_its_log_is_repeated_whole(spark, tmp_path, monkeypatch):
    path = tmp_path / "days"
    src = spark.createDataFrame([(d, i) for d in ("20240101", "20240102") for i in range(3)], "bizdate string, i int")
    days = readers.date_range(spark, "20240101", "20240103")
    with monkeypatch.context() as m:
        m.setattr(writers, "exists", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            writers.ingest_days(src, str(path), days.where("bizdate = '20240101'"))
    (path / "_ingested" / "run=begun").mkdir(parents=True)  # a log that was never closed
    (path / "_ingested" / "run=other").mkdir()
    (path / "_ingested" / "run=other" / "_SUCCESS").touch()
    assert sorted((r["day"], r["rows"]) for r in writers.ingest_days(src, str(path), days).collect()) == [("20240101", 3), ("20240102", 3)]
    assert writers.ingest_days(src.withColumn("i", F.col("i") + 9), str(path), days).count() == 0
    assert sorted(r["i"] for r in spark.read.parquet(str(path)).collect()) == [0, 0, 1, 1, 2, 2]


def test_a_target_without_log_is_known_by_its_folders(spark, tmp_path):
    path = str(tmp_path / "days")
    src = spark.createDataFrame([("20240101", 1), ("20240102", 2)], "bizdate string, i int")
    writers.write_days(src.where("i = 1"), path)
    assert [r["day"] for r in writers.ingested(spark, path).collect()] == ["20240101"]
    added = writers.ingest_days(src.withColumn("i", F.col("i") + 5), path, readers.date_range(spark, "20240101", "20240102"))
    assert [r["day"] for r in added.collect()] == ["20240102"]
    # the first day's folder is older than the log: it is looked for once more, and stays
    assert sorted(r["i"] for r in spark.read.parquet(path).collect()) == [1, 7]


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"feed_id":"a","label":1}\n\n{"label":0,"user_id":"ü"}\n', encoding="utf-8")
    schema = "feed_id string, user_id string, bizdate string, label int, is_tagged int, history array<struct<title:string,summary:string>>"
    rows = readers.read_jsonl(spark, str(good), schema).collect()
    assert [(r["feed_id"], r["user_id"], r["bizdate"], r["is_tagged"], r["history"]) for r in rows] == [("a", "", "", 0, []), ("", "ü", "", 0, [])]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"feed_id":"a"}\n{oops\n   \n{"feed_id":"b"}\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(bad), schema).collect()
    assert [r["feed_id"] for r in readers.read_jsonl(spark, str(bad), schema, on_error="skip").where("feed_id <> ''").collect()] == ["a", "b"]
    assert tuple(readers.bad_lines(spark, str(bad)).first()) == ("bad.jsonl", 3, 1)


def test_metric_files(spark, tmp_path):
    row = lambda s, a: {"split": s, "n": 10, "pos": 1, "neg": 9, "ctr": 0.1, "auc": a}
    (tmp_path / "eval_tagged_ckpt_5.json").write_text(json.dumps([row("TAGGED", 0.6), row("ALL", 0.7)], indent=2))
    (tmp_path / "eval_all.json").write_text(json.dumps([row("ALL", 0.5)]))
    (tmp_path / "eval_bad_x.json").write_text("{nope")
    got = [tuple(r) for r in readers.collect_metric_files(spark, str(tmp_path / "eval_*.json")).select("run", "checkpoint", "split", "auc").collect()]
    assert got == [("all", "?", "ALL", 0.5), ("tagged", "ckpt_5", "ALL", 0.7), ("tagged", "ckpt_5", "TAGGED", 0.6)]


def test_run_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("max memory: 10.5 GiB\n{'train_samples_per_second': 3.5}\nx\ntrain_samples_per_second=4.25\nmax memory 11 GB\n")
    (tmp_path / "b.log").write_text("train_steps_per_second: 0.5\nCUDA out of memory\n")
    (tmp_path / "c.log").write_text("nothing\n")
    codes = spark.createDataFrame([("b.log", 1), ("c.log", 3)], "file string, exit_code int")
    got = {r["file"]: (r["samples_per_second"], r["steps_per_second"], r["peak_memory"], r["status"]) for r in readers.extract_run_log(spark, str(tmp_path), codes).collect()}
    assert got == {"a.log": ("4.25", None, "11", "OK"), "b.log": (None, "0.5", None, "OOM"), "c.log": (None, None, None, "FAIL(3)")}


def test_tsv_and_test_set(spark, tmp_path):
    line = lambda t, b: "\t".join(["1", "2", "3", "4", t, b])
    (tmp_path / "in.tsv").write_text("\n".join([line("one two three", "x"), line("too short", "y"), "a\tb", line(" one two three ", "later"), line("four five six", "z")]))
    rows = readers.read_tsv_titles(spark, str(tmp_path / "in.tsv"))
    got = quality.build_test_set(rows, ["file", "block", "line"]).collect()
    assert [(r["title"], r["body"]) for r in got] == [("one two three", "x"), ("four five six", "z")]


def test_upsert(spark, tmp_path):
    df = spark.createDataFrame([("c1", "p", 1), ("c1", "p", 2), (None, "p", 3), ("c2", "q", 4)], "conversation_id string, pk string, v int")
    rows = writers.prepare_upsert(df, "pk", latest=["v"])
    assert sorted(r["v"] for r in rows.collect()) == [2, 3, 4]
    assert rows.where("id is null or id = ''").count() == 0
    with pytest.raises(ValueError):
        writers.prepare_upsert(df, "missing")
    root = str(tmp_path / "store")
    store.upsert(rows, root, ["id", "pk"])
    update = writers.prepare_upsert(spark.createDataFrame([("c2", "q", 40)], df.schema), "pk")
    store.upsert(update, root, ["id", "pk"])
    assert sorted(r["v"] for r in store.read(spark, root).collect()) == [2, 3, 40]


def file_bytes(root):
    return {p.relative_to(root): p.read_bytes() for p in root.rglob("*.parquet")}


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    root = tmp_path / "store"
    keyed = lambda rows: spark.createDataFrame(rows, "id string, v int")
    assert store.upsert(keyed([(f"k{i}", i) for i in range(300)] + [(None, -1)]), str(root), buckets=16, rows_per_file=10) == 1
    before, first = file_bytes(root / "data"), store.manifest(spark, str(root))
    assert set(first) == set(range(16)) and len(before) > 16
    assert store.upsert(keyed([("k7", 70), ("new", 5), (None, -2)]), str(root)) == 2
    after, second = file_bytes(root / "data"), store.manifest(spark, str(root))
    assert all(after[name] == data for name, data in before.items())
    assert 1 <= sum(first[b] != second[b] for b in first) <= 3
    rows = {r["id"]: r["v"] for r in store.read(spark, str(root)).collect()}
    assert rows == {f"k{i}": i for i in range(300)} | {"k7": 70, "new": 5, None: -2}
    assert store.read(spark, str(root), version=1).where("id = 'k7'").first()["v"] == 7
    assert store.upsert(keyed([]), str(root)) == 3 and store.manifest(spark, str(root)) == second
    assert store.upsert(keyed([("k7", 71)]).withColumn("more", F.lit("x")), str(root)) == 4
    assert store.read(spark, str(root)).where("more is null").count() == 301


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "id string, v int")
    store.upsert(df, root, buckets=4)
    with pytest.raises(Exception, match="broken"):
        store.upsert(df.withColumn("v", F.when(F.col("v") == 30, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("v") + 1000)), root)
    assert store.versions(spark, root) == [1] and store.read(spark, root).agg(F.max("v")).first()[0] == 49
    # data written, manifest not: as if the driver had been lost in between
    with monkeypatch.context() as m:
        m.setattr(store.SparkSession, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.upsert(df.withColumn("v", F.col("v") + 1000), root)
    assert store.read(spark, root).agg(F.max("v")).first()[0] == 49
    (tmp_path / "store" / "manifest" / "version=2").mkdir()  # begun, not closed
    assert store.versions(spark, root) == [1] and store.upsert(df.withColumn("v", F.col("v") + 1), root) == 3
    assert store.read(spark, root).agg(F.max("v")).first()[0] == 50
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "none"))


def test_rows_alike_keep_rows_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(writers, "ALIKE", 7)
    df = spark.createDataFrame([("p", {"a": 1})] * 30 + [("q", None)] * 2, "pk string, m map<string,int>")
    rows = writers.prepare_upsert(df, "pk").collect()
    assert len({r["id"] for r in rows}) == 32 and sum(r["pk"] == "p" for r in rows) == 30 and {r["m"]["a"] for r in rows if r["m"]} == {1}
    assert {r["id"] for r in writers.prepare_upsert(df.repartition(5), "pk").collect()} == {r["id"] for r in rows}


def test_profiles(spark, tmp_path):
    spark.createDataFrame([("t" * 300, 1)], "a string, b int").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    got = {r["column"]: (r["type"], len(r["preview"])) for r in readers.profile_table(df).collect()}
    assert got == {"a": ("string", 200), "b": ("int", 1)}
    assert readers.file_profile(df).first()["rows"] == 1


def test_null_keys_match_each_other(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("b", 1), (None, 3)], "k string, v int")
    assert {(r["k"], r["side"]) for r in quality.key_match(left, right, ["k"]).collect()} == {("a", "only_left"), ("b", "only_right"), (None, "both")}
    assert {r["set"]: r["keys"] for r in quality.key_sets(left, right, ["k"]).collect()} == {"union": 3, "intersection": 1, "only_left": 1, "only_right": 1}
    m = quality.reconcile(left, right, ["k"], ["v"])
    assert m.where("k is null").first()["same_v"] is False
