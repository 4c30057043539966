"""Time limits and shares of remote calls, token ledgers, split counts."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from rankeval.operators import models, prompts, scoring
from tests.test_feeds import samples


def test_a_call_that_hangs_is_given_up(spark):
    def client(t):
        if t == "hang":
            time.sleep(600)
        return {"score": 0.75}

    df = spark.createDataFrame([("hang",), ("a",), ("b",)], "prompt string").coalesce(1)
    began = time.monotonic()
    got = {r["prompt"]: r for r in scoring.call_scorer(df, client, concurrency=1, retries=2, backoff_s=0.0, timeout_s=0.5).collect()}
    assert time.monotonic() - began < 30
    assert got["hang"]["failed"] and got["hang"]["score"] == 0.5 and got["hang"]["attempts"] == 2 and "0.5 s" in got["hang"]["error"]
    assert got["a"]["score"] == got["b"]["score"] == 0.75


def test_the_whole_job_keeps_to_its_calls(spark, tmp_path):
    folder = str(tmp_path)

    def client(t):
        mine = os.path.join(folder, f"now-{t}")
        open(mine, "w").close()
        seen = sum(n.startswith("now-") for n in os.listdir(folder))
        time.sleep(0.03)
        os.remove(mine)
        return {"score": seen / 100}

    df = spark.range(120).select(F.col("id").cast("string").alias("prompt")).repartition(12)
    rows = scoring.call_scorer(df, client, concurrency=5, slots=2, retries=1).collect()
    most = max(r["score"] for r in rows)
    assert len(rows) == 120 and not any(r["failed"] for r in rows) and 0.02 <= most <= 0.05
    with pytest.raises(ValueError):
        scoring.call_scorer(df, client, concurrency=2, slots=3)


def test_errors_reach_the_row(spark):
    def client(t):
        raise KeyError("no such model")

    r = scoring.call_scorer(spark.createDataFrame([("x",)], "prompt string"), client, retries=1, timeout_s=5.0).first()
    assert r["failed"] and "no such model" in r["error"]


PIECES = r"\w{1,4}|[^\w\s]|\s+"  # joins white space across lines, as tokenizers may


def test_the_ledger_picks_what_rendering_all_picks(spark):
    df = samples(spark)
    count = lambda t: len(re.findall(PIECES, t))
    native = lambda c: F.regexp_count(c, F.lit(PIECES))
    total = count(df.select(prompts.full_prompt(F.col("history"), F.col("interests"), F.col("candidate"))).first()[0])
    old = prompts.body_budget
    try:
        for budget in range(40, total + 20, 97):
            prompts.body_budget = lambda max_len, budget=budget: budget
            want = prompts.budgeted_prompt(df, 0, native).select("prompt", "truncated", "dropped_history", "dropped_conversations").collect()
            got = prompts.budgeted_prompt_with(df, 0, count, renders="renders").select("prompt", "truncated", "dropped_history", "dropped_conversations", "renders").collect()
            assert [tuple(r)[:4] for r in got] == [tuple(r) for r in want]
            assert all(r["renders"] <= 4 for r in got)
    finally:
        prompts.body_budget = old


def test_split_counts_are_those_of_the_inner_nodes(spark):
    rows = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.lit(1.0).alias("c"), ((F.col("id") % 7 > 3) | (F.col("id") % 5 == 0)).cast("int").alias("label"))
    fitted = {"one": models.ctr_model(rows, ["a", "b", "c"], max_iter=4, depth=3), "two": models.ctr_model(rows, ["c", "a"], balance=False, max_iter=2, depth=2)}
    got = models.feature_importance(spark, fitted).collect()
    for name, model in fitted.items():
        inner = sum((t.numNodes - 1) // 2 for t in model.stages[-1].trees)
        assert sum(r["splits"] for r in got if r["model"] == name) == inner
        assert all((r["splits"] == 0) == (r["mean_gain"] is None) for r in got)
    assert {(r["model"], r["feature"]): r["splits"] for r in got}["one", "c"] == 0
    leaves = models.tree_nodes(spark, fitted["one"]).where("feature is null").count()
    assert leaves == sum((t.numNodes + 1) // 2 for t in fitted["one"].stages[-1].trees)
