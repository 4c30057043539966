"""A chat request is parsed once."""

import json

from pyspark.sql import functions as F

from rankeval.functions import requests

CASES = {
    "a": ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "one"}, {"role": "assistant", "content": "x"}]}, "one"),
    "b": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "image", "text": "no"}, {"type": "text", "text": "q"}]}]}, "pq"),
    "c": ({"messages": [{"role": "system", "content": "last"}]}, "last"),
    "d": ({"messages": []}, None),
    "e": ({"messages": [{"role": "user", "content": "  "}]}, None),
    "f": ({"messages": [{"role": "user", "content": {"type": "text"}}]}, None),
    "g": ({"messages": "none"}, None),
    "h": ({"messages": [{"role": "user"}]}, None),
}


def test_unwrapped_requests(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in CASES.items()] + [("i", "{nope"), ("j", None)]
    df = spark.createDataFrame(rows, "k string, chat string").repartition(2)
    out = df.select("k", requests.unwrap_chat(F.col("chat")).alias("text"))
    assert {r["k"]: r["text"] for r in out.collect()} == {**{k: want for k, (_, want) in CASES.items()}, "i": None, "j": None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1
