"""What the near-duplicate operator keeps and deals."""

import contextlib
import io
import re

import pyarrow as pa

from rankeval.llm import jaccard
from rankeval.llm.shingles import shingles
from tests.llm.test_jaccard import corpus


def test_documents_keep_neither_bitmaps_nor_keys(spark):
    docs = spark.createDataFrame(corpus(5), "doc_id long, text string")
    sketch, _ = jaccard._grouped(docs, 5, 4, 5, "doc_id", "text")
    assert sorted(sketch.columns) == ["doc_id", "h1", "h2", "n", "row"]


def test_sets_are_dealt_twice(spark, monkeypatch):
    """By what they are known by, and to their tiles."""
    plans = []

    def recorded(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("formatted")
        plans.append(out.getvalue())
        return real(df)

    real = jaccard.stage
    monkeypatch.setattr(jaccard, "stage", recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jaccard.join(spark.createDataFrame(corpus(5), "doc_id long, text string")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*shingles#", p)) for p in plans]
    assert max(dealt) == 2


def test_a_task_holds_a_few_texts(spark):
    texts = pa.array(["x" * 1000, None, "é" * 300_000, ""] * 500).slice(1)
    found = list(jaccard._pieces(texts))
    assert [t for _, _, part in found for t in part] == texts.to_pylist() and [a for a, _, _ in found] == [0] + [b for _, b, _ in found[:-1]]
    assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= jaccard.PIECE_BYTES for _, _, part in found)


def test_whole_rows_are_dealt_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            jaccard.one_of_each(spark.createDataFrame(corpus(5), "doc_id long, text string")).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"\) Exchange\nInput", out.getvalue())) == 2  # whole rows, and the numbers of those that stay


def test_rows_are_marked_a_piece_at_a_time(monkeypatch):
    sizes = []
    monkeypatch.setattr(jaccard, "shingles", lambda texts, k: sizes.append(sum(len(t or "") for t in texts)) or shingles(texts, k))
    rows = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(["one two three four five six " * 200, None] * 200)], names=["c0", "c1"])
    found = pa.Table.from_batches(list(jaccard._marked(iter([rows]), 1, 5)))
    assert found.column("c0").to_pylist() == list(range(400)) and found.column("c2").to_pylist() == [6, 0] * 200
    assert len(sizes) > 1 and max(sizes) <= jaccard.PIECE_BYTES
