import hashlib
import io

import pytest
from pyspark.sql import functions as F

from rankeval.llm import mixing, url_filter, warc
from rankeval.llm.queries import ALLOW, BLOCK, ORACLES, QUERIES
from rankeval.llm.storage import new_folder
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_mix_sources", "op8_url_filter", "op10_warc"])
def test_query_against_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF) is None


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, `x.y` int")


def words(n):
    return " ".join(["w"] * n)


def test_mix_takes_the_targets(spark):
    rows = [(i, words(1 + i % 700), s, 1, 1) for i, s in enumerate("aaaaaaaabbbc" * 40)]
    rows += [(1000, None, "a", 1, 1), (1001, "", None, 1, 1), (1002, words(9000), None, 1, 1), (1002, words(9000), None, 1, 1), (None, "x y", "tiny", 1, 1)]
    pieces, out = mixing.mix(docs(spark, rows), block=64)
    by = out.join(docs(spark, rows).select("doc_id", "source").distinct(), "doc_id", "left").groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(r["t"] == int(r["target"]) and r["target"] <= 2 * r["source_size"] for r in by)
    assert out.where("taken > 2 * size").count() == 0 and out.count() == len(rows)
    total = sum(len((r[1] or "").split()) for r in rows)
    assert abs(out.select("source_size", "target").distinct().agg(F.sum("target")).first()[0] - 1.5 * total) < 1e-6
    slots = pieces.groupBy("slot").agg(F.sum("length").alias("n"), F.countDistinct("source").alias("s"))
    assert slots.where("n > 64 or s > 1").count() == 0
    # no piece overlaps another of the same use
    assert pieces.groupBy("row", "pass_no").agg(F.sum("length").alias("n"), F.min("start").alias("lo"), F.max(F.col("start") + F.col("length")).alias("hi")).where("hi - lo <> n").count() == 0


def test_mix_reruns_agree_whatever_the_partitions(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (sorted(map(tuple, mixing.mix(x)[1].drop("row").collect())) for x in (d, d.repartition(7)))
    assert a == b


def test_mix_of_nothing(spark):
    for rows in ([], [(1, None, None, 1, 1), (2, "", "a", 1, 1)]):
        pieces, out = mixing.mix(docs(spark, rows))
        assert pieces.count() == 0 and [r["taken"] for r in out.collect()] == [0] * len(rows)


def test_schedule_keeps_close_to_the_shares(spark):
    sources = spark.createDataFrame([(0, 5000.0), (1, 2000.0), (2, 1000.0)], "idx long, target double")
    for r in mixing.schedule(sources, 800, 10).where("slot < 400").groupBy("idx").count().collect():
        assert abs(r["count"] - [250, 100, 50][r["idx"]]) <= 3


URLS = [
    (1, "https://WWW.Example.ORG/es/x", "example.org/es/", "block"), (2, "http://example.org/en/12?x", "example.org/en/1", "block"),
    (3, "http://a.example.org/en/2", "org/", "allow"), (4, "http://xorg/es/", None, "allow"), (5, "http://b.com/de/#x", "com/de/", "block"),
    (6, "http://b.com/fr/", "com/fr/", "allow"), (7, "http://b.com/de", None, "allow"), (8, None, None, "allow"), (9, "no scheme", None, "allow"),
    (10, "http://b.org", None, "allow"), (11, "http://b.org?x=://c.com/de/", None, "allow"), (12, "", None, "allow"), (None, "http://.org/", "org/", "allow"),
    (13, "x://" + "a." * 30_000 + "org/es/" + "y" * 50_000, "org/", "allow"), (14, "http://c\n.com/de/\n", "com/de/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(a, b, 1, "x") for a, b, _, _ in URLS] * 2, "page_id long, url string, host int, `best.rule` string")
    got = sorted(((r["page_id"] or 0, r["rule"] or "", r["verdict"]) for r in url_filter.judge(pages, ALLOW, BLOCK).collect()))
    assert got == sorted([(a or 0, c or "", d) for a, _, c, d in URLS] * 2)
    assert url_filter.judge(pages.limit(0), ALLOW, BLOCK).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(0, 3000).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    universe = spark.range(0, 30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = url_filter.Cascade(listed, universe, rate=0.3)
    assert len(cascade.levels) > 3
    wrong = universe.select(cascade.contains(F.col("key")).alias("in"), (F.substring("key", 2, 9).cast("long") % 7 == 0).alias("listed"), "key")
    assert wrong.where("`in` <> (listed and cast(substring(key, 2, 9) as long) < 21000)").count() == 0
    empty = url_filter.Cascade(listed.limit(0), universe)
    assert universe.where(empty.contains(F.col("key"))).count() == 0


def test_archives_round_trip(spark):
    big, same = "é" * 300_000, "s" * 200
    rows = [(1, "http://a/\r\nx", big), (2, None, same), (3, "u", same), (4, "u", same), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", "n" * 150), (3, "u", same), (9, "u", "WARC/1.1\r\n\r\n" * 20)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    manifest = warc.write(pages, new_folder(spark, "w"), file_bytes=1000)
    got = sorted(warc.read(manifest, batch_bytes=1000).collect(), key=lambda r: (r["page_id"] or 0, r["record_type"]))
    html = {r[0]: (r[2] or "").encode() for r in rows}
    assert len(got) == len(rows)
    for r in got:
        data = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = r["page_id"] in (3, 4)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if revisit else ("response", None))
        assert revisit or bytes(r["payload"]) == data
    assert warc.read(warc.write(pages.limit(0), new_folder(spark, "w"))).count() == 0


def test_a_damaged_archive_is_refused():
    good = warc.record(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest(), None, False)
    assert len(list(warc.records(io.BytesIO(good * 3)))) == 3
    wrong = warc.record(1, "u", b"x" * 500, hashlib.sha256(b"y").hexdigest(), None, False)
    for data in (good[:-20], good + good[:50], wrong):
        with pytest.raises((EOFError, ValueError)):
            list(warc.records(io.BytesIO(data)))
