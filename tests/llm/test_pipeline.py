"""Every stage of the pipeline against a plain version over its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankeval.llm import pii
from rankeval.llm.mixing import mix
from rankeval.llm.queries import op9
from tests.llm.test_jaccard import corpus, plain_components
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_keeps_what_it_predicts(spark, documents):
    out = corpus_pipeline.classify(spark, documents, SF)
    good = {r["doc_id"] for r in op9(spark, SF).collect() if r["predicted"] == 1}
    assert rows_of(out) == rows_of(documents.where(F.col("doc_id").isin(good))) and 0 < len(good) < documents.count()
    assert out.columns == documents.columns


def test_one_of_each_group_stays(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(9))]
    docs = spark.createDataFrame([(*r, "en", None, 1) for r in rows], SCHEMA)
    name = {d: c for d, _, c in plain_components(rows)}
    want = [r for r in rows if name[r[0]] == r[0]]
    out = corpus_pipeline.deduplicate(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == sorted((d, t or "") for d, t in want)
    assert out.columns == docs.columns


def test_copies_under_one_id_and_under_none(spark):
    rows = [(1, "a b c d e f", "en", "s", 1)] * 2 + [(None, "a b c d e f", "en", "s", 1), (None, "q r", "en", "s", 1), (None, "q r", "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1)]
    out = corpus_pipeline.deduplicate(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == [(0, "q r"), (1, "a b c d e f"), (2, ""), (3, "")]


def test_personal_data_go(spark, documents):
    out = {r["doc_id"]: r for r in corpus_pipeline.mask(spark, documents, SF).collect()}
    for r in documents.collect():
        base = pii.find(r["text"])
        want = pii.masked(r["text"], sorted(base + pii.disguised(r["text"], base)))
        assert out[r["doc_id"]]["text"] == want and out[r["doc_id"]]["n_chars"] == len(want)
        assert pii.find(want) == [] and out[r["doc_id"]]["source"] == r["source"]


def test_mix_writes_each_use(spark, documents):
    docs = documents.unionByName(documents.limit(3)).unionByName(spark.createDataFrame([(None, None, "en", None, 0), (77, "", "en", "src1", 0)], SCHEMA))
    out = corpus_pipeline.mix(spark, docs, SF)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got, want = {}, {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + count(r["text"])
        assert r["n_chars"] == len(r["text"])
    for r in mix(docs)[1].collect():
        if r["taken"]:
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert got == want and out.columns == docs.columns
    whole = {r["doc_id"]: r["text"] for r in documents.collect()}
    cut = [r for r in out.collect() if r["text"] != whole[r["doc_id"]]]
    assert len(cut) <= 2 * documents.select("source").distinct().count() and all(" ".join(whole[r["doc_id"]].split()).startswith(r["text"]) for r in cut)


def test_mix_follows_the_schedule(spark, documents, tmp_path):
    corpus_pipeline.mix(spark, documents, SF).write.parquet(str(tmp_path / "mix"))
    first = {}
    for r in mix(documents)[0].collect():
        use = (r["doc_id"], r["pass_no"])
        first[use] = min(first.get(use, r["slot"]), r["slot"])
    slots = {}
    for (doc, _), slot in sorted(first.items(), key=lambda x: x[1]):
        slots.setdefault(doc, []).append(slot)
    got = [slots[r["doc_id"]].pop(0) for f in sorted((tmp_path / "mix").glob("part-*")) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert got == sorted(got) and len(got) == len(first)


def test_pack_takes_the_texts_as_they_are(spark, documents):
    pieces = corpus_pipeline.pack(spark, documents, SF).withColumn("ids_crc32", F.crc32("ids"))
    check_pieces(pieces.collect(), {r["doc_id"]: r["text"] for r in documents.collect()})


def test_stages_in_a_row(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "personal data", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, documents, stage):
    assert stage(spark, documents.limit(0), SF).count() == 0


CLASHING = ["row", "n", "size", "pass_no", "slot", "use_id", "use_text", "use_n", "u_id", "set_n", "SET_H1", "kept_id", "kept_n", "k_set", "h1", "node", "score", "y", "t.x", "__text"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]], ids=[n for n, _ in corpus_pipeline.STAGES[:4]])
def test_clashing_names_and_other_types_pass_through(spark, documents, stage):
    """Extra columns keep their values, whatever they are called."""
    extra = documents.limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    extra = extra.withColumn("nested", F.struct(F.array("doc_id").alias("a"), F.lit(None).cast("date").alias("d")))
    out = stage(spark, extra, SF)
    assert out.columns == extra.columns
    plain = stage(spark, documents.limit(60), SF)
    assert rows_of(out.select(*documents.columns)) == rows_of(plain)
    for r in out.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASHING) and r["nested"]["a"] == [r["doc_id"]]


def test_stages_in_a_row_against_plain_versions(spark):
    """The whole pipeline against a plain version of each stage, one after the other."""
    from rankeval.llm.queries import END_ID, table
    from tests.llm.brute import token_ids

    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    good = {r["doc_id"] for r in op9(spark, SF).collect() if r["predicted"] == 1}
    rows = [(i, docs[i]["text"]) for i in sorted(good)]
    first = {d for d, _, c in plain_components(rows) if d == c}
    texts = {}
    for i in first:
        text = docs[i]["text"] or ""
        base = pii.find(text)
        texts[i] = pii.masked(text, sorted(base + pii.disguised(text, base)))
    masked = spark.createDataFrame([(i, t, docs[i]["lang"], docs[i]["source"], len(t)) for i, t in texts.items()], SCHEMA)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = {}
    for r in mix(masked)[0].groupBy("doc_id", "pass_no").agg(F.sum("length").alias("n")).collect():  # the schedule, itself held against SQL
        words = word.findall(texts[r["doc_id"]])
        text = texts[r["doc_id"]] if r["n"] == len(words) else " ".join(words[: r["n"]])
        tokens.setdefault(r["doc_id"], []).append(len(token_ids([text], END_ID)[0]))
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {i: sum(n) for i, n in tokens.items()}
