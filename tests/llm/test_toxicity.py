import random
import zlib

import numpy as np
import pytest

from rankeval.llm import toxicity
from rankeval.llm.queries import QUERIES
from rankeval.llm.toxicity import EXACT, LOOKALIKE, ONE_EDIT, TWO_EDITS, Lexicon, Term

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_exact_on_letters():
    """Against the plain distance: every word within a term's edits is found, with the least distance to any term; looks only add."""
    rnd = random.Random(3)
    terms = [Term(w) for w in ("abcab", "abcabc", "bcabcabca", "cab", "aaabbbccc")] + [Term("cbacba", True)]
    lexicon = Lexicon(terms)
    for _ in range(4000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 11)))
        reach = [distance(word, t.text) for t in terms[:-1]] + [min(distance(word[:n], "cbacba") for n in range(len(word) + 1))]
        best = min((d for d, t in zip(reach, terms) if d <= t.edits), default=None)
        found = lexicon.find(word)
        if best is not None:
            assert found is not None and found[1] <= (EXACT, ONE_EDIT, TWO_EDITS)[best]
            assert found[1] != EXACT or best == 0
        elif found is not None:  # by letters that are repeated
            term = terms[found[0]]
            assert found[1] in (LOOKALIKE, ONE_EDIT, TWO_EDITS) and reach[found[0]] <= term.edits + toxicity.LOOKS
        assert lexicon.find(word) == found  # from the cache


@pytest.mark.parametrize("word, kind", [
    ("stupid", EXACT), ("st*pid", LOOKALIKE), ("stup1d", LOOKALIKE), ("stuupiid", LOOKALIKE), ("stupd", ONE_EDIT), ("stuqid", ONE_EDIT), ("stupids", ONE_EDIT),
    ("wrthles", TWO_EDITS), ("worthless", EXACT), ("lower", None), ("stud", None), ("loweichen", EXACT), ("lowe", None), ("a", None), ("", None),
])
def test_kinds_of_misspelling(word, kind):
    found = Lexicon([Term("stupid"), Term("worthless"), Term("lowei", True)]).find(word)
    assert (None if found is None else found[1]) == kind


def test_caches_may_be_full_or_forgotten():
    plain, tight = Lexicon([Term("stupid"), Term("moron")]), Lexicon([Term("stupid"), Term("moron")], kept_words=1, kept_steps=3)
    for w in ["stupid", "stupd", "morron", "maroon", "xyz", "moron", "st*pid", "idiot|moron"] * 2:
        assert plain.find(w) == tight.find(w)


def test_spans_of_whole_texts():
    text = "İ say: You are an IDIOT!! " + "x " * 5000 + 'he wrote "what an idiot" and\nleft. „So ein Idiot“'
    found, n = toxicity.hits(Lexicon([Term("idiot")]), text)
    assert [text[h.start : h.end].lower() for h in found] == ["idiot"] * 3 and n > 5000
    assert [h.around & toxicity.QUOTED for h in found] == [0, toxicity.QUOTED, toxicity.QUOTED]
    assert found[0].around & toxicity.ADDRESSED and found[1].around & toxicity.REPORTED
    assert toxicity.hits(Lexicon([Term("idiot")]), None) == ([], 0)


def corpus(rnd, n=600):
    """Toxic documents use invented insults and misspell some; clean ones quote them."""
    vocabulary = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 80))]
        toxic, quotes = i % 5 == 0, i % 5 == 1
        insult = "grobzak" if i % 2 else "grobzakken"
        if toxic:
            words[rnd.randrange(len(words))] = "you " + (insult if i % 3 else "gr0bz*k" if i % 2 else "grobbzakken")
        elif quotes:
            words[rnd.randrange(len(words))] = f'they wrote "{insult}" there'
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_quotation_is_told_from_abuse_and_misspellings_are_caught(spark):
    docs, labels = corpus(random.Random(5))
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, `t` string").repartition(3)
    rows = {r["doc_id"]: r for r in toxicity.classify(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    wrong = [i for i, y in labels if rows[i]["predicted"] != y]
    assert len(wrong) <= 6, [(docs[i], rows[i]) for i in wrong[:5]]
    assert any(rows[i]["held_out"] and rows[i]["predicted"] for i, y in labels if y)


def test_learning_leaves_held_out_labels_alone(spark):
    docs, labels = corpus(random.Random(6), 300)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    scores = [toxicity.classify(frame, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (labels, turned)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("labels", [[], [(1, None)], [(1, 1), (2, 1)], [(99, 0)], [(1, 0), (2, 1), (2, 0), (None, 1)]])
def test_odd_rows_and_few_labels(spark, labels):
    texts = [(1, "a b", 1), (2, None, 1), (2, "", 1), (2, "", 1), (None, "x" * 100_000, 1), (4, "you stupid idiot", 1), (5, "moron " * 20_000, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score int")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.classify(docs, table).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows if r["doc_id"] in (4, 5)} == {1} and {r["predicted"] for r in rows if r["doc_id"] not in (4, 5)} == {0}
    assert {r["n_hits"] for r in rows if r["doc_id"] == 5} == {20_000}
    assert toxicity.classify(docs.limit(0), table).count() == 0


def test_choice_of_terms():
    rows = [("low", True, 50.0), ("lowe", True, 60.0), ("lowei", True, 60.0), ("loweich", True, 30.0), ("idiot", False, 40.0), ("idiot", True, 40.0), ("idi", True, 20.0)]
    assert toxicity.choose(rows, 9) == [Term("lowei", True), Term("idiot", True)]
    assert toxicity.choose(rows, 1) == [Term("lowei", True)]


def test_query_13_on_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op13_toxicity"](spark, SF).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = np.array([(rows[i]["score"], rows[i]["predicted"], y) for i, y in truth.items() if i in rows and rows[i]["held_out"]])
    positive, negative = out[out[:, 2] == 1, 0], out[out[:, 2] == 0, 0]
    auc = ((positive[:, None] > negative).sum() + 0.5 * (positive[:, None] == negative).sum()) / (len(positive) * len(negative))
    assert auc > 0.8 and out[out[:, 2] == 0, 1].mean() < 0.02
