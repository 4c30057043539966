import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rankeval.llm import encoding, packing, token_files
from rankeval.llm.encoding import encoder
from rankeval.llm.queries import op1, op5
from rankeval.llm.storage import new_folder
from tests.llm.brute import TOKENIZER, crc, token_ids

SF = "/root/testdata/sf0.001"
HARD = [
    None, "", " ", "a.b.c... d!?", "x\x02 y\x02\x02z", "'s's don't.", "<|endoftext|>.x <|startoftext|>", "e\u0301. e\u0301", "日本語。text",
    "a\x1cb\x85c\xa0d", "１２３.", "Σας ΣΑΣ.", "İ. I", "x" * 20_000, "word. " * 5_000, "word. word",
]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start int, `a.b` string")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ.,!'é1\u0301 \n\x02\x1c\xa0ﬁИ")), max_size=40), max_size=8))
def test_words_one_by_one_give_the_ids_of_the_text(texts):
    got = encoder(TOKENIZER).encode(texts, 2)
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [x.tolist() for x in token_ids(texts)]


def test_a_full_cache_gives_the_same_ids(monkeypatch):
    small = encoding.WordEncoder(TOKENIZER, words=3)
    for _ in range(3):
        got = small.encode(HARD, 2)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [x.tolist() for x in token_ids(HARD)]
    assert len(small.cache) < 40


def test_files_return_every_document(spark):
    rows = [(i if i != 3 else None, t, "x", 1, "y") for i, t in enumerate(HARD)] + [(5, HARD[5], "x", 1, "y")]
    random.Random(1).shuffle(rows)
    folder = new_folder(spark, "t")
    manifest = token_files.write(docs(spark, rows), folder, TOKENIZER, 2, file_bytes=60)
    assert manifest.count() > 2
    got = sorted(token_files.read(spark, manifest).collect(), key=lambda r: r["start"])
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want = token_ids([r[1] for r in rows])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([len(x) for x in want])[:-1]]).tolist()
    assert [bytes(r["ids"]) for r in got] == [x.tobytes() for x in want]


def test_one_document_through_the_index(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(HARD)]
    folder = new_folder(spark, "t")
    uri = token_files.write(docs(spark, rows).coalesce(1), folder, TOKENIZER, 2).orderBy("file_no").first()["file"]
    f = token_files.open_file(uri)
    for i in f.ids:
        assert f.find(int(i)).tolist() == token_ids([HARD[i]])[0].tolist()
    assert f.find(99) is None


def test_an_empty_table_gives_no_file(spark):
    manifest = token_files.write(docs(spark, []), new_folder(spark, "t"), TOKENIZER, 2)
    assert manifest.count() == 0 and token_files.read(spark, manifest).count() == 0


def test_query_1_against_the_tokenizer(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, start = {}, 0
    for r, ids in zip(rows, token_ids([r["text"] for r in rows])):
        want[r["doc_id"]] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op1(spark, SF).collect()} == want


def check_pieces(pieces, texts, capacity=4096):
    """pieces of texts by id: every id once, sequences gapless; the share of padding."""
    ids = {d: x for d, x in zip(texts, token_ids(texts.values()))}
    at = dict.fromkeys(texts, 0)
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        d = p["doc_id"]
        assert p["start"] == at[d] and p["length"] > 0 and p["doc_tokens"] == len(ids[d])
        at[d] += p["length"]
        assert p["ids_crc32"] == crc(ids[d][p["start"] : at[d]])
    assert at == {d: len(x) for d, x in ids.items()}
    sequences = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sequences.get(p["sequence_id"], 0)
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(sequences.values(), default=0) <= capacity
    padding = sum(capacity - n for n in sequences.values() if n & (n - 1))
    return padding / max(1, padding + sum(sequences.values()))


def test_query_5_packs_every_token_once(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_pieces(op5(spark, SF).collect(), texts) < 0.01


def test_packing_hard_rows(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, "x", 1, "y") for i, t in enumerate(HARD)]
    pieces = packing.pack(docs(spark, rows).repartition(3), TOKENIZER, 2, capacity=100).withColumn("ids_crc32", F.crc32("ids"))
    check_pieces(pieces.collect(), {r[0]: r[1] for r in rows}, 100)
    assert packing.pack(docs(spark, []), TOKENIZER, 2).count() == 0
    twice = packing.pack(docs(spark, [(None, "a b", "x", 1, "y")] * 2), TOKENIZER, 2).collect()
    assert [r["doc_id"] for r in twice] == [None] * len(twice) and sum(r["length"] for r in twice) == 6


@pytest.mark.parametrize("n", [1, 2, 3, 500, 4095, 4096, 5000, 40_000])
def test_a_class_takes_its_fixed_number_of_documents(n):
    packer = packing.Packer(4096, 0)
    rows = [r for i in range(300) for r in packer.add(i, np.arange(n, dtype="<u4") % 60000)]
    by = {}
    for r in rows:
        by.setdefault(r[4], []).append(r[2])
    for lengths in by.values():
        assert len({packer._class(x) for x in lengths}) == 1 and len(lengths) == packer._class(lengths[0])
    rows += packer.finish()
    assert sum(r[2] for r in rows) == 300 * n


def test_the_dictionary_sees_all_places_of_texts(spark, monkeypatch):
    """Pieces come from anywhere in whole texts, as often from behind as from the front, and no more than asked for."""
    from rankeval.llm import token_files

    taken = []

    class Recorder:
        def encode(self, texts, end_id):
            taken.extend(texts)
            return [t.encode() for t in texts]

    monkeypatch.setattr(token_files, "encoder", lambda path: Recorder())
    frame = spark.createDataFrame([(i, "".join(chr(0x4E00 + p) * 100 for p in range(40))) for i in range(30)] + [(99, None), (98, ""), (97, "short")], "doc_id long, text string")
    token_files.train_dictionary(frame, TOKENIZER, 2, samples=200, sample_chars=100)
    assert len(taken) == 200 and all(len(t) <= 100 for t in taken)
    places = [ord(t[0]) - 0x4E00 for t in taken if t[0] >= "\u4e00"]
    assert min(places) < 4 and max(places) > 35 and 14 < sum(places) / len(places) < 25
    assert token_files.train_dictionary(frame.limit(0), TOKENIZER, 2) == b""
