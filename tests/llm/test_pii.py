import hashlib
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from rankeval.llm import pii
from rankeval.llm.queries import op4

SF = "/root/testdata/sf0.001"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    """The base rules word for word."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a1207.@+-( )_é４,")), max_size=60))
def test_base_spans_follow_the_rules(text):
    assert pii.find(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("4.+ -0123")), min_size=10, max_size=80))
def test_numbers_follow_the_rules(text):
    assert pii.find(text) == plain(text)


FOUND = [
    ("write jane (at) mail (dot) example (dot) com now", "email", "jane (at) mail (dot) example (dot) com"),
    ("write jane at example dot com now", "email", "jane at example dot com"),
    ("jane dot doe [at] example.com!", "email", "jane dot doe [at] example.com"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"),  # Cyrillic а
    ("ja​ne@exam­ple.com", "email", "ja​ne@exam­ple.com"),
    ("jane＠example．com", "email", "jane＠example．com"),
    ("jane{at}example{dot}org", "email", "jane{at}example{dot}org"),
    ("ip 10 dot 20 dot 30 dot 40.", "ip", "10 dot 20 dot 30 dot 40"),
    ("one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"),
    ("ip 1O.2.3.4 is", "ip", "1O.2.3.4"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ("card ４１１１ １１１１ １１１１ １１１１ end", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("card 4lll llll llll llll", None, ""),
    ("card 41ll 1l11 1111 1111", "card", "41ll 1l11 1111 1111"),
    ("call plus one two two five five five five five zero one zero zero", "phone", "plus one two two five five five five five zero one zero zero"),
    ("call +١ (٩٨٨) ٥٥٥-٢٤٨٥", "phone", "+١ (٩٨٨) ٥٥٥-٢٤٨٥"),
    ("ruf plus vier neun null eins zwei drei vier fünf sechs an", "phone", "plus vier neun null eins zwei drei vier fünf sechs"),
]
CLEAN = [
    "Meet me at example.com at noon, the point is made.", "one two three, and four. At nine a dot.", "He sat at home dot dot dot", "Él está en casa, uno dos tres.",
    "Version 2.0 at 10 o'clock", "les deux points (a) et (.)", "look @ this", "", " ", "İ ist da · und dort",
]


@pytest.mark.parametrize(("text", "kind", "source"), FOUND)
def test_disguises_map_back(text, kind, source):
    base = pii.find(text)
    got = [(pii.KINDS[k], text[a:b]) for a, k, b in base + pii.disguised(text, base)]
    assert [g for g in got if g[0] == kind] == ([(kind, source)] if kind else [])


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == [] and pii.disguised(text, []) == []


PARTLY = [
    ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
    ("card 4111 1111 1111 111 one.", "card", "4111 1111 1111 111 one"),
    ("ip 192.168.zero.1", "ip", "192.168.zero.1"),
    ("ip 192.168.sİx.1", "ip", "192.168.sİx.1"),  # a dotted capital
]


@pytest.mark.parametrize(("text", "kind", "source"), PARTLY)
@pytest.mark.parametrize("elsewhere", ["", ", (at)", ", one two"])
def test_a_single_word_in_a_number_is_found_whatever_stands_elsewhere(text, kind, source, elsewhere):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text)] == []
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text + elsewhere, [])] == [(kind, source)]


PARTS = [*pii.DIGITS, *"0 1 4 O o I l L i".split(), *"at dot point plus PLUS arroba punkt One sİx FÜNF @ . ( [ ) ] { > _ - +".split(), " ", " ", "\n", "é", "a", "İ", "ı", "ſ", "\u0307", "\u200b", "x@y"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8).map("".join))
def test_the_pre_test_lets_every_rewrite_through(text):
    plain = text.translate(pii.characters())
    assert pii._hint(plain) or not pii.REWRITES.search(plain)
    pii.disguised(text, pii.find(text))


def test_base_spans_stay_beside_disguised_ones():
    text = "a@b.co and c (at) d (dot) org, a@b.co"
    base = pii.find(text)
    assert pii.written(sorted(base + pii.disguised(text, base))) == "email:0:6,email:11:29,email:31:37"
    assert pii.masked(text, sorted(base + pii.disguised(text, base))) == "<EMAIL> and <EMAIL>, <EMAIL>"


FRAGMENTS = [  # the base spans are parts of the identifier
    ("write jоhn.smith@example.com now", "email", "hn.smith@example.com", "jоhn.smith@example.com"),  # Cyrillic о
    ("write jo\u200bhn@example.com now", "email", "hn@example.com", "jo\u200bhn@example.com"),
    ("write john@mail.exаmple.com now", "email", "john@mail.ex", "john@mail.exаmple.com"),  # Cyrillic а
    ("call +44 20 7946 095 eight, now", "phone", "+44 20 7946 095", "+44 20 7946 095 eight"),
    ("call +44 20 7946 095８ now", "phone", "+44 20 7946 095", "+44 20 7946 095８"),
]


@pytest.mark.parametrize(("text", "kind", "part", "whole"), FRAGMENTS)
def test_an_identifier_is_found_whole_beside_its_plain_part(text, kind, part, whole):
    base = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in base] == [(kind, part)]
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, base)] == [(kind, whole)]
    assert pii.masked(text, sorted(base + pii.disguised(text, base))) == text.replace(whole, f"<{kind.upper()}>")


def test_disguised_spans_within_plain_ones_are_not_repeated():
    text = "1O.2.3.4.lll@example.com"
    assert pii.disguised(text, pii.find(text)) == [] and len(pii.find(text)) == 1


def test_many_plain_and_disguised_spans_take_linear_time():
    text = "a@b.co jаne@b.co " * 30_000  # Cyrillic а
    start = time.process_time()
    base = pii.find(text)
    assert len(pii.disguised(text, base)) == 30_000
    assert time.process_time() - start < 8


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + " " * 200_000, "(" * 200_000, "one " * 50_000, " at a" * 40_000, "( " * 90_000, "O1" * 90_000, "a-" * 90_000 + " dot a"])
def test_long_runs_take_linear_time(text):
    start = time.process_time()
    base = pii.find(text)
    pii.disguised(text, base)
    assert time.process_time() - start < 8


def test_query_against_the_rules(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) - {""} <= set(r["spans"].split(","))
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == len([s for s in r["spans"].split(",") if s])


def test_rows_of_all_kinds(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (3, "a@b.co", "y"), (3, "a@b.co", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.detect(docs).collect()
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in got if r["spans"]) == [(0, "email:0:6"), (3, "email:0:6"), (3, "email:0:6")]
    assert len(got) == 5 and pii.detect(docs.limit(0)).count() == 0
    texts = [r[0] for r in pii.mask(docs).select("text").collect()]
    assert sorted(texts, key=str) == ["", "<EMAIL>", "<EMAIL>", "<EMAIL>", None]


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\u00a0"])
def test_long_runs_of_white_space_take_linear_time(white):
    import time

    text = "zero" + white * 200_000 + "ann (at) example (dot) com" + white * 200_000 + "(dot" + white * 200_000 + "x"
    began = time.perf_counter()
    assert pii.disguised(text, []) == [(200_004, 0, 200_030)]
    assert time.perf_counter() - began < 20


def test_white_space_around_boxes_belongs_to_them():
    for text in ("ann(at)example(dot)com", "ann  (at)\texample  [ dot ]\n com", "ann \n{ @ } example < . > com"):
        assert pii.disguised(text, []) == [(0, 0, len(text))]
