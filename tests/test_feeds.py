import json
import re

import pytest
from pyspark.sql import functions as F

from rankeval.functions import context as ctx, loose, requests, scores, text
from rankeval.operators import flatten, prompts, quality, scoring


def one(spark, value, fn, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value", [None, "", "bad", '{"a":1}', "[]", "3", "[1,2]"])
def test_json_array_of_anything_else_is_empty(spark, value):
    assert one(spark, value, lambda c: loose.json_array(c, {"a": "string"})) == []


def test_json_array_skips_only_bad_elements(spark):
    got = one(spark, '[{"a":"x"},5,null,"t",{"a":7,"b":[1]},{}]', lambda c: loose.json_array(c, {"a": "string"}))
    assert [r["a"] for r in got] == ["x", "7", None]


@pytest.mark.parametrize(
    "value,truth,strict,number,integer",
    [
        ("true", True, True, 1.0, 1), ("false", False, False, 0.0, 0), ("1", True, True, 1.0, 1), ("0", False, False, 0.0, 0),
        ('"false"', True, False, None, None), ('""', False, False, None, None), ("null", False, False, None, None),
        ("3.9", True, False, 3.9, 3), ('"3"', True, False, 3.0, 3), ('"3.5"', True, False, 3.5, None), ('" 4 "', True, False, 4.0, 4),
        ('"1_000"', True, False, 1000.0, 1000), ('"1d"', True, False, None, None), ('"abc"', True, False, None, None),
        ("[]", False, False, None, None), ("[0]", True, False, None, None), ("{}", False, False, None, None), ('"1e3"', True, False, 1000.0, None),
    ],
)
def test_loose_values(spark, value, truth, strict, number, integer):
    v = F.get(F.try_variant_get(F.try_parse_json("v"), "$", "array<variant>"), F.lit(0))
    row = spark.createDataFrame([(f"[{value}]",)], "v string").select(
        loose.truthy(v).alias("t"), loose.truthy(v, strict=True).alias("s"), loose.loose_number(v).alias("n"), loose.loose_int(v).alias("i")
    ).first()
    assert (row["t"], row["s"], row["n"], row["i"]) == (truth, strict, number, integer)


def test_numeric_features(spark):
    bag = '{"q":0.5,"w":"1.5","b":true,"n":null,"t":"x","l":[1],"contentId":3,"SpanId":"4","ParentId":5,"neg":"-2"}'
    assert one(spark, bag, loose.numeric_features) == {"q": 0.5, "w": 1.5, "b": 1.0, "neg": -2.0}
    assert one(spark, "{", loose.numeric_features) == {} and one(spark, None, loose.numeric_features) == {}


def test_text_helpers(spark):
    assert one(spark, " \t a b  \n", text.strip) == "a b"
    assert one(spark, "x" * 220, lambda c: text.ellipsize(c, 220)) == "x" * 220
    assert one(spark, "é" * 221, lambda c: text.ellipsize(c, 220)) == "é" * 219 + "…"
    assert one(spark, "2024-01-02T03:04:05.6Z", text.trim_ts) == "2024-01-02 03:04" and one(spark, None, text.trim_ts) == ""
    assert one(spark, "a\n   b\n\tc", lambda c: text.hang(c, "__")) == "a\n__b\n__c"


@pytest.mark.parametrize(
    "value,want", [("2.5", 0.5), ("10", 1.0), ("1.5", None), ("`0.37`", 0.37), ("p is .25", 0.25), ("none", None), ("", None), (None, None), ("1.000", 1.0)]
)
def test_number_scores(spark, value, want):
    assert one(spark, value, scores.parse_number_score) == want


def test_yes_no_and_probabilities(spark):
    for t, want in [(" Yes.", 1.0), ("not sure", 0.0), ("nothing", 0.0), ("maybe", 0.5), (None, 0.5), ("\nNO", 0.0)]:
        assert one(spark, t, scores.parse_yes_no) == want
    row = spark.range(1).select(
        scores.two_class_prob(F.lit(1000.0), F.lit(999.0)).alias("p"), scores.three_class(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("t")
    ).first()
    assert row["p"] == pytest.approx(0.7310585786) and row["t"]["prob"] == pytest.approx(0.5) and row["t"]["pred"] == 1


def interests_json(*items):
    return json.dumps(list(items))


def test_interest_text(spark):
    full = {"name": " Trains ", "domain": "travel", "classification": "topic", "status": "", "intent": "learn", "strength": 0.285,
            "sources": ["a", "b"], "keywords": ["k1", "k2"], "rationale": " line\none "}
    got = one(spark, interests_json(full), lambda c: ctx.interests(loose.json_array(c, ctx.INTEREST)))
    # 0.285 is stored just below the tie, so two decimals give 0.28
    assert got == ["Trains  [domain=travel; classification=topic; intent=learn; strength=0.28; sources=a,b]\n    keywords: k1, k2\n    why: line one"]
    bare = one(spark, interests_json(full), lambda c: ctx.interests(loose.json_array(c, ctx.INTEREST), False, False))
    assert bare == ["Trains  [domain=travel; classification=topic; intent=learn; strength=0.28]"]
    why = one(spark, interests_json({"name": "n", "rationale": "r" * 401}), lambda c: ctx.interests(loose.json_array(c, ctx.INTEREST)))
    assert why == ["n\n    why: " + "r" * 399 + "…"]


def test_interest_order_is_stable_and_named(spark):
    items = [{"name": "a", "strength": 0.5}, {"name": "  "}, {"name": "b"}, {"name": "c", "strength": 0.9}, {"name": "d", "strength": 0.5}, {"name": "e", "strength": 0}]
    got = one(spark, interests_json(*items), lambda c: F.transform(ctx.named_interests(loose.json_array(c, ctx.INTEREST)), lambda i: i["name"]))
    assert got == ["c", "a", "d", "b", "e"]


def events(*rows):
    return json.dumps([{k: v for k, v in zip(("event_time", "cardTitle", "title", "clickScenario"), r) if v is not None} for r in rows])


def test_shown_clicked_and_reactions(spark):
    e = events(("2", "old", None, "navigate"), ("3", "", "fallback", "view"), ("3", "same", None, "navigate"), (None, "undated", None, None),
               ("1", " same ", None, "navigate"), ("9", "  ", "hidden", "thumbsUp"), ("4", None, "only title", "navigate"), ("0", "old", None, "thumbsUp"))
    arr = lambda c: loose.json_array(c, ctx.EVENT)
    # a blank card title hides the other title; only an absent or empty one falls back
    assert one(spark, e, lambda c: ctx.shown_titles(arr(c))) == ["only title", "fallback", "same", "old", "undated"]
    assert one(spark, e, lambda c: ctx.shown_titles(arr(c), 2)) == ["only title", "fallback"]
    assert one(spark, e, lambda c: ctx.shown_titles(arr(c), 0)) == []
    assert one(spark, e, lambda c: ctx.clicked_titles(arr(c))) == ["same", "old"]
    twice = events(("1", "u", None, "thumbsUp"), ("2", "d", None, "thumbsDown"), ("3", "u", None, "thumbsUp"))
    assert one(spark, twice, lambda c: ctx.reaction_titles(arr(c), "thumbsUp")) == ["u", "u"]


def test_conversation_groups(spark):
    m = [
        {"conversation_id": "g1", "createdAt": "2024-01-02", "author": "human", "text": " hi\nthere "},
        {"conversation_id": "g1", "createdAt": "2024-01-01", "author": "bot", "text": "  "},
        {"message_id": "solo", "createdAt": "2024-01-05", "text": "x" * 221},
        {"createdAt": "2024-01-05", "author": "human", "text": "no ids"},
        {"conversation_id": "blank", "createdAt": "2024-01-09", "text": ""},
        {"conversation_id": "g1", "createdAt": "2024-01-03", "author": "human", "text": "last"},
        "noise",
    ]
    got = one(spark, json.dumps(m), lambda c: ctx.group_conversations(loose.json_array(c, ctx.MESSAGE)))
    plain = [(g["id"], g["started_at"], [(x["author"], x["text"]) for x in g["messages"]]) for g in got]
    assert plain == [
        ("solo", "2024-01-05", [("?", "x" * 219 + "…")]),
        ("", "2024-01-05", [("human", "no ids")]),
        ("g1", "2024-01-01", [("human", "hi there"), ("human", "last")]),
    ]
    capped = one(spark, json.dumps(m), lambda c: ctx.group_conversations(loose.json_array(c, ctx.MESSAGE), 3, 1))
    assert [x["text"] for x in capped[2]["messages"]] == ["last"]
    assert one(spark, None, lambda c: ctx.group_conversations(loose.json_array(c, ctx.MESSAGE))) == []
    # the cut to k comes before blanks are removed, and ties keep their input order
    assert one(spark, json.dumps(m), lambda c: ctx.recent_turns(loose.json_array(c, ctx.MESSAGE), 2)) == ["no ids", "last"]


def card(i, section, pos=0, clicked=False, features=None, **kw):
    return {"itemid": i, "title": f"t{i}", "sectionIndex": section, "cardIndex": pos, "is_clicked": clicked, "features": features, **kw}


FEEDS = [
    # section order, loose indices, junk elements
    ("f1", "u1", "20240101", "a,tag-x", json.dumps([card("late", "2", 0, True, {"q": 1}), card("hidden", None), card("empty", ""), 7, card("first", 0, "1", "false", {"q": "x"}),
     card("zero", "x", 5, 0, "none"), card("tie", 0, 1, "", {})])),
    ("f2", "u2", " ", None, json.dumps([card("b", 1)])),
    ("f3", "u3", "20240105", "tag-y", json.dumps([card("c", None)])),
    ("f4", "u4", "20240109", "tag-x", json.dumps(card("d", 1))),
    ("f5", None, "20240102", "TAG-X", json.dumps([card("e", 1, None, 1, {"q": True})])),
]


def feeds(spark, interests=json.dumps([{"name": "n"}])):
    df = spark.createDataFrame(FEEDS, "feed_id string, user_id string, bizdate string, flight_ids string, candidate_cards string")
    return df.withColumn("interests", F.lit(interests))


def items(df):
    return [(r["feed_id"], r["itemid"], r["label"]) for r in df.select("feed_id", "candidate.itemid", "label").collect()]


def test_flatten(spark):
    got = items(flatten.flatten_impressions(feeds(spark)).coalesce(1))
    assert got == [("f1", "zero", 0), ("f1", "first", 1), ("f1", "tie", 0), ("f1", "late", 1), ("f2", "b", 0), ("f5", "e", 1)]
    assert items(flatten.flatten_impressions(feeds(spark), tag="tag-x", require_features=True)) == [("f1", "first", 1), ("f1", "tie", 0), ("f1", "late", 1)]
    # a blank date passes the range filter
    assert {f for f, _, _ in items(flatten.flatten_impressions(feeds(spark), lo="20240102", hi="20240104"))} == {"f2", "f5"}
    assert items(flatten.flatten_impressions(feeds(spark, "[]"))) == []
    assert len(items(flatten.flatten_impressions(feeds(spark, None), require_interests=False))) == 6
    assert {f for f, _, _ in items(flatten.flatten_impressions(feeds(spark), max_feeds=2))} == {"f1", "f2"}
    assert flatten.feed_records(feeds(spark, "[]")).count() == 3


def test_flatten_needs_no_shuffle(spark):
    plan = flatten.flatten_impressions(feeds(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_native_arrays_are_accepted(spark):
    df = feeds(spark).where("feed_id = 'f2'").withColumn("interests", F.array(F.struct(F.lit("native").alias("name"), F.lit(0.5).alias("strength"))))
    r = flatten.flatten_impressions(df).first()
    assert r["interests"]["positive"] == ["native  [strength=0.50]"] and r["user_id"] == "u2" and r["bizdate"] == ""


def test_date_split_and_filters(spark):
    days = spark.createDataFrame([("20240101",), ("20240103",), ("20240105",), ("",), (None,)], "bizdate string")
    assert [(r["bizdate"], r["split"]) for r in flatten.date_split(days, "20240101", "20240105").collect()] == [("20240101", "train"), ("20240105", "eval")]
    d = F.col("bizdate")
    assert days.where(flatten.date_between(d, "20240102", "20240104")).count() == 3
    assert days.where(flatten.date_between(d, "20240102", "20240104", keep_blank=False)).count() == 1


def test_feature_policies(spark):
    bags = ['{"q":1,"w":"2.5"}', '{"q":"abc"}', '{"q":""}', '{"q":null}', "{}", None, '{"q":true}', '{"q":0}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, b string").withColumn(
        "f", F.try_variant_get(F.try_parse_json("b"), "$", "map<string,variant>")
    )
    run = lambda p: {r["i"]: (r["q"], r["w"]) for r in flatten.feature_columns(df, "f", ["q", "w"], p).collect()}
    assert run("strict") == {0: (1.0, 2.5), 3: (0.0, 0.0), 4: (0.0, 0.0), 6: (1.0, 0.0), 7: (0.0, 0.0)}
    assert run("falsy") == {0: (1.0, 2.5), 2: (0.0, 0.0), 3: (0.0, 0.0), 6: (1.0, 0.0), 7: (0.0, 0.0)}
    assert len(run("coalesce")) == 8 and run("coalesce")[1] == (0.0, 0.0)


def samples(spark, titles=12, groups=4):
    row = (
        "s1", [(f"shown card {i}", "") for i in range(titles)],
        (["interest one\n    why: because", "interest two"], ["never this"],
         [(f"g{g}", f"2024-01-0{9 - g}T10:00:00Z", [("human", f"question {g} about things"), ("bot", "an answer")]) for g in range(groups)],
         (["c1 title", "c2 title", "c3 title"], ["u1 title"], ["d1 title", "d2 title"])),
        ("i1", "candidate title", "candidate summary"),
    )
    schema = """id string, history array<struct<title:string,summary:string>>, interests struct<positive:array<string>,negative:array<string>,
        conversations:array<struct<id:string,started_at:string,messages:array<struct<author:string,text:string>>>>,
        interactions:struct<clicks:array<string>,thumbsUp:array<string>,thumbsDown:array<string>>>, candidate struct<itemid:string,title:string,summary:string>"""
    return spark.createDataFrame([row], schema)


def words(t):
    return len(t.split())


def test_budget_steps(spark):
    """Against trying every allowed shortening by hand."""
    full = samples(spark)
    render = lambda df: df.select(prompts.full_prompt(F.col("history"), F.col("interests"), F.col("candidate")).alias("p")).first()["p"]
    versions = [(h, g, render(samples(spark, h, g))) for h, g in [(12, 4), (6, 4), (3, 4), (1, 4), (0, 4), (0, 3), (0, 2), (0, 1), (0, 0)]]
    sums = lambda c: text.word_count(c)  # noqa: E731  (not marked additive: the rendering search)
    for at, slack in [(0, 0), (1, 0), (3, 0), (5, -1), (8, 0), (8, -1)]:
        limit = words(versions[at][2]) + slack
        want = next(((h, g, p, True) for h, g, p in versions if words(p) <= limit), (*versions[-1], False))
        old = prompts.body_budget
        prompts.body_budget = lambda max_len, limit=limit: limit
        try:
            for counter in (text.word_count, sums):
                r = prompts.budgeted_prompt(full, 0, counter, fast=False).first()
                assert r["prompt"] == want[2]
                assert r["truncated"] == (want[0] < 12 or not want[3])
                assert (r["dropped_history"], r["dropped_conversations"]) == ((12 - want[0], 4 - want[1]) if want[3] else (12, 4))
            r = prompts.budgeted_prompt_with(full, 0, words).first()
            if len(versions[0][2]) > int(2.5 * limit):
                assert r["prompt"] == want[2] and r["dropped_history"] == (12 - want[0] if want[3] else 12)
        finally:
            prompts.body_budget = old


def test_shrink_order(spark):
    r = prompts.shrink_prompt(samples(spark), 1000, 10_000).first()
    assert not any(r["drops"]) and r["tokens"] == words(r["prompt"])
    seen = []
    for gone in (1, 12, 40, 60, 75, 80, 90):
        limit = r["tokens"] - gone
        s = prompts.shrink_prompt(samples(spark), 1000, limit).first()
        assert s["tokens"] <= limit
        d = s["drops"]
        seen.append((d["conversations"], d["clicks"], d["thumbsDown"], d["thumbsUp"], d["hard_truncated_tokens"] > 0))
        assert s["tokens"] == words(s["prompt"])
    order = list(dict.fromkeys(seen))
    # conversations from the tail, then clicks, thumbs-down, thumbs-up in turn, then the tail of the text
    path = [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (4, 1, 0, 0), (4, 1, 1, 0), (4, 1, 1, 1), (4, 2, 1, 1), (4, 2, 2, 1), (4, 3, 2, 1)]
    places = [path.index(o[:4]) for o in order]
    assert places == sorted(places) and len(places) >= 4
    assert prompts.shrink_prompt(samples(spark), 1000, 30).first()["drops"]["hard_truncated_tokens"] > 0


def test_greedy_sections(spark):
    df = samples(spark)
    shown = F.transform("history", lambda h: h["title"])
    run = lambda n: df.select(prompts.greedy_prompt(F.col("interests"), shown, F.col("candidate"), n).alias("p")).first()["p"]
    whole = df.select(prompts.compact_prompt(F.col("interests"), shown, F.col("candidate")).alias("p")).first()["p"]
    assert sorted(run(10_000).split("\n\n")) == sorted(whole.split("\n\n"))
    fixed = words(run(0))
    assert "USER_INTERESTS" not in run(0) and run(0).endswith(prompts.SHORT_QUESTION)
    # room for the head of the interests and one entry only, and nothing after the cut section
    some = run(fixed + 7)
    assert "  - interest one" in some and "interest two" not in some and "USER_INTERACTIONS" not in some
    for n in (fixed, fixed + 30, fixed + 60):
        assert words(run(n)) <= n


def test_parity_report(spark):
    r = spark.createDataFrame([("a\nb\nc", "a\nx")], "a string, b string").select(prompts.prompt_parity(F.col("a"), F.col("b"), ["x"]).alias("r")).first()["r"]
    assert (r["lines_a"], r["lines_b"], r["differing_lines"]) == (3, 2, 2)
    assert [(d["line"], d["a"], d["b"]) for d in r["first_differences"]] == [(1, "b", "x"), (2, "c", "(end)")]
    assert (r["markers"][0]["in_a"], r["markers"][0]["in_b"]) == (False, True)


def test_requests(spark):
    rich = {"interests": {"positive": ["txt", {"name": "obj", "strength": 0.5}, {"name": " "}, ""], "negative": [], "interactions": {"clicks": ["c"]},
            "conversations": [{"started_at": "1", "messages": [{"author": "human", "text": "q"}]}]}, "history": [{"title": "h"}, {"summary": "x"}, 4], "candidates": [{"id": 1, "title": "t"}],
            "interactions": {"thumbsUp": ["root"]}}
    df = spark.createDataFrame([(json.dumps(rich),), ('{"title":"flat"}',)], "request string")
    a, b = requests.normalize_request(df).collect()
    assert a["interests"]["positive"] == ["txt", "obj  [strength=0.50]"] and a["interests"]["interactions"]["thumbsUp"] == ["root"]
    assert a["interests"]["interactions"]["clicks"] == [] and [h["title"] for h in a["history"]] == ["h"] and a["candidates"][0]["id"] == "1"
    assert a["interests"]["conversations"][0]["messages"][0]["text"] == "q"
    assert b["history"] == [] and b["candidates"][0]["title"] == "flat" and b["interests"]["positive"] == []
    chats = [
        {"messages": [{"role": "user", "content": "old"}, {"role": "user", "content": [{"type": "text", "text": "{"}, {"type": "image"}, {"type": "text", "text": "}"}]}, {"role": "assistant", "content": "a"}]},
        {"messages": [{"role": "assistant", "content": "only"}]},
        {"messages": [{"role": "user", "content": " "}]},
    ]
    assert [one(spark, json.dumps(c), requests.unwrap_chat) for c in chats] == ["{}", "only", None]
    assert one(spark, "junk", requests.unwrap_response) == ""
    assert one(spark, '{"scores":[]}', requests.response_fields)["score"] is None


def test_remote_scorer_retries(spark):
    def client(t):
        if t == "down":
            raise OSError("gone")
        return {"score": 0.9, "version": t}

    df = spark.createDataFrame([("v2",), ("v1",), ("down",)], "prompt string")
    got = {r["prompt"]: r for r in scoring.call_scorer(df, client, retries=3, backoff_s=0.0, accept=lambda r: r["version"] == "v2").collect()}
    assert (got["v2"]["score"], got["v2"]["attempts"], got["v2"]["failed"]) == (0.9, 1, False)
    assert (got["v1"]["score"], got["v1"]["attempts"], got["v1"]["failed"]) == (0.5, 3, True)
    assert got["down"]["error"] == "gone" and got["down"]["failed"]


def test_fixture_pair_falls_back(spark):
    rows = [("u1", "a", 1), ("u2", "b", 0), ("u2", "c", 0), ("u3", "d", 0), ("u3", "e", 1), ("u3", "f", 1)]
    df = spark.createDataFrame(rows, "user_id string, k string, label int")
    pick = lambda d, **kw: sorted(r["k"] for r in quality.pick_fixture_pair(d, F.lit(True), ["k"], **kw).collect())
    assert pick(df) == ["d", "e"]
    assert pick(df.where("user_id <> 'u3'")) == ["b", "c"]
    assert pick(df.where("user_id = 'u1'")) == []
    both = df.union(spark.createDataFrame([("u0", "y", 0), ("u0", "z", 1)], df.schema))
    assert pick(both, pinned_user="u0") == ["y", "z"]


def test_parity_splits_each_text_once(spark):
    df = spark.createDataFrame([("a\nb", None), (None, None), ("", "")], "a string, b string").select(prompts.prompt_parity(F.col("a"), F.col("b"), ["x"]).alias("r"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 2
    rows = [r["r"] for r in df.collect()]
    assert [r["differing_lines"] for r in rows] == [2, None, 0] and [r["lines_b"] for r in rows] == [None, None, 1]


@pytest.mark.parametrize("wrap", [("", ""), ("Pre", "post")])
def test_shrinking_by_sums_is_shrinking_by_rendering(spark, wrap):
    df = samples(spark)
    by_rendering = lambda c: text.word_count(c)
    top = prompts.shrink_prompt(df, 1000, 10_000).first()["tokens"]
    for max_len, limit in [(1000, top - 40), (1000, top - 80), (376, 200), (376, 30)]:
        got = prompts.shrink_prompt(df, max_len, limit, wrap=wrap)
        plan = got._jdf.queryExecution().analyzed().toString()
        want = prompts.shrink_prompt(df, max_len, limit, by_rendering, wrap=wrap)
        assert got.select("prompt", "tokens", "drops").collect() == want.select("prompt", "tokens", "drops").collect()
        # no text is put together inside the search
        assert plan.count("aggregate(") < want._jdf.queryExecution().analyzed().toString().count("aggregate(")


def test_the_kept_end_is_found_without_counting_the_whole(spark):
    long = "".join(chr(0x1F600 + i % 5) + ("\n" if i % 41 == 40 else " \t"[i % 2] if i % 3 == 0 else "x") for i in range(3000))
    df = samples(spark).withColumn("candidate", F.col("candidate").withField("title", F.lit(long)))
    for limit in (0, 1, 7, 200, 999):
        r = prompts.shrink_prompt(df, 400, limit, wrap=("Pre ", " post")).first()
        whole = prompts.shrink_prompt(df, 400, r["tokens"] + r["drops"]["hard_truncated_tokens"], wrap=("Pre ", " post")).first()
        assert whole["drops"]["hard_truncated_tokens"] == 0 and whole["tokens"] == words(whole["prompt"])
        end = whole["prompt"][len(whole["prompt"]) - len(r["prompt"]):]
        assert r["prompt"] == end and r["tokens"] == words(end) <= limit
        assert words(whole["prompt"][len(whole["prompt"]) - len(end) - 1:]) > limit
    plan = prompts.shrink_prompt(df, 400, 30)._jdf.queryExecution().optimizedPlan().toString()
    # interests are put together once to be counted and once for the text, and the whole text is never counted
    assert plan.count("USER_INTERESTS (positive, ranked by strength):") == 2
    assert not re.search(r"regexp_extract_all\(_r#\d+\.text", plan)


def test_a_filter_on_a_budgeted_prompt_does_not_search_twice(spark):
    out = prompts.budgeted_prompt(samples(spark), 400)
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")
    assert searches(out.where("not truncated")) <= searches(out)


def test_ledger_reads_its_rows_once(spark):
    out = prompts.budgeted_prompt_with(samples(spark), 400, words, renders="renders")
    assert "Union" not in out._jdf.queryExecution().analyzed().toString()
    short = prompts.budgeted_prompt_with(samples(spark), 1_000_000, words, renders="renders").first()
    assert (short["truncated"], short["dropped_history"], short["dropped_conversations"], short["renders"]) == (False, 0, 0, 0)
