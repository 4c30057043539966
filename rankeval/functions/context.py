"""User context out of nested event, interest and message arrays.

Every function maps one array column of a feed row to another column; nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rankeval.functions.text import ellipsize, first_text, let, one_line, strip, text_or_empty, trim_ts  # noqa: F401

INTEREST = {
    "name": "string", "domain": "string", "classification": "string", "status": "string", "intent": "string",
    "strength": "double", "sources": "array<string>", "keywords": "array<string>", "rationale": "string",
}
EVENT = {"event_time": "string", "cardTitle": "string", "title": "string", "clickScenario": "string"}
MESSAGE = {
    "conversation_id": "string", "message_id": "string", "createdAt": "string", "author": "string", "text": "string",
}

_NO_TEXTS = "cast(array() as array<string>)"


def two_decimals(c: Column) -> Column:
    """``%.2f`` of the stored binary value, as printf does.

    ``c * 100`` rounds; what it lost comes from the product of split halves and decides where the product itself lies
    half-way, and only a true half-way value goes to the even neighbour.
    """
    def parts(x: Column) -> Column:
        high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of the digits
        lost = high * 100 - x * 100 + (x - high) * 100
        return F.struct((x * 100).alias("p"), lost.alias("e"))

    def rounded(v: Column) -> Column:
        p, e = v.getField("p"), v.getField("e")
        low = F.floor(p).cast("double")
        tie = p - low == 0.5
        return F.when(tie & (e > 0), low + 1).when(tie & (e < 0), low).otherwise(F.rint(p)) / 100

    return F.format_string("%.2f", let(parts(c.cast("double")), rounded))


def format_interest(it: Column, keywords: bool = True, sources: bool = True) -> Column:
    """header line ``name  [domain=...; ...]``, then optional keyword and reason lines."""

    def field(key: str) -> Column:
        return F.when(text_or_empty(it.getField(key)) != "", F.concat(F.lit(f"{key}="), it.getField(key)))

    def listed(name: str, sep: str) -> Column:
        return F.when(F.size(F.coalesce(it.getField(name), F.expr(_NO_TEXTS))) > 0, F.array_join(it.getField(name), sep))

    meta = [field(k) for k in ("domain", "classification", "status", "intent")]
    strength = it.getField("strength")
    meta.append(F.when(strength.isNotNull(), F.concat(F.lit("strength="), two_decimals(strength))))
    if sources:
        meta.append(F.concat(F.lit("sources="), listed("sources", ",")))
    head = F.concat(
        strip(text_or_empty(it.getField("name"))),
        let(F.concat_ws("; ", *meta), lambda m: F.when(m != "", F.concat(F.lit("  ["), m, F.lit("]"))).otherwise("")),
    )
    lines = [head]
    if keywords:
        lines.append(F.concat(F.lit("    keywords: "), listed("keywords", ", ")))
        why = one_line(strip(text_or_empty(it.getField("rationale"))))
        lines.append(let(why, lambda w: F.when(w != "", F.concat(F.lit("    why: "), ellipsize(w, 400)))))
    return F.concat_ws("\n", *lines)


def by_strength(c: Column) -> Column:
    """O2: strongest first, null strength counts 0, ties in input order."""
    some = F.coalesce(c, F.expr("cast(array() as array<struct<" + ",".join(f"{k}:{t}" for k, t in INTEREST.items()) + ">>)"))
    keyed = F.transform(
        some, lambda it, i: F.struct((-F.coalesce(it.getField("strength"), F.lit(0.0))).alias("k"), i.alias("i"), it.alias("v"))
    )
    return F.transform(F.sort_array(keyed), lambda x: x.getField("v"))


def has_name(it: Column) -> Column:
    return strip(text_or_empty(it.getField("name"))) != ""


def named_interests(c: Column) -> Column:
    """Entries with a name, strongest first."""
    return F.filter(by_strength(c), has_name)


def ranked_interest_texts(c: Column) -> Column:
    """F15 for R3: every entry strongest first, formatted without sources; "" for an entry without a name."""
    return F.transform(by_strength(c), lambda it: F.when(has_name(it), format_interest(it, True, False)).otherwise(""))


def interests(c: Column, keywords: bool = True, sources: bool = True) -> Column:
    """Formatted interest texts."""
    return F.transform(named_interests(c), lambda it: format_interest(it, keywords, sources))


def cap_interests(positive: Column, negative: Column, k: int) -> tuple[Column, Column]:
    """O3: the first k positives and max(2, k // 2) negatives; 0 keeps all."""
    if k <= 0:
        return positive, negative
    return F.slice(positive, 1, k), F.slice(negative, 1, max(2, k // 2))


def newest_first(events: Column, time_field: str) -> Column:
    """Stable descending sort by a text timestamp (null counts as "")."""
    keyed = F.transform(
        events,
        lambda e, i: F.struct(text_or_empty(e.getField(time_field)).alias("k"), (-i).alias("i"), e.alias("v")),
    )
    return F.transform(F.reverse(F.sort_array(keyed)), lambda x: x.getField("v"))


def _distinct_titles(titles: Column) -> Column:
    return F.array_distinct(F.filter(titles, lambda t: t != ""))


def shown_titles(c: Column, k: int = 30) -> Column:
    """Distinct non-blank titles (``cardTitle``, else ``title``), newest first; k = 0 gives none."""
    if k == 0:
        return F.expr(_NO_TEXTS)
    titles = F.transform(
        newest_first(c, "event_time"), lambda e: strip(first_text(e.getField("cardTitle"), e.getField("title")))
    )
    return F.slice(_distinct_titles(titles), 1, k)


def clicked_titles(c: Column) -> Column:
    """Distinct ``cardTitle`` of the entries with scenario "navigate", newest first."""
    clicks = F.filter(c, lambda e: F.coalesce(e.getField("clickScenario") == "navigate", F.lit(False)))
    return _distinct_titles(
        F.transform(newest_first(clicks, "event_time"), lambda e: strip(text_or_empty(e.getField("cardTitle"))))
    )


def reaction_titles(c: Column, kind: str) -> Column:
    """T4: titles of the entries with the given scenario, input order, repeats kept."""
    mine = F.filter(c, lambda e: F.coalesce(e.getField("clickScenario") == kind, F.lit(False)))
    return F.filter(
        F.transform(mine, lambda e: strip(text_or_empty(e.getField("cardTitle")))), lambda t: t != ""
    )


def group_conversations(c: Column, max_groups: int = 0, max_msgs: int = 0, max_chars: int = 220) -> Column:
    """Messages grouped by conversation (else message id, else ""), newest group first.

    A group starts at its first message by time even if that one is blank; blank messages and then empty groups
    are dropped; caps of 0 keep all, a message cap keeps the last ones.  The messages are sorted once by group
    and time and cut at the group borders, so the cost stays n log n for any number of groups.
    """
    keyed = F.transform(
        c,
        lambda m, i: F.struct(
            first_text(m.getField("conversation_id"), m.getField("message_id")).alias("id"),
            text_or_empty(m.getField("createdAt")).alias("at"),
            i.alias("i"),
            first_text(m.getField("author"), F.lit("?")).alias("author"),
            ellipsize(one_line(strip(text_or_empty(m.getField("text")))), max_chars).alias("text"),
        ),
    )

    def cut(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(1), n),
            lambda p: (p == 1) | (F.get(s, p - 1).getField("id") != F.get(s, p - 2).getField("id")),
        )
        return let(
            starts,
            lambda st: F.transform(st, lambda p, j: F.slice(s, p, F.coalesce(F.get(st, j + 1), n + 1) - p)),
        )

    groups = let(F.sort_array(keyed), lambda s: F.when(F.size(s) > 0, cut(s)))
    shaped = F.transform(
        groups,
        lambda g: F.struct(
            F.get(g, F.lit(0)).getField("at").alias("started_at"),
            (-F.array_min(F.transform(g, lambda m: m.getField("i")))).alias("i"),
            F.get(g, F.lit(0)).getField("id").alias("id"),
            F.transform(
                F.filter(g, lambda m: m.getField("text") != ""),
                lambda m: F.struct(m.getField("author").alias("author"), m.getField("text").alias("text")),
            ).alias("messages"),
        ),
    )
    ordered = F.reverse(F.sort_array(F.filter(shaped, lambda g: F.size(g.getField("messages")) > 0)))
    if max_groups > 0:
        ordered = F.slice(ordered, 1, max_groups)

    def last(msgs: Column) -> Column:
        if max_msgs <= 0:
            return msgs
        return F.slice(msgs, -F.least(F.size(msgs), F.lit(max_msgs)), F.lit(max_msgs))

    out = F.transform(
        ordered,
        lambda g: F.struct(
            g.getField("id").alias("id"),
            g.getField("started_at").alias("started_at"),
            last(g.getField("messages")).alias("messages"),
        ),
    )
    empty = F.expr("cast(array() as array<struct<id:string,started_at:string,messages:array<struct<author:string,text:string>>>>)")
    return F.coalesce(out, empty)


def recent_turns(c: Column, k: int, max_chars: int = 200) -> Column:
    """The k newest messages by "human", blanks removed after the cut."""
    mine = F.filter(c, lambda m: F.coalesce(m.getField("author") == "human", F.lit(False)))
    texts = F.transform(
        F.slice(newest_first(mine, "createdAt"), 1, k),
        lambda m: ellipsize(one_line(strip(text_or_empty(m.getField("text")))), max_chars),
    )
    return F.filter(texts, lambda t: t != "")


def user_context(
    positive: Column, negative: Column, conversations: Column, clicks: Column, thumbs_up: Column, thumbs_down: Column
) -> Column:
    """T7."""
    return F.struct(
        positive.alias("positive"),
        negative.alias("negative"),
        conversations.alias("conversations"),
        F.struct(clicks.alias("clicks"), thumbs_up.alias("thumbsUp"), thumbs_down.alias("thumbsDown")).alias("interactions"),
    )
