"""Scoring requests and responses: payloads, chat envelopes, normalisation, score extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankeval.functions.context import by_strength, format_interest, has_name
from rankeval.functions.loose import get, is_object, json_array, kind, loose_number, parse, text_of
from rankeval.functions.text import let, text_or_empty

# --- fixed values: field names of requests, here and in the paths and key lists below ---
_MESSAGES = "array<struct<author:string,text:string>>"
_CONVERSATIONS = f"array<struct<started_at:string,messages:{_MESSAGES}>>"
_TITLES = "array<struct<title:string,summary:string>>"
_TEXTS = "array<string>"
_INTERACTIONS = "struct<clicks:array<string>,thumbsUp:array<string>,thumbsDown:array<string>>"
# --- end of fixed values ---


def _empty(kind_: str) -> Column:
    return F.expr(f"cast(array() as {kind_})")


def _some(c: Column, kind_: str) -> Column:
    return F.coalesce(c, _empty(kind_))


def _pick(v: Column, path: str, target: str) -> Column:
    return F.try_variant_get(v, path, target)


def _list_of_titles(c: Column) -> Column:
    return F.filter(
        F.transform(
            _some(c, _TITLES),
            lambda h: F.struct(text_or_empty(h.getField("title")).alias("title"), text_or_empty(h.getField("summary")).alias("summary")),
        ),
        lambda h: h.getField("title") != "",
    )


def _rendered(v: Column) -> Column:
    """Interest entry of a request: a text stays, an object becomes its header line, anything else is ""."""
    fields = ("name", "domain", "classification", "status", "intent")
    it = F.struct(
        *[text_of(v, f"$.{f}").alias(f) for f in fields],
        loose_number(get(v, "$.strength")).alias("strength"),
        F.lit(None).cast(_TEXTS).alias("sources"),
        F.lit(None).cast(_TEXTS).alias("keywords"),
        F.lit(None).cast("string").alias("rationale"),
    )
    head = F.when(has_name(it), format_interest(it, False, False)).otherwise("")
    return F.when(kind(v) == "STRING", text_of(v)).when(is_object(v), head).otherwise("")


def _interactions(v: Column, path: str) -> Column:
    lists = {k: _some(_pick(v, f"{path}.{k}", _TEXTS), _TEXTS).alias(k) for k in ("clicks", "thumbsUp", "thumbsDown")}
    return F.struct(*lists.values())


def _has_any(inter: Column) -> Column:
    return (F.size(inter.getField("clicks")) + F.size(inter.getField("thumbsUp")) + F.size(inter.getField("thumbsDown"))) > 0


def normalize_request(df: DataFrame, request: str = "request") -> DataFrame:
    """F16: request JSON of either schema to ``history``, ``interests``, ``candidates``.

    Rich requests carry interests as an object of lists; legacy ones a list of interest objects (sorted by
    strength), conversations and interactions at the root, and shown titles in place of a history.  A request
    without candidates is its own single candidate.
    """
    v = parse(F.col(request))
    df = df.withColumn("_v", v)
    v = F.col("_v")
    rich = is_object(get(v, "$.interests"))

    def listed(key: str) -> Column:
        texts = F.transform(_some(_pick(v, f"$.interests.{key}", "array<variant>"), "array<variant>"), _rendered)
        return F.filter(texts, lambda t: t != "")

    fields = {
        "name": "string", "domain": "string", "classification": "string", "status": "string", "intent": "string",
        "strength": "double", "sources": "array<string>", "keywords": "array<string>", "rationale": "string",
    }
    legacy = F.transform(
        F.filter(by_strength(json_array(F.to_json(get(v, "$.interests")), fields)), has_name),
        lambda it: format_interest(it, False, False),
    )
    inner_conv = _some(_pick(v, "$.interests.conversations", _CONVERSATIONS), _CONVERSATIONS)
    root_conv = _some(_pick(v, "$.conversations", _CONVERSATIONS), _CONVERSATIONS)
    root_inter, inner_inter = _interactions(v, "$.interactions"), _interactions(v, "$.interests.interactions")
    none = _empty(_TEXTS)
    no_inter = F.struct(none.alias("clicks"), none.alias("thumbsUp"), none.alias("thumbsDown"))
    interests = F.struct(
        F.when(rich, listed("positive")).otherwise(legacy).alias("positive"),
        F.when(rich, listed("negative")).otherwise(none).alias("negative"),
        F.when(F.size(root_conv) > 0, root_conv).when(rich, inner_conv).otherwise(_empty(_CONVERSATIONS)).alias("conversations"),
        F.when(_has_any(root_inter), root_inter).when(rich, inner_inter).otherwise(no_inter).alias("interactions"),
    )
    titles = F.coalesce(
        F.when(F.size(_some(_pick(v, "$.shownTitles", _TEXTS), _TEXTS)) > 0, _pick(v, "$.shownTitles", _TEXTS)),
        _some(_pick(v, "$.shown_titles", _TEXTS), _TEXTS),
    )
    given = _some(_pick(v, "$.history", "array<variant>"), "array<variant>")
    named = F.transform(
        F.filter(given, is_object),
        lambda h: F.struct(text_of(h, "$.title").alias("title"), text_of(h, "$.summary").alias("summary")),
    )
    shown = F.transform(
        F.filter(titles, lambda t: text_or_empty(t) != ""), lambda t: F.struct(t.alias("title"), F.lit("").alias("summary"))
    )
    history = F.when(F.size(given) > 0, _list_of_titles(named)).otherwise(shown)
    card = lambda c: F.struct(
        text_or_empty(text_of(c, "$.id")).alias("id"), text_or_empty(text_of(c, "$.title")).alias("title"),
        text_or_empty(text_of(c, "$.summary")).alias("summary"),
    )
    many = _some(_pick(v, "$.candidates", "array<variant>"), "array<variant>")
    cands = F.when(F.size(many) > 0, F.transform(many, card)).otherwise(F.array(card(v)))
    return df.select(
        *[c for c in df.columns if c != "_v"], history.alias("history"), interests.alias("interests"), cands.alias("candidates")
    )


def build_payload(df: DataFrame, max_len: int = 2048, name: str = "payload") -> DataFrame:
    """request JSON of a sample: context, history entries with a title, the single candidate."""
    history = _list_of_titles(F.transform("history", lambda h: F.struct(h.getField("title").alias("title"), h.getField("summary").alias("summary"))))
    body = F.struct(
        F.struct(
            F.col("interests.positive").alias("positive"), F.col("interests.negative").alias("negative"),
            F.col("interests.interactions").alias("interactions"), F.col("interests.conversations").alias("conversations"),
        ).alias("interests"),
        history.alias("history"),
        F.array(
            F.struct(
                F.col("candidate.itemid").alias("id"), F.col("candidate.title").alias("title"),
                F.col("candidate.summary").alias("summary"),
            )
        ).alias("candidates"),
        F.lit(max_len).alias("max_len"),
    )
    return df.withColumn(name, F.to_json(body))


def payload_variants(df: DataFrame) -> DataFrame:
    """the request of a sample in four variants: as is, without conversations, candidate only, and with the
    interaction titles (30 at most of each kind) added as extra interests; ids carry the variant as a suffix."""
    ctx = F.col("interests")
    inter = ctx.getField("interactions")
    extra = F.array_compact(
        F.array(
            *[
                F.when(
                    F.size(inter.getField(k)) > 0,
                    F.concat(F.lit(f"USER_INTERACTIONS {k}: "), F.array_join(F.slice(inter.getField(k), 1, 30), "; ")),
                )
                for k in ("clicks", "thumbsUp", "thumbsDown")
            ]
        )
    )
    no_titles = _empty(_TEXTS)
    no_conv = F.filter(ctx.getField("conversations"), lambda g: F.lit(False))
    bare = F.struct(
        no_titles.alias("positive"), no_titles.alias("negative"), no_conv.alias("conversations"),
        F.struct(no_titles.alias("clicks"), no_titles.alias("thumbsUp"), no_titles.alias("thumbsDown")).alias("interactions"),
    )
    whole = F.struct(*[ctx.getField(k).alias(k) for k in ("positive", "negative", "conversations", "interactions")])
    variants = {
        "baseline": (whole, F.col("history")),
        "no_conversations": (whole.withField("conversations", no_conv), F.col("history")),
        "candidate_only": (bare, F.filter("history", lambda h: F.lit(False))),
        "interactions_as_interests": (whole.withField("positive", F.concat(ctx.getField("positive"), extra)), F.col("history")),
    }
    rows = F.array(
        *[F.struct(F.lit(n).alias("variant"), c.alias("interests"), h.alias("history")) for n, (c, h) in variants.items()]
    )
    keep = [c for c in df.columns if c not in ("interests", "history")]
    out = df.select(*keep, F.inline(rows))
    suffixed = F.col("candidate").withField("itemid", F.concat(F.col("candidate.itemid"), F.lit("-"), F.col("variant")))
    return out.withColumn("candidate", suffixed)


def wrap_chat(payload: Column, model: str) -> Column:
    """payload JSON as the single user message of a chat request."""
    message = F.struct(F.lit("user").alias("role"), payload.alias("content"))
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(1).alias("max_tokens"),
            F.lit(0.0).alias("temperature"),
        )
    )


def unwrap_chat(c: Column) -> Column:
    """payload text of a chat request: content of the last user message (else of the last message), the
    text parts joined when the content is a list; null when there is none."""

    def last_content(messages: Column) -> Column:
        mine = F.filter(messages, lambda m: F.coalesce(text_of(m, "$.role") == "user", F.lit(False)))
        return get(F.coalesce(F.try_element_at(mine, F.lit(-1)), F.try_element_at(messages, F.lit(-1))), "$.content")

    def text(content: Column, t: Column) -> Column:
        parts = F.filter(
            get(content, "$", "array<variant>"), lambda p: F.coalesce(text_of(p, "$.type") == "text", F.lit(False))
        )
        joined = F.array_join(F.transform(parts, lambda p: text_or_empty(text_of(p, "$.text"))), "")
        return F.when(t == "STRING", text_of(content)).when(t.startswith("ARRAY"), joined)

    # the request is parsed once, and so is what it holds
    content = let(get(parse(c), "$.messages", "array<variant>"), last_content)
    found = let(content, lambda v: let(kind(v), lambda t: text(v, t)))
    return let(found, lambda t: F.when(F.trim(t) != "", t))


def unwrap_response(c: Column) -> Column:
    """inner response text of a chat response, "" when it cannot be read."""
    content = get(parse(c), "$.choices[0].message.content")
    return F.when(kind(content) == "STRING", text_of(content)).otherwise("")


def response_fields(c: Column) -> Column:
    """struct(score, version, latency_ms) of a response body; null score and "" version on failure."""
    v = parse(c)
    return F.struct(
        loose_number(get(v, "$.scores[0].score")).alias("score"),
        F.coalesce(text_of(v, "$.model_version"), F.lit("")).alias("version"),
        get(v, "$.latency_ms", "double").alias("latency_ms"),
    )
