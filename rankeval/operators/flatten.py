"""Raw feeds to training rows: predicates, feature columns, one row per shown card, feed records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankeval.functions import context as ctx
from rankeval.functions.text import let
from rankeval.operators.selection import first_by
from rankeval.functions.loose import (
    get, is_object, json_array, json_objects, kind, loose_int, loose_number, text_of, truthy,
)

# --- fixed values: column and field names of the raw feed row ---
# every nested column is JSON text (native arrays are accepted and rendered first)
RAW_FEED = {
    "feed_id": "string", "user_id": "string", "bizdate": "string", "flight_ids": "string",
    "candidate_cards": "string", "interests": "string", "negative_interests": "string", "shown_10d": "string",
    "interactions_90d": "string", "conversation": "string",
}
CARD_FIELDS = ["itemid", "title", "summary", "sectionIndex", "cardIndex"]
# --- end of fixed values ---


def with_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly the wanted columns, typed nulls for those the table does not have."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    )


def _as_json(df: DataFrame, c: str) -> Column:
    if c not in df.columns:
        return F.lit(None).cast("string")
    return F.col(c) if isinstance(df.schema[c].dataType, T.StringType) else F.to_json(F.col(c))


ASCII_WHITE = " \t\n\r\x0b\x0c"


def day_of(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def date_between(c: Column, lo: str = "", hi: str = "", keep_blank: bool = True) -> Column:
    """Inclusive text comparison of trimmed yyyyMMdd dates, blank bounds are open.

    A blank date passes with ``keep_blank``; without it, it fails as soon as ``lo`` is set.  The first condition is wider and
    compares the bare column, so that it reaches the scan: texts that begin with white space sort below "!", those that
    end with it below the bound and "!".
    """
    d = F.btrim(F.coalesce(c, F.lit("")), F.lit(ASCII_WHITE))
    wide, cond = F.lit(True), F.lit(True)
    if lo:
        wide, cond = wide & (c >= lo), cond & (d >= lo)
    if hi:
        wide, cond = wide & (c < hi + "!"), cond & (d <= hi)
    if not lo and not hi:
        return F.lit(True)
    wide = wide | (c < "!") if not keep_blank else wide | (c < "!") | c.isNull()
    cond = cond | (d == "") if keep_blank else cond
    return wide & cond if keep_blank or lo else (wide | c.isNull()) & cond


def has_tag(c: Column, tag: str) -> Column:
    """Case-sensitive substring, no wildcards; null, which a filter drops, where there is no text."""
    return c.contains(tag)


def is_impression(card: Column) -> Column:
    """The card was shown: its section index is neither null nor empty text."""
    return F.coalesce(text_of(card, "$.sectionIndex") != "", F.lit(False))


def has_features(card: Column) -> Column:
    """P5: ``features`` is an object."""
    return is_object(get(card, "$.features"))


def shown_cards(c: Column, require_features: bool = False) -> Column:
    """Shown cards of a JSON array in display order, as structs.

    The order is (section, card) as whole numbers; an absent index counts 0, and when either fails to parse
    both count 0.  Ties keep the input order.
    """

    def index(v: Column, name: str) -> Column:
        return let(
            get(v, f"$.{name}"), lambda raw: F.when(raw.isNull(), F.lit(0).cast("bigint")).otherwise(loose_int(raw))
        )

    def place(v: Column, i: Column) -> Column:
        both = F.struct(index(v, "sectionIndex").alias("sec"), index(v, "cardIndex").alias("pos"))
        zero = F.lit(0).cast("bigint")
        return let(
            both,
            lambda b: F.when(
                b.getField("sec").isNotNull() & b.getField("pos").isNotNull(),
                F.struct(b.getField("sec").alias("sec"), b.getField("pos").alias("pos"), i.alias("i")),
            ).otherwise(F.struct(zero.alias("sec"), zero.alias("pos"), i.alias("i"))),
        )

    def shape(v: Column) -> Column:
        return F.struct(
            F.coalesce(text_of(v, "$.itemid"), F.lit("")).alias("itemid"),
            F.coalesce(text_of(v, "$.title"), F.lit("")).alias("title"),
            F.coalesce(text_of(v, "$.summary"), F.lit("")).alias("summary"),
            text_of(v, "$.sectionIndex").alias("sectionIndex"),
            text_of(v, "$.cardIndex").alias("cardIndex"),
            let(get(v, "$.is_clicked"), lambda x: truthy(x)).alias("is_clicked"),
            let(get(v, "$.features"), lambda f: F.when(is_object(f), get(f, "$", "map<string,variant>"))).alias("features"),
        )

    kept = F.filter(json_objects(c), is_impression)
    if require_features:
        kept = F.filter(kept, has_features)
    # only the places are sorted; the cards are then picked in that order
    return let(
        kept,
        lambda cards: F.transform(
            F.sort_array(F.transform(cards, place)), lambda x: let(F.get(cards, x.getField("i")), shape)
        ),
    )


def _inline_feeds(
    feeds: DataFrame, lo: str, hi: str, tag: str, require_features: bool, require_interests: bool, max_history: int,
    max_interests: int, max_groups: int, max_msgs: int, rows_of: Callable[[Column, Column], Column], carry: Sequence[str] = (),
) -> DataFrame:
    """Filter feeds and expand each into the structs of ``rows_of(cards, context)``; one narrow stage.  ``carry``: columns of
    ``feeds`` that come along.

    Everything is one expression under the generator, so each part is computed at most once per feed, and the
    context only for feeds that still have cards.  As separate projections and filters the optimizer would
    push the filters down and compute cards and interests twice.
    """
    raw = with_missing_columns(feeds, RAW_FEED | dict.fromkeys(carry, "string"))
    kept = raw.where(date_between(F.col("bizdate"), lo, hi))
    if tag:
        kept = kept.where(has_tag(F.col("flight_ids"), tag))
    shown = json_array(_as_json(feeds, "shown_10d"), ctx.EVENT)
    reactions = json_array(_as_json(feeds, "interactions_90d"), ctx.EVENT)
    messages = json_array(_as_json(feeds, "conversation"), ctx.MESSAGE)
    pos, neg = ctx.cap_interests(
        ctx.interests(json_array(_as_json(feeds, "interests"), ctx.INTEREST)),
        ctx.interests(json_array(_as_json(feeds, "negative_interests"), ctx.INTEREST)),
        max_interests,
    )

    def context(positive: Column) -> Column:
        parts = F.struct(shown.alias("shown"), reactions.alias("reactions"))
        return let(
            parts,
            lambda p: F.struct(
                ctx.user_context(
                    positive, neg, ctx.group_conversations(messages, max_groups, max_msgs),
                    ctx.clicked_titles(p.getField("shown")), ctx.reaction_titles(p.getField("reactions"), "thumbsUp"),
                    ctx.reaction_titles(p.getField("reactions"), "thumbsDown"),
                ).alias("interests"),
                ctx.shown_titles(p.getField("shown"), max_history).alias("shown_titles"),
            ),
        )

    def with_context(cards: Column) -> Column:
        def build(positive: Column) -> Column:
            rows = let(context(positive), lambda c: rows_of(cards, c))
            return F.when(F.size(positive) > 0, rows) if require_interests else rows

        return F.when(F.size(cards) > 0, let(pos, build))

    expanded = let(shown_cards(_as_json(feeds, "candidate_cards"), require_features), with_context)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return kept.select(
        blank("feed_id"), blank("user_id"), day_of(F.col("bizdate")).alias("bizdate"), blank("flight_ids"), F.inline(expanded), *carry
    )


def _as_samples(rows: DataFrame, slice_tag: str) -> DataFrame:
    flag = F.coalesce(has_tag(F.col("flight_ids"), slice_tag), F.lit(False)).cast("int") if slice_tag else F.lit(0)
    return rows.select(
        "feed_id", "user_id", "bizdate", "flight_ids", flag.alias("is_tagged"),
        F.col("card.is_clicked").cast("int").alias("label"),
        "interests",
        F.transform("shown_titles", lambda t: F.struct(t.alias("title"), F.lit("").alias("summary"))).alias("history"),
        F.struct(*[F.col(f"card.{c}").alias(c) for c in CARD_FIELDS]).alias("candidate"),
        F.col("card.features").alias("features"),
    )


def flatten_impressions(
    feeds: DataFrame, lo: str = "", hi: str = "", tag: str = "", require_features: bool = False,
    require_interests: bool = True, max_feeds: int | None = None, max_history: int = 30, max_interests: int = 0,
    max_groups: int = 0, max_msgs: int = 0, slice_tag: str = "",
) -> DataFrame:
    """One row per shown card with the user context of its feed.

    No shuffle: the context is built once per feed and repeated for its cards.  ``require_interests`` drops
    feeds without a positive interest.  ``max_feeds`` counts the feeds that survive every filter, in the order of their ids.
    """
    args = (lo, hi, tag, require_features, require_interests, max_history, max_interests, max_groups, max_msgs)
    if max_feeds is not None and max_feeds > 0:
        whole = _first_feeds(feeds, max_feeds, args)
        rows = whole.select("*", F.explode("candidates").alias("card")).drop("candidates")
    else:
        per_card = lambda cards, c: F.transform(
            cards, lambda card: F.struct(c.getField("interests").alias("interests"), c.getField("shown_titles").alias("shown_titles"), card.alias("card"))
        )
        rows = _inline_feeds(feeds, *args, rows_of=per_card)
    return _as_samples(rows, slice_tag or tag)


def _first_feeds(feeds: DataFrame, n: int, args: tuple) -> DataFrame:
    """The records of the first ``n`` feeds by id.  Ids at most are ordered, and only feeds up to the cut are read whole."""
    key = F.col("feed_id") if "feed_id" in feeds.columns else F.lit("")
    make = lambda rows: _inline_feeds(rows, *args, rows_of=_one_record, carry=("_key",))
    return first_by(feeds, key, n, make, lambda rows: _surviving(rows, *args[:5]))


def _surviving(feeds: DataFrame, lo: str, hi: str, tag: str, require_features: bool, require_interests: bool) -> DataFrame:
    """``_key`` of the feeds that :func:`_inline_feeds` makes a record of; cards and interests are read, no context is built.

    The test is under a generator, as there: the optimizer would push a filter below the columns it reads and compute them again.
    """
    kept = with_missing_columns(feeds, RAW_FEED | {"_key": "string"})
    kept = kept.where(date_between(F.col("bizdate"), lo, hi))
    if tag:
        kept = kept.where(has_tag(F.col("flight_ids"), tag))
    cards = json_objects(_as_json(feeds, "candidate_cards"))
    wanted = lambda v: is_impression(v) & has_features(v) if require_features else is_impression(v)
    some = F.exists(cards, wanted)
    if require_interests:
        some = some & (F.size(ctx.named_interests(json_array(_as_json(feeds, "interests"), ctx.INTEREST))) > 0)
    return kept.select("_key", F.inline(F.when(some, F.array(F.struct(F.lit(True).alias("_some"))))))


def _one_record(cards: Column, c: Column) -> Column:
    return F.array(
        F.struct(c.getField("interests").alias("interests"), c.getField("shown_titles").alias("shown_titles"), cards.alias("candidates"))
    )


def feed_records(
    feeds: DataFrame, lo: str = "", hi: str = "", tag: str = "", require_features: bool = False,
    max_feeds: int | None = None, max_history: int = 30, max_interests: int = 0, max_groups: int = 0, max_msgs: int = 0,
    require_interests: bool = False,
) -> DataFrame:
    """P10: one row per feed with its shown cards as an ordered array; no shuffle."""
    args = (lo, hi, tag, require_features, require_interests, max_history, max_interests, max_groups, max_msgs)
    if max_feeds is not None and max_feeds > 0:
        return _first_feeds(feeds, max_feeds, args)
    return _inline_feeds(feeds, *args, rows_of=_one_record)


def explode_records(records: DataFrame) -> DataFrame:
    """Feed records back to one row per candidate."""
    rows = records.select("*", F.inline("candidates")).drop("candidates")
    return rows.select(
        "feed_id", "user_id", "bizdate", "flight_ids", "interests", "shown_titles",
        F.struct("itemid", "title", "summary", "sectionIndex", "cardIndex").alias("candidate"),
        F.col("is_clicked").cast("int").alias("label"),
    )


def flatten_generic(df: DataFrame, max_history: int = 30) -> DataFrame:
    """One row per entry of ``items`` with the last ``max_history`` history entries (<= 0 keeps all)."""
    history = F.coalesce("history", F.expr("cast(array() as array<struct<title:string,summary:string>>)"))
    if max_history > 0:
        last = F.when(
            F.size(history) > 0, F.slice(history, -F.least(F.size(history), F.lit(max_history)), F.lit(max_history))
        ).otherwise(history)
    else:
        last = history
    rest = [c for c in df.columns if c not in ("history", "interests", "items")]
    rows = df.select(
        *rest, last.alias("history"), F.coalesce("interests", F.lit("")).alias("interests"), F.inline("items")
    )
    return rows.select(
        *rest,
        "history",
        "interests",
        F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary")).alias(
            "candidate"
        ),
        F.coalesce(F.col("clicked").cast("int"), F.lit(0)).alias("label"),
    )


def date_split(df: DataFrame, train_until: str, eval_from: str, c: str = "bizdate") -> DataFrame:
    """Split "train" up to a day, "eval" from a day; train wins, blank and in-between dates are dropped."""
    d = day_of(F.col(c))
    split = F.when(d == "", F.lit(None)).when(d <= train_until, "train").when(d >= eval_from, "eval")
    return df.withColumn("split", split).where(F.col("split").isNotNull())


def four_way(df: DataFrame, train_min: str, train_until: str, eval_from: str, tag: str) -> DataFrame:
    """Rows marked with the output sets they belong to: train_all, train_tagged, eval_all, eval_tagged.

    Evaluation rows must carry features.  Both windows are read from the same rows, so a row may be in several
    sets; write the result partitioned by ``output``.
    """
    train = date_between(F.col("bizdate"), train_min, train_until)
    evaluation = date_between(F.col("bizdate"), eval_from) & F.col("features").isNotNull()
    tagged = F.coalesce(has_tag(F.col("flight_ids"), tag), F.lit(False))
    names = F.array_compact(
        F.array(
            F.when(train, "train_all"), F.when(train & tagged, "train_tagged"), F.when(evaluation, "eval_all"),
            F.when(evaluation & tagged, "eval_tagged"),
        )
    )
    return df.withColumn("output", F.explode(names))


def feature_columns(df: DataFrame, bag: str, names: Sequence[str], policy: str = "strict") -> DataFrame:
    """Feature values of a map<string,variant> as double columns.

    strict: no bag drops the row; missing and null count 0; a value that is no number drops the row.
    falsy: an empty bag drops the row; every falsy value (also "") counts 0; else as strict.
    coalesce: nothing is dropped, whatever is no number counts 0.
    """
    m = F.col(bag)
    number, valid = {}, F.lit(True)
    for n in names:
        v = F.try_element_at(m, F.lit(n))
        x = loose_number(v)
        if policy == "coalesce":
            number[n] = F.coalesce(x, F.lit(0.0))
            continue
        absent = v.isNull() | (kind(v) == "VOID")
        if policy == "falsy":
            absent = absent | ~truthy(v)
        number[n] = F.when(absent, F.lit(0.0)).otherwise(x)
        valid = valid & (absent | x.isNotNull())
    if policy == "strict":
        df = df.where(m.isNotNull() & valid)
    elif policy == "falsy":
        df = df.where(m.isNotNull() & (F.size(m) > 0) & valid)
    return df.withColumns(number)


def wide_projection(df: DataFrame, features: Sequence[str], bag: str = "features") -> DataFrame:
    """Typed columns of the wide table: casts, blank tags, feature columns without nulls, click flag.

    ``bag`` is a map<string,double> (see ``numeric_features``).
    """
    return df.select(
        "user_id", "feed_id", F.col("sectionIndex").cast("int").alias("sectionIndex"),
        F.col("cardIndex").cast("int").alias("cardIndex"), "cardType", F.col("clicks").cast("int").alias("clicks"),
        F.col("impressions").cast("int").alias("impressions"),
        F.coalesce("flight_ids", F.lit("")).alias("flight_ids"),
        *[F.coalesce(F.try_element_at(F.col(bag), F.lit(f)), F.lit(0.0)).alias(f) for f in features],
        (F.coalesce(F.col("clicks").cast("int"), F.lit(0)) > 0).cast("int").alias("is_clicked"),
    )


def one_hot(df: DataFrame, c: str, categories: Sequence[str]) -> DataFrame:
    """0/1 columns ``c_value`` for a fixed list of values; a value outside the list gives all zeros."""
    return df.withColumns(
        {f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for v in categories}
    )


def category_list(df: DataFrame, c: str, limit: int = 10_000) -> list[str]:
    """The reference categories of a column, sorted; one distinct job that refuses to grow past ``limit``."""
    rows = df.select(F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{c} has more than {limit} categories; one column each is not sensible")
    return sorted(r["v"] for r in rows)


def is_rich() -> Column:
    """All seven context parts are there and the candidate has a title."""
    parts = [
        "interests.positive", "interests.negative", "interests.conversations", "interests.interactions.clicks",
        "interests.interactions.thumbsUp", "interests.interactions.thumbsDown", "history",
    ]
    cond = F.coalesce(F.col("candidate.title"), F.lit("")) != ""
    for p in parts:
        cond = cond & (F.coalesce(F.array_size(p), F.lit(0)) > 0)
    return cond


def funnel(
    feeds: DataFrame, lo: str = "", hi: str = "", tag: str = "", require_features: bool = False,
    require_interests: bool = True,
) -> DataFrame:
    """A2: feeds seen and kept, candidates, impressions seen and kept, samples; one aggregation."""
    raw = with_missing_columns(feeds, RAW_FEED)
    passes = date_between(F.col("bizdate"), lo, hi)
    if tag:
        passes = passes & has_tag(F.col("flight_ids"), tag)
    text = _as_json(feeds, "candidate_cards")
    sized = raw.select(
        passes.alias("p"),
        F.coalesce(F.array_size(get(F.try_parse_json(text), "$", "array<variant>")), F.lit(0)).alias("cands"),
        F.size(F.filter(json_objects(text), is_impression)).alias("shown"),
        F.size(F.filter(json_objects(text), lambda v: is_impression(v) & (has_features(v) if require_features else F.lit(True)))).alias("kept"),
        (F.size(ctx.named_interests(json_array(_as_json(feeds, "interests"), ctx.INTEREST))) > 0).alias("interested"),
    )
    p = F.col("p")
    out = (F.col("interested") if require_interests else F.lit(True)) & p
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0)).cast("bigint")
    return sized.agg(
        F.count("*").alias("feeds_seen"),
        F.count_if(p & (F.col("kept") > 0)).alias("feeds_kept"),
        total(p, F.col("cands")).alias("candidates"),
        total(p, F.col("shown")).alias("impressions_seen"),
        total(p, F.col("kept")).alias("impressions_kept"),
        total(out, F.col("kept")).alias("samples"),
    )
