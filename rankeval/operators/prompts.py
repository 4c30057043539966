"""Prompt texts as columns: full, compact, capped, generic and group prompts, and fitting them to a budget.

Section labels and cut-off lengths are fixed formats; the introduction is a parameter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rankeval.functions.text import ellipsize, hang, let, one_line, strip, text_or_empty, trim_ts, word_count

INTRO = "Predict from the profile, the chats and the cards below whether this user clicks the candidate card.\n"
SHORT_INTRO = "Predict whether this user clicks the candidate card.\n"

# --- fixed values: questions, heads and labels; those of single lines stand where they are used ---
QUESTION = "Will the user click this candidate item? I answer Yes or No:"
SHORT_QUESTION = "\nWill the user click this item? Answer:"
CAPPED_QUESTION = "Will the user click this candidate? Answer Yes or No."
GENERIC_QUESTION = "Will the user click this item? Answer:"
CONVERSATIONS_HEAD = "CONVERSATIONS (recent groups, newest first):"
NO_CONVERSATIONS = "CONVERSATIONS: (none)"
NO_SHOWN_CARDS = "SHOWN_CARDS: (none)"
INTERACTION_HEADS = {
    "thumbsUp": "USER_INTERACTIONS (positive signals, thumbs-up card titles):",
    "thumbsDown": "USER_INTERACTIONS (negative signals, thumbs-down card titles):",
    "clicks": "USER_INTERACTIONS (click signals, clicked card titles):",
}
NO_INTERACTIONS = "USER_INTERACTIONS: (none)"
GROUP_TALK = "  - Recent conversation history:"
GROUP_NEGATIVE = "  - Negative interests (avoid):"
GROUP_NOW = "- Current date and time: "
GROUP_PLACE = "- Location: "
# --- end of fixed values ---

Counter = Callable[[Column], Column]

_TEXTS = "array<string>"


def _texts(*items: Column | str) -> Column:
    return F.array(*[F.lit(i) if isinstance(i, str) else i for i in items]).cast(_TEXTS)


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def _all(c: Column) -> Column:
    return F.coalesce(c, _none())


def _numbered(items: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), body(x)))


def _section(items: Column, head: str, lines: Column) -> Column:
    """Head and lines if there are items, else nothing."""
    return F.when(F.size(items) > 0, F.concat(_texts(head), lines)).otherwise(_none())


def _bullets(items: Column, head: str, mark: str = "  - ") -> Column:
    return _section(items, head, F.transform(items, lambda t: F.concat(F.lit(mark), t)))


def _title_and(summary: Column, title: Column, dash: str) -> Column:
    s = text_or_empty(summary)
    return F.concat(text_or_empty(title), F.when(s != "", F.concat(F.lit(dash), s)).otherwise(""))


def _interest_lines(ctx: Column) -> Column:
    pos, neg = _all(ctx.getField("positive")), _all(ctx.getField("negative"))
    item = lambda t: hang(t, "    ")
    first = F.concat(
        _texts("USER_INTERESTS (positive, ranked by strength):"),
        F.when(F.size(pos) > 0, _numbered(pos, item)).otherwise(_texts("  (none)")),
    )
    both = F.concat(first, _section(neg, "USER_INTERESTS (negative, avoid):", _numbered(neg, item)))
    return F.when(ctx.isNull(), _texts("USER_INTERESTS: (none)")).otherwise(both)


def _interaction_lines(ctx: Column) -> Column:
    inter = ctx.getField("interactions")
    up, down, clicks = (_all(inter.getField(k)) for k in ("thumbsUp", "thumbsDown", "clicks"))
    lines = F.concat(
        _bullets(up, INTERACTION_HEADS["thumbsUp"]),
        _bullets(down, INTERACTION_HEADS["thumbsDown"]),
        _bullets(clicks, INTERACTION_HEADS["clicks"]),
    )
    return let(lines, lambda x: F.when(F.size(x) > 0, x).otherwise(_texts(NO_INTERACTIONS)))


def _group_lines(g: Column, i: Column) -> Column:
    at = trim_ts(g.getField("started_at"))
    head = F.concat(
        F.lit("  Conversation "), (i + 1).cast("string"),
        F.when(at != "", F.concat(F.lit(" ("), at, F.lit(")"))).otherwise(""), F.lit(":"),
    )
    lines = F.transform(
        g.getField("messages"),
        lambda m: F.concat(
            F.when(m.getField("author").isin("human", "user"), "    [user] ").otherwise("    [assistant] "),
            text_or_empty(m.getField("text")),
        ),
    )
    return F.concat(F.array(head), lines)


def _conversation_lines(groups: Column) -> Column:
    full = F.concat(_texts(CONVERSATIONS_HEAD), F.flatten(F.transform(groups, _group_lines)))
    return F.when(F.coalesce(F.array_size(groups), F.lit(0)) > 0, full).otherwise(_texts(NO_CONVERSATIONS))


def _shown_head(n: Column) -> Column:
    return F.concat(F.lit("SHOWN_CARDS (last "), n.cast("string"), F.lit(" cards shown to the user on previous days):"))


def _shown_items(history: Column) -> Column:
    return _numbered(history, lambda h: _title_and(h.getField("summary"), h.getField("title"), " — "))


def _shown_lines(history: Column) -> Column:
    n = F.coalesce(F.array_size(history), F.lit(0))
    full = F.concat(F.array(_shown_head(n)), _shown_items(history))
    return F.when(n > 0, full).otherwise(_texts(NO_SHOWN_CARDS))


def _candidate_lines(card: Column) -> Column:
    s = text_or_empty(card.getField("summary"))
    return F.concat(
        F.array(F.lit("CANDIDATE_ITEM:"), F.concat(F.lit("  title: "), text_or_empty(card.getField("title")))),
        F.when(s != "", F.array(F.concat(F.lit("  summary: "), s))).otherwise(_none()),
    )


def _full(head: Column, conversations: Column, history: Column, tail: Column) -> Column:
    lines = F.concat(head, _conversation_lines(conversations), _texts(""), _shown_lines(history), tail)
    return F.array_join(lines, "\n")


def _head(ctx: Column, intro: str) -> Column:
    return F.concat(_texts(intro), _interest_lines(ctx), _texts(""), _interaction_lines(ctx), _texts(""))


def _tail(card: Column) -> Column:
    return F.concat(_texts(""), _candidate_lines(card), _texts("", QUESTION))


def full_prompt(history: Column, interests: Column, candidate: Column, intro: str = INTRO) -> Column:
    """Introduction, interests, interactions, conversations, shown cards, candidate, question."""
    return _full(_head(interests, intro), interests.getField("conversations"), history, _tail(candidate))


def _compact_sections(ctx: Column, shown: Column) -> dict[str, Column]:
    inter = ctx.getField("interactions")
    first = lambda c, n: F.slice(_all(c), 1, n)
    messages = F.flatten(
        F.transform(
            F.slice(ctx.getField("conversations"), 1, 5),
            lambda g: F.slice(
                g.getField("messages"), -F.greatest(F.lit(1), F.least(F.size(g.getField("messages")), F.lit(3))), F.lit(3)
            ),
        )
    )
    talk = F.transform(
        messages,
        lambda m: F.concat(F.lit("  ["), m.getField("author"), F.lit("]: "), text_or_empty(m.getField("text"))),
    )
    has_talk = F.coalesce(F.array_size(ctx.getField("conversations")), F.lit(0)) > 0
    lines = {
        "interests": F.concat(
            _bullets(_all(ctx.getField("positive")), "USER_INTERESTS (positive):"),
            _bullets(_all(ctx.getField("negative")), "USER_INTERESTS (negative):"),
        ),
        "interactions": F.concat(
            _bullets(first(inter.getField("clicks"), 20), "USER_INTERACTIONS (clicks):"),
            _bullets(first(inter.getField("thumbsUp"), 10), "USER_INTERACTIONS (thumbs up):"),
            _bullets(first(inter.getField("thumbsDown"), 10), "USER_INTERACTIONS (thumbs down):"),
        ),
        "conversations": F.when(has_talk, F.concat(_texts("RECENT_CONVERSATIONS:"), _all(talk))).otherwise(_none()),
        "shown": _bullets(first(shown, 30), "SHOWN_CARDS (recent):"),
    }
    return {k: F.array_join(v, "\n") for k, v in lines.items()}


def _compact_candidate(card: Column) -> Column:
    title, summary = text_or_empty(card.getField("title")), text_or_empty(card.getField("summary"))
    parts = F.array_compact(
        F.array(
            F.lit("CANDIDATE:"),
            F.when(title != "", F.concat(F.lit("  Title: "), title)),
            F.when(summary != "", F.concat(F.lit("  Summary: "), ellipsize(one_line(summary), 500))),
        )
    )
    return F.array_join(parts, "\n")


def _join_sections(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda s: s != ""), "\n\n")


def compact_prompt(interests: Column, shown: Column, candidate: Column, intro: str = SHORT_INTRO) -> Column:
    """R2: sections without content are left out; at most 20 clicks, 10 reactions each, 5 conversations with
    their last 3 messages, 30 shown cards, 500 characters of summary."""
    s = _compact_sections(interests, shown)
    return _join_sections(
        F.array(
            F.lit(intro), s["interests"], s["interactions"], s["conversations"], s["shown"],
            _compact_candidate(candidate), F.lit(SHORT_QUESTION),
        )
    )


def capped_prompt(
    interest_texts: Column, shown: Column, conversations: Column, candidate: Column, max_interests: int = 30,
    max_shown: int = 30, max_groups: int = 5, max_msgs: int = 6, matched_interest: Column | None = None,
) -> Column:
    """Short layout with hard caps; ``interest_texts`` come strongest first and may hold blanks, which count
    for the cap (see ``context.ranked_interest_texts``)."""
    last = lambda m: F.slice(m, -F.greatest(F.lit(1), F.least(F.size(m), F.lit(max_msgs))), F.lit(max_msgs))
    messages = F.flatten(F.transform(F.slice(conversations, 1, max_groups), lambda g: last(g.getField("messages"))))
    talk = F.transform(
        messages,
        lambda m: F.concat(
            F.lit("  ["), m.getField("author"), F.lit("] "),
            ellipsize(one_line(strip(text_or_empty(m.getField("text")))), 220),
        ),
    )
    summary = candidate.getField("summary")
    matched = F.lit(None).cast("string") if matched_interest is None else matched_interest
    card = F.array_compact(
        F.array(
            F.lit("CANDIDATE:"),
            F.concat(F.lit("Title: "), text_or_empty(candidate.getField("title"))),
            F.when(text_or_empty(summary) != "", F.concat(F.lit("Summary: "), summary)),
            F.when(text_or_empty(matched) != "", F.concat(F.lit("Matched Interest: "), matched)),
        )
    )
    chosen = F.filter(F.slice(_all(interest_texts), 1, max_interests), lambda t: t != "")
    parts = F.array(
        F.array_join(_bullets(chosen, "USER_INTERESTS:", "- "), "\n"),
        F.array_join(_bullets(F.slice(_all(shown), 1, max_shown), "SHOWN_CARDS:", "- "), "\n"),
        F.array_join(_section(_all(talk), "RECENT_CONVERSATIONS:", _all(talk)), "\n"),
        F.array_join(card, "\n"),
        F.lit(CAPPED_QUESTION),
    )
    return _join_sections(parts)


def generic_prompt(history: Column, interests: Column, candidate: Column) -> Column:
    """Free-text interests, numbered reading history, one candidate line."""
    n = F.coalesce(F.array_size(history), F.lit(0))
    items = F.transform(
        history,
        lambda h, i: F.concat((i + 1).cast("string"), F.lit(". "), _title_and(h.getField("summary"), h.getField("title"), " - ")),
    )
    lines = F.concat(
        F.when(text_or_empty(interests) != "", F.array(F.concat(F.lit("User interests: "), interests))).otherwise(_none()),
        F.when(n > 0, F.concat(_texts("User reading history:"), items)).otherwise(_texts("User reading history: (none)")),
        F.array(F.lit(""), F.lit("Candidate item:"), _title_and(candidate.getField("summary"), candidate.getField("title"), " - ")),
        _texts("", GENERIC_QUESTION),
    )
    return F.array_join(lines, "\n")


def group_prompt(
    groups: Column, interests: Column, shown: Column, now: Column | None = None, place: Column | None = None, whole: bool = False,
) -> Column:
    """Groups with their cards, interests, interactions and shown cards of one ranking request.

    ``groups`` is array<struct<matched_interest, cards array<struct<id, title, summary>>>>.  ``whole`` adds the conversations before
    the interests and the negative interests after them; ``now`` and ``place`` end the text where they are given, blank where null.
    """

    def group(g: Column, i: Column) -> Column:
        cards = F.flatten(
            F.transform(
                g.getField("cards"),
                lambda c, j: F.array(
                    F.concat(F.lit("  - Card "), (j + 1).cast("string"), F.lit(":")),
                    F.concat(F.lit("    - Id: "), text_or_empty(c.getField("id"))),
                    F.concat(F.lit("    - Title: "), text_or_empty(c.getField("title"))),
                    F.concat(F.lit("    - Summary: "), text_or_empty(c.getField("summary"))),
                ),
            )
        )
        head = F.array(
            F.concat(F.lit("  Group "), i.cast("string"), F.lit(":")),
            F.concat(F.lit("  - MatchedInterest: "), text_or_empty(g.getField("matched_interest"))),
        )
        return F.concat(head, cards)

    inter = interests.getField("interactions")
    signals = F.concat(
        _bullets(_all(inter.getField("thumbsUp")), "  - Positive signals (thumbs up article titles):", "    - "),
        _bullets(_all(inter.getField("thumbsDown")), "  - Negative signals (thumbs down article titles):", "    - "),
        _bullets(_all(inter.getField("clicks")), "  - Click signals (clicked card titles):", "    - "),
    )
    some = lambda c, none: let(_all(c), lambda x: F.when(F.size(x) > 0, x).otherwise(_texts(none)))
    lines = F.concat(
        _texts("- BLENDED_GROUPS:"),
        F.flatten(F.transform(groups, group)),
        _texts("- USER_INTERESTS:"),
        *([_texts(GROUP_TALK), some(F.flatten(F.transform(interests.getField("conversations"), _group_lines)), "  (none)")] if whole else []),
        F.transform(_all(interests.getField("positive")), lambda t: F.concat(F.lit("  - "), t)),
        *([_bullets(_all(interests.getField("negative")), GROUP_NEGATIVE, "    - ")] if whole else []),
        _texts("- USER_INTERACTIONS:"),
        some(signals, "  No user interactions found."),
        _texts("- SHOWN_CARDS:"),
        some(F.transform(_all(shown), lambda t: F.concat(F.lit("  - "), t)), " No shown cards found."),
        *[F.array(F.concat(F.lit(label), text_or_empty(c))) for label, c in ((GROUP_NOW, now), (GROUP_PLACE, place)) if c is not None],
    )
    return F.array_join(lines, "\n")


def body_budget(max_len: int) -> int:
    return max(256, max_len - 120)


def _shrink_steps(history: Column, conversations: Column) -> Column:
    """(history kept, conversations kept) in the order they are tried after the full prompt.

    The history is halved until it is empty, then the oldest conversation groups go one by one.
    """
    n, m = F.coalesce(F.array_size(history), F.lit(0)), F.coalesce(F.array_size(conversations), F.lit(0))
    halvings = F.when(n > 0, F.floor(F.log2(n.cast("double")) + 1e-9).cast("int") + 1).otherwise(0)
    step = lambda h, c: F.struct(h.cast("int").alias("h"), c.cast("int").alias("c"))
    halves = F.when(
        n > 0, F.transform(F.sequence(F.lit(1), halvings), lambda i: step(F.floor(n / F.pow(F.lit(2.0), i)), m))
    )
    drops = F.when(m > 0, F.transform(F.sequence(m - 1, F.lit(0), F.lit(-1)), lambda c: step(F.lit(0), c)))
    empty = F.expr("cast(array() as array<struct<h:int,c:int>>)")
    return F.concat(F.coalesce(halves, empty), F.coalesce(drops, empty))


def _first_n(c: Column, n: Column) -> Column:
    return F.slice(c, F.lit(1), n)


def budgeted_prompt(
    df: DataFrame, max_len: int, counter: Counter = word_count, fast: bool = True, history: str = "history",
    interests: str = "interests", candidate: str = "candidate", intro: str = INTRO,
) -> DataFrame:
    """Add ``prompt``, ``truncated``, ``dropped_history``, ``dropped_conversations``.

    The budget is max(256, max_len - 120) tokens.  With ``fast``, texts of at most 2.5 characters per token
    pass uncounted.  Longer ones are shortened step by step until one fits.  If none fits, the shortest text is
    returned over budget.
    """
    budget = body_budget(max_len)
    h, ctx, card = F.col(history), F.col(interests), F.col(candidate)
    conv = ctx.getField("conversations")
    n, m = F.coalesce(F.array_size(h), F.lit(0)), F.coalesce(F.array_size(conv), F.lit(0))
    parts = df.withColumn("_head", _head(ctx, intro)).withColumn("_tail", _tail(card))
    parts = parts.withColumn("_full", _full(F.col("_head"), conv, h, F.col("_tail")))
    short = F.length("_full") <= int(2.5 * budget) if fast else F.lit(False)
    search = _search_by_sums if getattr(counter, "additive", False) else _search_by_rendering
    step = F.when(~short, search(h, conv, counter, budget))
    # under a generator, so that a filter on the result does not search a second time below it
    out = parts.select("*", F.explode(F.array(step)).alias("_step"))
    changed = F.col("_step.h").isNotNull() & ((F.col("_step.h") < n) | (F.col("_step.c") < m))
    again = _full(F.col("_head"), _first_n(conv, F.col("_step.c")), _first_n(h, F.col("_step.h")), F.col("_tail"))
    # the last resort reports everything as dropped
    truncated = F.col("_step").isNotNull() & (~F.col("_step.done") | changed)
    dropped = lambda size, kept: F.when(F.col("_step").isNull(), 0).when(F.col("_step.done"), size - kept).otherwise(size)
    return out.select(
        *df.columns,
        F.when(changed, again).otherwise(F.col("_full")).alias("prompt"),
        truncated.alias("truncated"),
        dropped(n, F.col("_step.h")).alias("dropped_history"),
        dropped(m, F.col("_step.c")).alias("dropped_conversations"),
    )


_STEP = "struct<done:boolean,h:int,c:int>"


def _all_steps(h: Column, conv: Column) -> Column:
    """The full prompt first, then the shortened ones."""
    n, m = F.coalesce(F.array_size(h), F.lit(0)), F.coalesce(F.array_size(conv), F.lit(0))
    return F.concat(F.array(F.struct(n.alias("h"), m.alias("c"))), _shrink_steps(h, conv))


def _first_fitting_step(h: Column, conv: Column, fits: Callable[[Column], Column]) -> Column:
    start = F.struct(F.lit(False).alias("done"), F.lit(0).alias("h"), F.lit(0).alias("c")).cast(_STEP)

    def try_step(state: Column, s: Column) -> Column:
        tried = F.struct(fits(s).alias("done"), s.getField("h").alias("h"), s.getField("c").alias("c")).cast(_STEP)
        return F.when(state.getField("done"), state).otherwise(tried)

    return F.aggregate(_all_steps(h, conv), start, try_step)


def _search_by_rendering(h: Column, conv: Column, counter: Counter, budget: int) -> Column:
    def fits(s: Column) -> Column:
        text = _full(F.col("_head"), _first_n(conv, s.getField("c")), _first_n(h, s.getField("h")), F.col("_tail"))
        return counter(text) <= budget

    return _first_fitting_step(h, conv, fits)


def _search_by_sums(h: Column, conv: Column, counter: Counter, budget: int) -> Column:
    """For counters that add up over lines every line is counted once and only sums are compared."""
    lines = lambda c: counter(F.array_join(c, "\n"))
    zero = F.lit(0).cast("int")
    counts = F.struct(
        (lines(F.col("_head")) + lines(F.col("_tail"))).cast("int").alias("fixed"),
        F.coalesce(F.transform(conv, lambda g, i: lines(_group_lines(g, i)).cast("int")), F.expr("cast(array() as array<int>)")).alias("conv"),
        F.coalesce(F.transform(_shown_items(h), lambda t: counter(t).cast("int")), F.expr("cast(array() as array<int>)")).alias("shown"),
        F.struct(
            counter(F.lit(CONVERSATIONS_HEAD)).cast("int").alias("conv"), counter(F.lit(NO_CONVERSATIONS)).cast("int").alias("no_conv"),
            counter(_shown_head(F.lit(1))).cast("int").alias("shown"), counter(F.lit(NO_SHOWN_CARDS)).cast("int").alias("no_shown"),
        ).alias("heads"),
    )
    total = lambda c, k: F.aggregate(F.slice(c, F.lit(1), k), zero, lambda a, x: a + x)

    def search(k: Column) -> Column:
        heads = k.getField("heads")

        def fits(s: Column) -> Column:
            talk = F.when(s.getField("c") > 0, heads.getField("conv") + total(k.getField("conv"), s.getField("c"))).otherwise(heads.getField("no_conv"))
            seen = F.when(s.getField("h") > 0, heads.getField("shown") + total(k.getField("shown"), s.getField("h"))).otherwise(heads.getField("no_shown"))
            return k.getField("fixed") + talk + seen <= budget

        return _first_fitting_step(h, conv, fits)

    return let(counts, search)


_LEDGER = "struct<step:int,renders:int>"


class Ledger:
    """Token counts of a prompt's lines, from which the size of every shortened version is told before it is put together.

    A line is counted once, with the line break that ends it.  What a tokenizer joins across line breaks makes a sum of counts a
    guess, which is corrected by the versions counted as a whole so far; the version it points to, and its neighbour, are
    counted as a whole.
    """

    def __init__(self, count_tokens: Callable[[str], int], budget: int):
        self.count, self.budget, self.lines = count_tokens, budget, {}

    def of(self, line: str) -> int:
        if line not in self.lines:
            if len(self.lines) >= 100_000:  # heads and titles repeat, whole prompts do not
                self.lines.clear()
            self.lines[line] = self.count(line + "\n")
        return self.lines[line]

    def first_fitting(self, parts) -> tuple[int | None, int]:
        """The first step of ``parts`` whose text fits, None if none does, and how many texts were put together for it.

        A later step never counts more, so a step that fits behind one that does not is the first.
        """
        head, tail = list(parts["head"]), list(parts["tail"])
        groups, shown, heads = [list(g) for g in parts["groups"]], list(parts["shown"]), list(parts["shown_heads"])
        steps = [(s["h"], s["c"]) for s in parts["steps"]]

        def lines(step: int) -> list[str]:
            h, c = steps[step]
            talk = [CONVERSATIONS_HEAD, *(x for g in groups[:c] for x in g)] if c else [NO_CONVERSATIONS]
            seen = [heads[h], *shown[:h]] if h else [NO_SHOWN_CARDS]
            return [*head, *talk, "", *seen, *tail]

        exact = {0: self.count("\n".join(lines(0)))}
        if exact[0] <= self.budget:
            return 0, 1
        fixed = sum(map(self.of, [*head, "", *tail]))
        upto = lambda sizes: [0, *accumulate(sizes)]
        talk, seen = upto(sum(map(self.of, g)) for g in groups), upto(map(self.of, shown))
        longer = upto(map(len, groups))

        def total(step: int) -> int:
            h, c = steps[step]
            return fixed + (self.of(CONVERSATIONS_HEAD) + talk[c] if c else self.of(NO_CONVERSATIONS)) + (self.of(heads[h]) + seen[h] if h else self.of(NO_SHOWN_CARDS))

        def breaks(step: int) -> int:
            h, c = steps[step]
            return len(head) + len(tail) + 3 + h + longer[c]

        # the first fitting step lies behind ``below`` and not behind ``fit``; what a whole text counts beyond its lines is
        # laid on its line breaks, and the next guess takes that into account
        below, fit = 0, len(steps)
        while fit - below > 1:
            last = max(exact)
            each = (exact[last] - total(last)) / breaks(last)
            inside = range(below + 1, fit)
            at = bisect_left(inside, True, key=lambda i: total(i) + each * breaks(i) <= self.budget)
            if len(exact) > 4:  # the guesses are no good here
                at = len(inside) // 2
            at = inside[min(at, len(inside) - 1)]
            exact[at] = self.count("\n".join(lines(at)))
            below, fit = (below, at) if exact[at] <= self.budget else (at, fit)
        return (fit if fit < len(steps) else None), len(exact)


def budgeted_prompt_with(
    df: DataFrame, max_len: int, count_tokens: Callable[[str], int], history: str = "history",
    interests: str = "interests", candidate: str = "candidate", intro: str = INTRO, renders: str | None = None,
) -> DataFrame:
    """R5, R6, X5 with a real tokenizer: ``count_tokens`` is a Python callable.

    Texts short enough for the fast path never leave the JVM.  Of the others the lines go to Python once; a :class:`Ledger` finds the
    step, and the text of that step alone is rendered.  ``renders``: a column for the number of texts that were put together to
    find it.
    """
    budget = body_budget(max_len)
    h, ctx, card = F.col(history), F.col(interests), F.col(candidate)
    conv = ctx.getField("conversations")
    n, m = F.coalesce(F.array_size(h), F.lit(0)), F.coalesce(F.array_size(conv), F.lit(0))

    @F.pandas_udf(_LEDGER)
    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger = Ledger(count_tokens, budget)
        for pdf in parts:
            found = [ledger.first_fitting(r) if r["head"] is not None else (0, 0) for r in pdf.to_dict("records")]
            yield pd.DataFrame({"step": pd.array([f[0] for f in found], "Int32"), "renders": [f[1] for f in found]})

    parts = df.withColumn("_head", _head(ctx, intro)).withColumn("_tail", _tail(card))
    parts = parts.withColumn("_full", _full(F.col("_head"), conv, h, F.col("_tail")))
    split = lambda c: F.flatten(F.transform(c, lambda t: F.split(t, "\n")))
    many = F.length("_full") > int(2.5 * budget)
    ledger = F.struct(
        split(F.col("_head")).alias("head"), split(F.col("_tail")).alias("tail"),
        F.coalesce(F.transform(conv, lambda g, i: split(_group_lines(g, i))), F.expr("cast(array() as array<array<string>>)")).alias("groups"),
        F.coalesce(_shown_items(h), _none()).alias("shown"), F.transform(F.sequence(F.lit(0), n), _shown_head).alias("shown_heads"),
        _all_steps(h, conv).alias("steps"),
    )
    # Python sees the long texts only; short ones pass it as nulls, so that the rows are made once
    found = parts.withColumn("_many", many).withColumn("_steps", F.when(F.col("_many"), _all_steps(h, conv)))
    found = found.withColumn("_found", search(F.when(F.col("_many"), ledger)))
    out = found.withColumn("_step", F.when(F.col("_many"), F.get("_steps", F.coalesce("_found.step", F.size("_steps") - 1))))
    again = _full(F.col("_head"), _first_n(conv, F.col("_step.c")), _first_n(h, F.col("_step.h")), F.col("_tail"))
    none_fits = F.col("_many") & F.col("_found.step").isNull()
    dropped = lambda size, kept: F.when(~F.col("_many"), 0).when(none_fits, size).otherwise(size - kept)
    return out.select(
        *df.columns,
        F.when(~F.col("_many") | (F.col("_found.step") == 0), F.col("_full")).otherwise(again).alias("prompt"),
        (none_fits | (F.col("_many") & (F.col("_found.step") != 0))).alias("truncated"),
        dropped(n, F.col("_step.h")).alias("dropped_history"),
        dropped(m, F.col("_step.c")).alias("dropped_conversations"),
        *([F.col("_found.renders").alias(renders)] if renders else []),
    )


def truncation_stats(df: DataFrame) -> DataFrame:
    """Truncated rows, their share, and the average number of dropped entries per truncated row."""
    cut = F.count_if("truncated")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("truncated"), F.col(c))), F.lit(0))
    return df.agg(
        F.count("*").alias("n"),
        cut.alias("truncated"),
        (cut / F.greatest(F.lit(1), F.count("*"))).alias("rate"),
        (total("dropped_history") / F.greatest(F.lit(1), cut)).alias("avg_dropped_history"),
        (total("dropped_conversations") / F.greatest(F.lit(1), cut)).alias("avg_dropped_conversations"),
    )


def greedy_prompt(
    interests: Column, shown: Column, candidate: Column, max_tokens: int, counter: Counter = word_count,
    intro: str = SHORT_INTRO,
) -> Column:
    """Whole sections in the order interests, interactions, shown cards, conversations while they fit, then
    the leading lines of the first that does not, then nothing more.  Introduction, candidate and question are
    always there."""
    s = _compact_sections(interests, shown)
    card = _compact_candidate(candidate)
    fixed = F.concat(F.lit(intro + "\n\n"), card, F.lit("\n\n" + SHORT_QUESTION))
    sections = F.filter(
        F.array(s["interests"], s["interactions"], s["shown"], s["conversations"]), lambda t: t != ""
    )
    shape = "struct<left:int,used:array<string>,done:boolean>"
    lines_shape = "struct<used:int,lines:array<string>,done:boolean>"

    def take_lines(section: Column, left: Column) -> Column:
        start = F.struct(F.lit(0).alias("used"), _none().alias("lines"), F.lit(False).alias("done")).cast(lines_shape)

        def add(a: Column, line: Column) -> Column:
            need = counter(line)
            fit = F.struct(a.getField("used") + need, F.concat(a.getField("lines"), F.array(line)), F.lit(False))
            stop = a.withField("done", F.lit(True))
            return F.when(a.getField("done") | (a.getField("used") + need > left), stop.cast(lines_shape)).otherwise(
                fit.cast(lines_shape)
            )

        return F.aggregate(F.split(section, "\n"), start, add)

    def add_section(a: Column, section: Column) -> Column:
        need, left = counter(section), a.getField("left")
        whole = F.struct(left - need, F.concat(a.getField("used"), F.array(section)), F.lit(False)).cast(shape)
        part = let(
            take_lines(section, left),
            lambda p: F.struct(
                left - p.getField("used"),
                F.when(
                    F.size(p.getField("lines")) > 0,
                    F.concat(a.getField("used"), F.array(F.array_join(p.getField("lines"), "\n"))),
                ).otherwise(a.getField("used")),
                F.lit(True),
            ).cast(shape),
        )
        return F.when(a.getField("done"), a).when(need <= left, whole).otherwise(part)

    def build(fixed_text: Column) -> Column:
        left = F.lit(max_tokens) - counter(fixed_text)
        start = F.struct(left.alias("left"), _none().alias("used"), F.lit(False).alias("done")).cast(shape)
        used = F.aggregate(sections, start, add_section, lambda a: a.getField("used"))
        text = F.array_join(F.concat(_texts(intro), used, F.array(card, F.lit(SHORT_QUESTION))), "\n\n")
        return F.when(left <= 0, fixed_text).otherwise(text)

    return let(fixed, build)


_SHRUNK = "struct<done:boolean,step:int,h:int,c:int,total:int>"


def first_shrunk(counts, budget: int, limit: int) -> tuple[bool, int, int, int, int]:
    """The first number of removals whose budgeted and wrapped prompt has at most ``limit`` tokens, with the history entries and
    conversation groups it keeps and the tokens it has, told from token counts of its lines; the last number if none fits."""
    upto = lambda sizes: [0, *accumulate(sizes)]
    groups, shown = upto(counts["groups"]), upto(counts["shown"])
    no_talk, talk_head = counts["group_heads"]
    talk = [talk_head + x if i else no_talk for i, x in enumerate(groups)]
    seen = [head + x for head, x in zip(counts["shown_heads"], shown)]
    titles, heads, order = [upto(counts[f"titles{q}"]) for q in range(3)], counts["heads"], list(counts["order"])
    left, n, m = [len(t) - 1 for t in titles], len(shown) - 1, len(groups) - 1
    halves = [n >> i for i in range(n.bit_length() + 1)]  # n to 0
    signals = lambda: sum(heads[q] + titles[q][x] for q, x in enumerate(left) if x) if any(left) else heads[3]
    fixed, more = counts["fixed"] + signals(), counts["more"]
    # without history: the most groups, up to each number, that fit
    best = list(accumulate((c if fixed + talk[c] + seen[0] <= budget else -1 for c in range(m + 1)), max))
    for step in range(m + len(order) + 1):
        if step > m:
            left[order[step - m - 1]] -= 1
            fixed = counts["fixed"] + signals()
        c = max(m - step, 0)
        h = next((x for x in halves if fixed + talk[c] + seen[x] <= budget), None)
        if h is None:
            h, c = 0, max(best[c - 1], 0) if c else 0
        total = fixed + more + talk[c] + seen[h]
        if total <= limit:
            return True, step, h, c, total
    return False, step, h, c, total


def shrink_prompt(
    df: DataFrame, max_len: int, limit: int, counter: Counter = word_count, history: str = "history",
    interests: str = "interests", candidate: str = "candidate", intro: str = INTRO, wrap: tuple[str, str] = ("", ""),
) -> DataFrame:
    """Fit the wrapped prompt into ``limit`` tokens.

    After the budgeted prompt: drop further conversation groups from the tail, then one title at a time from
    clicks, thumbs-down and thumbs-up in turn, each time rebuilding the budgeted prompt; as a last resort keep
    the longest end that ``counter`` counts as ``limit``.  Adds ``prompt``, ``tokens`` and a struct ``drops``.
    """
    ctx = F.col(interests)
    inter = ctx.getField("interactions")
    conv = ctx.getField("conversations")
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    queues = {"clicks": 0, "thumbsDown": 1, "thumbsUp": 2}

    def turns_of(k: str, q: int) -> Column:
        n = size(inter.getField(k))
        turns = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(j.alias("j"), F.lit(q).alias("q")))
        return F.when(n > 0, turns).otherwise(F.expr("cast(array() as array<struct<j:int,q:int>>)"))

    def times(turns: Column, q: int) -> Column:
        return F.size(F.filter(turns, lambda t: t == q))

    turns = F.flatten(F.array(*[turns_of(k, q) for k, q in queues.items()]))
    order = F.transform(F.sort_array(turns), lambda t: t.getField("q"))
    work = df.withColumn("_order", order).withColumn("_m", size(conv)).withColumn("_tail", _tail(F.col(candidate)))
    budget = body_budget(max_len)
    h = F.col(history)

    def reduced(step: Column) -> tuple[Column, Column]:
        """Context and conversations after ``step`` removals: conversations first, then interaction titles in turn."""
        gone_conv = F.least(step, F.col("_m"))
        taken = F.slice(F.col("_order"), F.lit(1), step - gone_conv)
        left = {
            k: F.slice(_all(inter.getField(k)), F.lit(1), size(inter.getField(k)) - times(taken, q))
            for k, q in queues.items()
        }
        kept_conv = F.slice(conv, F.lit(1), F.col("_m") - gone_conv)
        rest = F.struct(
            ctx.getField("positive").alias("positive"), ctx.getField("negative").alias("negative"),
            kept_conv.alias("conversations"),
            F.struct(left["clicks"].alias("clicks"), left["thumbsUp"].alias("thumbsUp"), left["thumbsDown"].alias("thumbsDown")).alias("interactions"),
        )
        return rest, kept_conv

    wrapped = lambda body: F.concat(F.lit(wrap[0]), body, F.lit(wrap[1]))

    def render(step: Column) -> Column:
        rest, kept_conv = reduced(step)

        def fit(head: Column) -> Column:
            shape = "struct<done:boolean,text:string>"
            first = F.struct(F.lit(False).alias("done"), F.lit("").alias("text")).cast(shape)
            steps = F.concat(F.array(F.struct(size(h).alias("h"), size(kept_conv).alias("c"))), _shrink_steps(h, kept_conv))

            def one(a: Column, s: Column) -> Column:
                text = _full(head, _first_n(kept_conv, s.getField("c")), _first_n(h, s.getField("h")), F.col("_tail"))
                tried = let(text, lambda t: F.struct((counter(t) <= budget).alias("done"), t.alias("text")))
                return F.when(a.getField("done"), a).otherwise(tried).cast(shape)

            return F.aggregate(steps, first, one, lambda a: a.getField("text"))

        return wrapped(let(_head(rest, intro), fit))

    def by_rendering() -> DataFrame:
        shape = "struct<done:boolean,text:string,step:int,total:int>"

        def attempt(a: Column, step: Column) -> Column:
            tried = let(
                let(render(step), lambda t: F.struct(t.alias("text"), counter(t).alias("n"))),
                lambda x: F.struct((x.getField("n") <= limit).alias("done"), x.getField("text"), step.alias("step"), x.getField("n")).cast(shape),
            )
            return F.when(a.getField("done"), a).otherwise(tried)

        start = F.struct(F.lit(False).alias("done"), F.lit("").alias("text"), F.lit(0).alias("step"), F.lit(0).alias("total")).cast(shape)
        return work.withColumn("_r", F.aggregate(F.sequence(F.lit(0), F.col("_m") + F.size("_order")), start, attempt))

    def by_sums() -> DataFrame:
        """Every line is counted once; only the text that is kept is put together."""
        @F.pandas_udf(_SHRUNK)
        def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                found = [first_shrunk(r, budget, limit) for r in pdf.to_dict("records")]
                yield pd.DataFrame(found, columns=["done", "step", "h", "c", "total"])

        ends = [(wrap[0] + intro.split("\n")[0], intro.split("\n")[0]), (QUESTION.split("\n")[-1] + wrap[1], QUESTION.split("\n")[-1])]
        before = F.array_join(F.concat(_texts(intro), _interest_lines(reduced(F.lit(0))[0]), _texts("")), "\n")
        after = F.array_join(F.col("_tail"), "\n")
        count = lambda t: F.coalesce(counter(t), F.lit(0)).cast("int")
        each = lambda c, f: F.transform(_all(c), lambda t: count(F.concat(F.lit("  - "), t))).alias(f)
        sums = F.struct(
            (count(before) + count(after)).alias("fixed"),
            # the wrapping joins the first and the last line, which are the same for all rows
            sum((count(F.lit(joined)) - count(F.lit(line)) for joined, line in ends), F.lit(0)).alias("more"),
            F.coalesce(F.transform(conv, lambda g, i: count(F.array_join(_group_lines(g, i), "\n"))), F.expr("cast(array() as array<int>)")).alias("groups"),
            F.coalesce(F.transform(_shown_items(h), count), F.expr("cast(array() as array<int>)")).alias("shown"),
            F.transform(F.sequence(F.lit(0), size(h)), lambda i: F.when(i > 0, count(_shown_head(i))).otherwise(count(F.lit(NO_SHOWN_CARDS)))).alias("shown_heads"),
            F.array(count(F.lit(NO_CONVERSATIONS)), count(F.lit(CONVERSATIONS_HEAD))).alias("group_heads"),
            F.array(*[count(F.lit(INTERACTION_HEADS[k])) for k in queues], count(F.lit(NO_INTERACTIONS))).alias("heads"),
            *[each(inter.getField(k), f"titles{q}") for k, q in queues.items()],
            F.col("_order").alias("order"),
        )
        found = work.withColumn("_s", search(sums))
        rest, kept_conv = reduced(F.col("_s.step"))
        body = _full(_head(rest, intro), _first_n(kept_conv, F.col("_s.c")), _first_n(h, F.col("_s.h")), F.col("_tail"))
        return found.withColumn("_r", F.struct(F.col("_s.done").alias("done"), wrapped(body).alias("text"), F.col("_s.step").alias("step"), F.col("_s.total").alias("total")))

    work = by_sums() if getattr(counter, "additive", False) else by_rendering()
    # the longest end of the text, in whole characters, that the counter finds short enough: ends twice as long each until one is
    # not, then a search by halves in that one, as a shorter end never counts more; so the text before it is not counted
    full = F.col("_r.text")
    least = 8.0 * max(limit, 1)  # more characters than most texts of that many tokens have
    doublings = F.greatest(F.lit(0), F.ceil(F.log2(F.length(full) / least)).cast("int")) + 1

    def longer(a: Column, i: Column) -> Column:
        end = F.right(full, F.least(F.lit(least) * F.pow(F.lit(2.0), i), F.lit(2147483647.0)).cast("int"))
        return F.when(a.getField("over"), a).otherwise(let(end, lambda t: F.struct((counter(t) > limit).alias("over"), t.alias("end"))))

    near = F.aggregate(
        F.sequence(F.lit(0), doublings), F.struct(F.lit(False).alias("over"), F.lit("").alias("end")), longer, lambda a: a.getField("end")
    )

    def ending(t: Column, most: Column) -> Column:
        """Characters of the longest end of ``t`` that counts at most ``most``."""
        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a.getField("lo") + a.getField("hi") + 1) / 2).cast("int")
            return let(counter(F.right(t, middle)) <= most, lambda ok: F.struct(
                F.when(ok, middle).otherwise(a.getField("lo")).alias("lo"), F.when(ok, a.getField("hi")).otherwise(middle - 1).alias("hi")
            ))

        halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.length(t) + 1)).cast("int") + 1)
        return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.length(t).alias("hi")), halve, lambda a: a.getField("lo"))

    def ending_by_lines(t: Column) -> Column:
        """The same where counts add up over lines: whole lines from the last, each counted once, then a part of the next."""
        shape = "struct<over:boolean,left:int,chars:int,line:string>"

        def add(a: Column, line: Column) -> Column:
            left, chars = a.getField("left"), a.getField("chars")
            one = lambda n: F.when(n <= left, F.struct(F.lit(False), left - n, chars + F.length(line) + 1, F.lit("")).cast(shape)).otherwise(
                F.struct(F.lit(True), left, chars, line).cast(shape)
            )
            return F.when(a.getField("over"), a).otherwise(let(counter(line), one))

        start = F.struct(F.lit(False), F.lit(limit), F.lit(0), F.lit("")).cast(shape)
        whole = F.aggregate(F.reverse(F.split(t, "\n")), start, add)
        part = lambda a: F.when(a.getField("over"), a.getField("chars") + ending(a.getField("line"), a.getField("left")))
        return F.coalesce(let(whole, part), F.length(t))

    longest = ending_by_lines if getattr(counter, "additive", False) else lambda t: ending(t, F.lit(limit))
    cut = let(let(near, lambda t: F.struct(t.alias("t"), longest(t).alias("n"))), lambda e: F.right(e.getField("t"), e.getField("n")))
    work = work.withColumn("_cut", F.when(~F.col("_r.done"), let(cut, lambda t: F.struct(t.alias("text"), counter(t).alias("tokens")))))
    text = F.when(F.col("_r.done"), full).otherwise(F.col("_cut.text"))
    tokens = F.when(F.col("_r.done"), F.when(full.isNotNull(), F.col("_r.total"))).otherwise(F.col("_cut.tokens"))
    gone = F.slice("_order", F.lit(1), F.col("_r.step") - F.least(F.col("_r.step"), F.col("_m")))
    return work.select(
        *df.columns,
        text.alias("prompt"),
        tokens.alias("tokens"),
        F.struct(
            F.least(F.col("_r.step"), F.col("_m")).alias("conversations"),
            *[times(gone, q).alias(k) for k, q in queues.items()],
            F.when(F.col("_r.done"), 0).otherwise(F.col("_r.total") - tokens).alias("hard_truncated_tokens"),
        ).alias("drops"),
    )


def prompt_parity(a: Column, b: Column, markers: Sequence[str], counter: Counter = word_count) -> Column:
    """Sizes of two renderings, which section markers they contain, and where their lines differ."""
    flags = F.array(
        *[F.struct(F.lit(m).alias("marker"), F.contains(a, F.lit(m)).alias("in_a"), F.contains(b, F.lit(m)).alias("in_b")) for m in markers]
    )

    def compare(lines: Column) -> Column:
        # both texts are split once; the lines come in pairs, so that no place looks for its own in an array
        la, lb = lines.getField("a"), lines.getField("b")
        places = F.filter(
            F.transform(
                F.when(la.isNotNull() | lb.isNotNull(), F.arrays_zip(_all(la).alias("a"), _all(lb).alias("b"))),
                lambda p, i: F.struct(
                    i.alias("line"), F.coalesce(p.getField("a"), F.lit("(end)")).alias("a"), F.coalesce(p.getField("b"), F.lit("(end)")).alias("b")
                ),
            ),
            lambda p: p.getField("a") != p.getField("b"),
        )
        return let(
            places,
            lambda d: F.struct(
                F.length(a).alias("chars_a"), F.length(b).alias("chars_b"), counter(a).alias("tokens_a"),
                counter(b).alias("tokens_b"), F.size(la).alias("lines_a"), F.size(lb).alias("lines_b"),
                flags.alias("markers"), F.size(d).alias("differing_lines"), F.slice(d, 1, 5).alias("first_differences"),
            ),
        )

    return let(F.struct(F.split(a, "\n").alias("a"), F.split(b, "\n").alias("b")), compare)


def training_text(df: DataFrame, weights: DataFrame, prompt: str = "prompt", label: str = "label") -> DataFrame:
    """The answer text and the class weight of every row; ``weights`` is the one row of A9."""
    w = weights.select(F.struct("weight_pos", "weight_neg")).scalar()
    yes = F.col(label) == 1
    return df.withColumns(
        {
            "target": F.when(yes, F.lit(" Yes")).otherwise(F.lit(" No")),
            "text": F.concat(F.col(prompt), F.when(yes, F.lit(" Yes")).otherwise(F.lit(" No"))),
            "weight": F.when(yes, w.getField("weight_pos")).otherwise(w.getField("weight_neg")),
        }
    )

