"""Ordering groups of cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankeval.operators.ranges import ordered_index

# fixed values: sources from strongest to weakest, and lower limits of the strength bands
SOURCES = ["inline curation", "user interactions", "chat history"]
STRENGTH_BANDS = [0.9, 0.8]

GROUP_SIGNALS = ["long_term", "short_term", "affinity", "freshness", "importance", "novelty"]
CARD_SIGNALS = ["card_long_term", "card_short_term", "card_affinity", "card_freshness", "card_importance", "card_novelty"]


def source_rank(c: Column) -> Column:
    out = F.lit(len(SOURCES))
    for i, s in reversed(list(enumerate(SOURCES))):
        out = F.when(c == s, i).otherwise(out)
    return out


def strength_band(c: Column) -> Column:
    return F.when(c >= STRENGTH_BANDS[0], 0).when(c >= STRENGTH_BANDS[1], 1).otherwise(2)


def rank_groups(
    cards: DataFrame, request: str = "request_id", group: str = "group_id", card: str = "card_id", max_cards: int = 4,
    group_signals: Sequence[str] = GROUP_SIGNALS, card_signals: Sequence[str] = CARD_SIGNALS,
) -> DataFrame:
    """Place groups inside a request and cards inside their group, at most ``max_cards`` per group.

    Groups go by source, strength band, then the group signals from high to low; cards by their own signals.
    Cards never leave their group.  ``cards`` repeats ``source``, ``strength`` and the group signals on each card.
    """
    first = cards.groupBy(request, group).agg(
        F.min(source_rank(F.col("source"))).alias("_s0"),
        F.min(strength_band(F.col("strength"))).alias("_s1"),
        *[(-F.max(s)).alias(f"_s{i + 2}") for i, s in enumerate(group_signals)],
    )
    order = [f"_s{i}" for i in range(len(group_signals) + 2)]
    placed = ordered_index(first, [request], [*order, group], "group_rank").select(request, group, "group_rank")
    w = W.partitionBy(request, group).orderBy(*[F.desc(s) for s in card_signals], card)
    top = cards.withColumn("card_rank", F.row_number().over(w)).where(F.col("card_rank") <= max_cards)
    return top.join(placed, [request, group]).withColumn("card_rank", F.col("card_rank") - 1)
