"""Columns that turn model output into scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    """F10; null and NaN stay without a value."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def valid_score(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def parse_number_score(c: Column) -> Column:
    """first number of the fixed pattern below in generated text; null above 1 or without a match.

    "2.5" gives 0.5 and "10" gives 1: the pattern takes the first fitting run of characters.
    """
    # fixed pattern
    pattern = r"([01]?\.\d+|[01](?:\.0+)?)"
    value = F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    number = value.cast("double")
    return F.when((number >= 0) & (number <= 1), number)


def parse_yes_no(c: Column) -> Column:
    """1.0 when the trimmed lower-cased text starts with "yes", 0.0 with "no", else 0.5."""
    t = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+", ""))
    return F.when(t.startswith("yes"), 1.0).when(t.startswith("no"), 0.0).otherwise(0.5)


def two_class_prob(yes: Column, no: Column) -> Column:
    """softmax probability of the first of two logits, shifted by the larger one."""
    top = F.greatest(yes, no)
    return F.exp(yes - top) / (F.exp(yes - top) + F.exp(no - top))


def three_class(good: Column, fair: Column, bad: Column, threshold: float = 0.41) -> Column:
    """F8: struct(prob, pred) of p(good) + 0.5 p(fair) over three logits."""
    top = F.greatest(good, fair, bad)
    g, f, b = (F.exp(x - top) for x in (good, fair, bad))
    p = (g + 0.5 * f) / (g + f + b)
    return F.struct(p.alias("prob"), (p >= threshold).cast("int").alias("pred"))


def neutral_fallback(score: Column, neutral: float = 0.5) -> Column:
    """struct(score, failed): the neutral score where scoring gave nothing."""
    return F.struct(F.coalesce(score, F.lit(neutral)).alias("score"), score.isNull().alias("failed"))
