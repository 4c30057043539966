"""Tail probabilities for one-row-per-group results; Spark SQL has no special functions for them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz steps)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total / a


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    total = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total * scale


def t_test_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t."""

    @F.pandas_udf("double")
    def tail(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ts, ns in parts:
            yield pd.Series(
                [
                    None if pd.isna(x) or pd.isna(n) or n <= 0 else _incomplete_beta(n / 2, 0.5, n / (n + x * x))
                    for x, n in zip(ts, ns)
                ],
                dtype="float64",
            )

    return tail(t, dof)


def chi_square_p(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square law."""

    @F.pandas_udf("double")
    def tail(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ns in parts:
            yield pd.Series(
                [None if pd.isna(x) or pd.isna(n) or n <= 0 else _upper_gamma(n / 2, x / 2) for x, n in zip(xs, ns)],
                dtype="float64",
            )

    return tail(stat.cast("double"), dof.cast("double"))
