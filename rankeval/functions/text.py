"""Text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# fixed values: the characters a Unicode-aware strip removes
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a one-element ``transform``)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """remove white space of any kind from both ends (``trim`` only removes blanks)."""
    return F.btrim(c, F.lit(WHITE))


def one_line(c: Column) -> Column:
    """F13."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def ellipsize(c: Column, n: int) -> Column:
    """texts above ``n`` code points keep ``n - 1`` of them and an ellipsis."""
    return let(c, lambda t: F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t))


def trim_ts(c: Column) -> Column:
    """"2024-01-02T03:04:05Z" to "2024-01-02 03:04"; null to ""."""
    return F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("T"), F.lit(" ")), 1, 16)


def hang(c: Column, indent: str) -> Column:
    """Indent the second and later lines of a text by ``indent`` in place of their own leading space."""
    lines = F.split(c, "\n")
    rest = F.transform(
        F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1)),
        lambda x: F.concat(F.lit(f"\n{indent}"), F.ltrim(x, F.lit(WHITE))),
    )
    return F.when(F.contains(c, F.lit("\n")), F.concat(F.get(lines, F.lit(0)), F.array_join(rest, ""))).otherwise(c)


def word_count(c: Column) -> Column:
    """The default token counter, runs of non-space characters."""
    return F.regexp_count(c, F.lit(r"\S+"))


# the count of a text is the sum of the counts of its lines
word_count.additive = True


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor empty, else ""."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
