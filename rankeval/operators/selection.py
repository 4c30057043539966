"""The first rows in the order of a text key, without ordering them: the cut is found by narrowing prefixes over counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rankeval.sources.staging import stage

FEW = 65_536  # keys that are ordered to find the cut
ALIKE = 100_000  # equal rows that one task makes


@dataclass(frozen=True)
class Cut:
    """The ``n``-th smallest key, how many keys lie below it and how many are equal to it."""

    key: str
    below: int
    equal: int


def nth_smallest(keys: DataFrame, n: int) -> Cut | None:
    """The ``n``-th smallest (from 1, by code point) of the texts in the only column of ``keys``; None where all fit.

    Texts that begin with the prefix found so far are counted by their next character; the character whose texts hold the
    ``n``-th is added, and what all of those texts share beyond it.  That ends when few texts are left, which are ordered,
    or when they are all equal.  A round collects one row per character in use.
    """
    (name,) = keys.columns
    rows, below, prefix = keys.select(F.col(name).alias("k")), 0, ""
    left = rows.agg(F.count("k")).first()[0]
    if n >= left:
        return None
    while left > FEW:
        ends = rows.agg(F.min("k"), F.max("k")).first()
        shared = 0
        while shared < min(map(len, ends)) and ends[0][shared] == ends[1][shared]:
            shared += 1
        prefix = ends[0][:shared]
        if ends[0] == ends[1]:
            return Cut(prefix, below, left)
        counts = rows.groupBy(F.substring("k", shared + 1, 1).alias("c")).count().collect()  # "" for the prefix itself
        for c, size in sorted((r["c"], r["count"]) for r in counts):
            if below + size >= n:
                break
            below += size
        prefix, left = prefix + c, size
        rows = stage(rows.where(F.col("k").startswith(prefix) if c else F.col("k") == prefix))
    ordered = sorted((r["k"], r["count"]) for r in rows.groupBy("k").count().collect())  # at most FEW
    for key, size in ordered:
        if below + size >= n:
            return Cut(key, below, size)
        below += size
    raise AssertionError("the counts changed between two readings")


def first_by(
    df: DataFrame, key: Column, n: int, make: Callable[[DataFrame], DataFrame] | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The ``n`` rows of ``make(df)`` with the smallest text ``key``; rows that share the last key are taken by their content, and
    equal ones are interchangeable.

    ``key`` is an expression over ``df`` that ``make``, which may drop and widen rows but not add any, keeps as the column ``_key``.
    Rows beyond the cut are filtered before ``make``.  ``keep``, if given, is a cheaper way to the ``_key`` of the rows that ``make``
    does not drop.  A null key counts as empty.
    """
    text = F.coalesce(key.cast("string"), F.lit(""))
    build = make or (lambda rows: rows)
    if n <= 0:
        return build(df.withColumn("_key", text)).drop("_key").limit(0)
    keyed = df.withColumn("_key", text)
    cut = nth_smallest(stage((keep or build)(keyed).select("_key")), n)
    if cut is None:
        return build(keyed).drop("_key")
    if cut.below + cut.equal == n:
        return build(keyed.where(F.col("_key") <= cut.key)).drop("_key")
    some = first_by_content(build(keyed.where(F.col("_key") == cut.key)).drop("_key"), n - cut.below)
    return build(keyed.where(F.col("_key") < cut.key)).drop("_key").unionByName(some)


def first_by_content(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows by the hash of their content; of equal rows at the cut as many as are needed are made from one."""
    # a struct may hold values without an order, its JSON text has one
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    hashed = df.withColumn("_content", content)
    cut = nth_smallest(stage(hashed.select("_content")), n)
    if cut is None:
        return df
    if cut.below + cut.equal == n:
        return hashed.where(F.col("_content") <= cut.key).drop("_content")
    need = n - cut.below
    one = hashed.where(F.col("_content") == cut.key).limit(1)
    blocks = one.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(need - 1), F.lit(ALIKE)))).repartition("_from")
    again = blocks.withColumn("_again", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + ALIKE, F.lit(need)) - 1)))
    return hashed.where(F.col("_content") < cut.key).drop("_content").unionByName(again.drop("_content", "_from", "_again"))
