"""Ordered running sums, ranks and exact percentiles that survive very large groups.

A plain ``row_number() over (partition by key order by ...)`` sends a whole key to one task.  When one key holds a third of a
table (or there is no key at all) that task is the job.  The helpers here cut groups above a fixed number of rows into ordered
ranges of about that number, however large the table is:

1. a hash-chosen sample of the keys (a pure function of the data, so a recomputed task sees the same rows) tells which groups
   are larger than a range; if there are none, the plain window is used;
2. the sample of those groups is ranked by these same helpers, being a fixed factor smaller, and every so-many-th of its rows
   becomes a splitter: so a range has about the same number of rows at any scale;
3. a row finds its range by search in the splitters, which lie in one order of (key, order) for all groups.  Up to ``bounds`` of
   them are broadcast; of more only every so-many-th is, and the others are joined by shuffle, salted;
4. the window runs per (key, range) and the totals of the preceding ranges, summed up by these helpers again, are added back.

Results are exact for any splitters; the sample only decides how evenly the work is spread.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankeval.sources.staging import discard, small, stage, written

_CHUNK = 64  # splitters are searched in two steps: one coarse bound per 64, then inside one chunk


@dataclass(frozen=True)
class RangePlan:
    """``rows`` of a range, about: smaller groups are never cut; ``sample``: sampled rows to a range; ``bounds``: splitters, and
    totals of ranges, that are broadcast."""

    rows: int = 1 << 20
    sample: int = 64
    bounds: int = 1 << 12


PLAN = RangePlan()


def _renamed_keys(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"_{tag}_{i}" for i, k in enumerate(keys)})


def _same_keys(keys: Sequence[str], tag: str) -> Column:
    """Null-safe, so that a hot NULL key is split like any other."""
    return reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{tag}_{i}")) for i, k in enumerate(keys)]
    )


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys in which a null key matches a null key; the left side's keys stay."""
    named = _renamed_keys(right, keys, "j")
    return left.join(named, _same_keys(keys, "j"), how).drop(*[f"_j_{i}" for i in range(len(keys))])


def _hot_bounds(df: DataFrame, by: Sequence[str], order: Sequence[str], depth: int = 0) -> DataFrame | None:
    """Splitters of the groups larger than a range, staged: ``_no`` from 1 in one order for all groups, and ``_o``, the struct of key
    and order columns.  None where no group is that large."""
    plan = PLAN
    every = max(2, plan.rows // plan.sample)
    at = [*by, *order]
    # another hash at each depth: a sample's sample is to be smaller
    sample = df.where(F.pmod(F.xxhash64(F.lit(depth), *at), F.lit(every)) == 0).select(*at).distinct()
    hot = sample.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > plan.sample)
    if hot.isEmpty():
        return None
    if by:
        sample = join_on(sample, hot, by, "left_semi")
    ranked = prefix_sums(stage(sample), by, order, {"_rank": F.lit(1).cast("bigint")}, depth + 1)
    splitters = stage(ranked.where((F.col("_rank") % plan.sample == 0) & (F.col("_rank") > 0)).select(*at))
    numbered = prefix_sums(splitters, [], at, {"_no": F.lit(1).cast("bigint")}, depth + 1)
    return stage(numbered.select((F.col("_no") + 1).alias("_no"), F.struct(*at).alias("_o")))


def _sorted_bounds(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sort_array(F.collect_list(F.struct("_no", "_o"))).alias("_a")).select(F.transform("_a", lambda s: s["_o"]).alias("_a"))


def _not_above(x: Column, bounds: Column) -> Column:
    """Number of sorted ``bounds`` not above ``x``."""
    coarse = F.filter(bounds, lambda b, i: i % _CHUNK == _CHUNK - 1)
    c = F.size(F.filter(coarse, lambda b: b <= x))
    return c * _CHUNK + F.size(F.filter(F.slice(bounds, c * _CHUNK + 1, F.lit(_CHUNK - 1)), lambda b: b <= x))


def _with_buckets(df: DataFrame, by: Sequence[str], order: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Add ``_bucket`` (number of splitters not above the row: groups that are not cut lie in one) and ``_hot`` (its group is cut)."""
    n, most = bounds.count(), PLAN.bounds
    x = F.struct(*by, *order)
    same = lambda o: reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(o[k]) for k in by], F.lit(True))
    step = -(-n // most)
    if step == 1:
        found = df.withColumn("_r_b", _sorted_bounds(bounds).scalar()).withColumn("_bucket", _not_above(x, F.col("_r_b")))
        near = [F.get("_r_b", F.col("_bucket") - 1), F.get("_r_b", F.col("_bucket"))]
    else:
        # every step-th splitter is broadcast; the others, with the ends of their stretch, meet their rows by shuffle
        coarse = _sorted_bounds(bounds.where(F.col("_no") % step == 0))
        first = F.expr(f"_no div {step}")
        ends = F.explode(F.array_distinct(F.array(first, F.when(F.col("_no") % step == 0, first - 1).otherwise(first))))
        fine = bounds.withColumn("_r_c", ends).groupBy("_r_c").agg(F.sort_array(F.collect_list(F.struct("_no", "_o"))).alias("_r_f"))
        fine = fine.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(step - 1))))
        rows = df.withColumn("_r_a", coarse.scalar()).withColumn("_r_c", _not_above(x, F.col("_r_a")).cast("bigint")).drop("_r_a")
        rows = rows.withColumn("_r_salt", F.pmod(F.xxhash64(*by, *order), F.lit(step)).cast("int"))
        found = rows.join(fine, ["_r_c", "_r_salt"], "left").withColumn("_r_b", F.transform("_r_f", lambda s: s["_o"]))
        found = found.withColumn("_r_at", F.size(F.filter("_r_b", lambda b: b <= x)))
        base = F.coalesce(F.get("_r_f", F.lit(0))["_no"] - 1, F.col("_r_c") * step)
        found = found.withColumn("_bucket", (base + F.coalesce("_r_at", F.lit(0))).cast("int"))
        near = [F.get("_r_b", F.col("_r_at") - 1), F.get("_r_b", F.col("_r_at"))]
    hot = reduce(lambda p, q: p | q, [F.coalesce(o.isNotNull() & same(o), F.lit(False)) for o in near])
    return found.withColumn("_hot", hot).select(*df.columns, "_hot", "_bucket")


def prefix_sums(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column | str], depth: int = 0
) -> DataFrame:
    """For every row the sums of ``sums`` over the rows of its group that sort strictly before it.

    ``order`` are names of ascending columns (nulls first); make them a total order of the group, or
    aggregate ties beforehand, if ties must not depend on the input order.  Looking for large groups reads the
    key and order columns of ``df`` once, so hand in a staged table if ``df`` is costly to compute.
    """
    by, order = list(by), list(order)
    cols = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    before = W.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    bounds = _hot_bounds(df, by, order, depth)
    if bounds is None:
        plain = before.partitionBy(*by).orderBy(*order)
        return df.select("*", *[F.coalesce(F.sum(c).over(plain), zero).alias(n) for n, c in cols.items()])
    bucketed = _with_buckets(df, by, order, bounds)
    totals = {f"_t_{depth}_{i}": F.sum(c) for i, c in enumerate(cols.values())}
    parts = stage(bucketed.where("_hot").groupBy(*by, "_bucket").agg(*[c.alias(n) for n, c in totals.items()]))
    own = f"_bucket_{depth}"  # the ranges of these ranges have a bucket too
    offsets = prefix_sums(parts.withColumnRenamed("_bucket", own), by, [own], {f"_off_{i}": n for i, n in enumerate(totals)}, depth + 1)
    offsets = offsets.drop(*totals).withColumnRenamed(own, "_bucket")
    keys = [*by, "_bucket"]
    joined = join_on(bucketed, small(offsets, PLAN.bounds), keys, "left")
    inside = before.partitionBy(*by, "_bucket").orderBy(*order)
    return joined.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(c).over(inside), zero) + F.coalesce(F.col(f"_off_{i}"), zero)).alias(n)
            for i, (n, c) in enumerate(cols.items())
        ],
    )


def ordered_index(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Zero-based position of each row in its group (``row_number() - 1``)."""
    return prefix_sums(df, by, order, {name: F.lit(1).cast("bigint")})


def table_index(df: DataFrame, order: Sequence[str], name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Zero-based position of each row in the whole table, with the columns ``keep`` (all, if not given).

    The table is one group, so no window over it is tried: its rows are written once, dealt to ranges of about ``PLAN.rows`` rows by
    Spark's range partitioning and sorted there.  Rows know their range and their place in it; the sizes of the ranges before it
    are added.  ``df`` is read once.
    """
    kept = [c for c in (df.columns if keep is None else keep)]
    rows = written(df.select(*dict.fromkeys([*kept, *order])), "rows")
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PLAN.rows))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(placed.select(*kept, F.monotonically_increasing_id().alias("_at")), "placed")
    discard(rows)
    # the upper bits of that id tell the range, the others the place in it
    part = F.shiftright("_at", 33)
    sizes = stage(placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")))
    before = prefix_sums(sizes, [], ["_part"], {"_before": "_n"}).drop("_n")
    joined = placed.join(small(before, PLAN.bounds), part == F.col("_part"))
    return joined.select(*kept, (F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).alias(name))


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), name: str = "percentiles", rows: str | None = None,
) -> DataFrame:
    """Exact linear-interpolated percentiles per group, as an array in the order of ``probs``; ``rows`` is the number of rows a
    row of ``df`` stands for when it is already counted.

    Unlike the built-in ``percentile`` no task holds all distinct values of a group: the values are counted,
    ranked by range and only the two rows around each target rank are kept.  Nulls are ignored.
    """
    by = list(by)
    present = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v"))
    counted = stage(present.agg((F.count("*") if rows is None else F.sum(rows)).alias("_c")))
    ranked = prefix_sums(counted, by, ["_v"], {"_c0": "_c"})
    totals = counted.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if by:
        ranked = ranked.join(small(_renamed_keys(totals, by, "n")), _same_keys(by, "n"))
    else:
        ranked = ranked.withColumn("_n", totals.select("_n").scalar())

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_c0") <= rank) & (rank < F.col("_c0") + F.col("_c")), F.col("_v")))

    aggs = []
    for i, p in enumerate(probs):
        rank = (F.col("_n") - 1) * F.lit(float(p))
        lower = F.floor(rank)
        upper = F.least(lower + 1, F.col("_n") - 1)
        aggs += [at(lower).alias(f"_lo{i}"), at(upper).alias(f"_hi{i}"), F.max(rank - lower).alias(f"_w{i}")]
    picked = ranked.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        F.array(
            *[
                F.col(f"_lo{i}") * (1 - F.col(f"_w{i}")) + F.col(f"_hi{i}") * F.col(f"_w{i}")
                for i in range(len(probs))
            ]
        ).alias(name),
    )
