"""Model-free audit of a slice: is what is shown independent of where it is shown?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankeval.functions.stats import chi_square_p
from rankeval.operators.debias import ctr_curve
from rankeval.operators.metrics import unpivot
from rankeval.operators.permutation import null_information
from rankeval.operators.ranges import exact_percentiles, join_on
from rankeval.sources.staging import small, stage, written


def quantile_edges(df: DataFrame, c: str, q: int, by: Sequence[str], rows: str | None = None) -> DataFrame:
    """Inner edges (``_edges``) of quantile bins per group, repeated ones merged; ``rows``: how many rows a row stands for."""
    edges = exact_percentiles(df, c, [i / q for i in range(q + 1)], by, "_edges", rows)
    inner = F.array_distinct("_edges")
    return edges.select(*by, F.slice(inner, F.lit(2), F.greatest(F.lit(0), F.size(inner) - 2)).alias("_edges"))


def binned(df: DataFrame, c: str, edges: DataFrame, by: Sequence[str], name: str = "bin") -> DataFrame:
    """The number of edges below each value."""
    x = F.col(c).cast("double")
    if by:
        joined = join_on(df, small(edges), by, "left")
    else:
        joined = df.withColumn("_edges", edges.select("_edges").scalar())
    below = F.size(F.filter("_edges", lambda e: e < x))
    return joined.withColumn(name, F.when(x.isNotNull(), below)).drop("_edges")


def quantile_bins(df: DataFrame, c: str, q: int = 8, by: Sequence[str] = (), name: str = "bin") -> DataFrame:
    """Right-closed quantile bins with repeated edges merged, so that ties share a bin."""
    by = list(by)
    return binned(df, c, quantile_edges(df, c, q, by), by, name)


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Counts of value pairs with both margins and the total; margins are joined, never collected.  A null is a value like any
    other.  ``rows``: how many rows a row of ``df`` stands for."""
    by = list(by)
    cells = stage(df.groupBy(*by, a, b).agg((F.count("*") if rows is None else F.sum(rows)).alias("n_ab")))
    na = cells.groupBy(*by, a).agg(F.sum("n_ab").alias("n_a"))
    nb = cells.groupBy(*by, b).agg(F.sum("n_ab").alias("n_b"))
    out = join_on(join_on(cells, nb, [*by, b]), na, [*by, a])
    total = cells.groupBy(*by).agg(F.sum("n_ab").alias("n"))
    return join_on(out, total, by) if by else out.withColumn("n", total.select("n").scalar())


def mutual_information(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Mutual information of two categorical columns in nats."""
    return _information(contingency(df, a, b, by), by)


def _information(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    p = F.col("n_ab") / F.col("n")
    ratio = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return cells.groupBy(*by).agg(F.sum(p * F.log(ratio)).alias("mi"), F.max("n").alias("n"))


def chi_square(df: DataFrame, a: str, b: str, by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """Chi-square test of independence, continuity-corrected only for a 2 x 2 table; ``rows``: how many rows a row of ``df``
    stands for."""
    by = list(by)
    cells = stage(contingency(df, a, b, by, rows))
    expected = F.col("n_a").cast("double") * F.col("n_b") / F.col("n")
    stats = cells.groupBy(*by).agg(
        (F.sum(F.col("n_ab").cast("double") * F.col("n_ab") / expected) - F.max("n")).alias("_plain"),
        F.max(F.abs(F.col("n_ab") - expected)).alias("_d"),
        F.max("n").alias("n"),
    )
    ra = cells.groupBy(*by, a).agg(F.max("n_a").alias("m")).groupBy(*by).agg(
        F.count("*").alias("_ka"), F.sum(1.0 / F.col("m")).alias("_ia")
    )
    rb = cells.groupBy(*by, b).agg(F.max("n_b").alias("m")).groupBy(*by).agg(
        F.count("*").alias("_kb"), F.sum(1.0 / F.col("m")).alias("_ib")
    )
    if by:
        joined = join_on(join_on(stats, ra, by), rb, by)
    else:
        joined = stats.withColumn("_a", ra.select(F.struct("_ka", "_ia")).scalar())
        joined = joined.withColumn("_b", rb.select(F.struct("_kb", "_ib")).scalar())
        joined = joined.select("*", "_a.*", "_b.*")
    dof = (F.col("_ka") - 1) * (F.col("_kb") - 1)
    # in a 2 x 2 table all cells miss their expectation by the same amount, and the reciprocals of the
    # expectations add up to n * sum(1/row) * sum(1/column)
    corrected = F.pow(F.col("_d") - F.least(F.lit(0.5), F.col("_d")), F.lit(2.0)) * F.col("n") * F.col("_ia") * F.col("_ib")
    out = joined.select(
        *by, "n", F.when(dof == 1, corrected).otherwise(F.col("_plain")).alias("chi2"), dof.alias("dof")
    )
    return out.withColumn("p_value", F.when(F.col("dof") == 0, 1.0).otherwise(chi_square_p(F.col("chi2"), F.col("dof"))))


def permutation_mi(
    df: DataFrame, a: str, b: str, n: int = 80, seed: int = 0, by: Sequence[str] = (), rows: str | None = None
) -> DataFrame:
    """Mutual information against ``n`` random re-dealings of ``b``, the short dimension: mean, std, z and p.

    The re-dealt tables are drawn from the margins by :mod:`rankeval.operators.permutation`, one law at any size.  ``rows``: how
    many rows a row of ``df`` stands for.
    """
    by = list(by)
    cells = stage(df.groupBy(*by, a, b).agg((F.count("*") if rows is None else F.sum(rows)).alias("n_rows")))
    observed = _information(contingency(cells, a, b, by, "n_rows"), by)
    null = null_information(cells, a, b, n, seed, by, "n_rows").withColumnRenamed("mi", "_null")
    dealt = join_on(null, observed, by) if by else null.withColumn("mi", observed.select("mi").scalar())
    return dealt.groupBy(*by).agg(
        F.max("mi").alias("mi_obs"),
        F.avg("_null").alias("mi_null_mean"),
        (F.stddev_pop("_null") + 1e-12).alias("mi_null_std"),
        ((F.max("mi") - F.avg("_null")) / (F.stddev_pop("_null") + 1e-12)).alias("mi_z"),
        ((F.count_if(F.col("_null") >= F.col("mi")) + 1) / F.lit(n + 1)).alias("mi_perm_p"),
    )


def _binned_features(
    df: DataFrame, features: Sequence[str], by: Sequence[str], position: str, max_pos: int, q: int
) -> DataFrame:
    """Counts (``n_rows``) of (keys, ``feature``, ``bin``, position) over the first positions.

    Rows are counted per value and position before anything is binned, so only distinct values meet the edges.
    """
    long = unpivot(df.where(F.col(position) < max_pos), [*by, position], features)
    g = [*by, "feature"]
    values = written(long.groupBy(*g, "value", position).agg(F.count("*").alias("n_rows")), "values")
    c, v = F.col("_c").cast("double"), F.col("value")
    distinct = written(values.groupBy(*g, "value").agg(F.sum("n_rows").alias("_c")), "distinct")
    spread = distinct.groupBy(*g).agg(
        F.count("*").alias("_distinct"), (F.sum(c * v * v) / F.sum(c) - F.pow(F.sum(c * v) / F.sum(c), F.lit(2.0))).alias("_var")
    )
    usable = small(spread.where((F.col("_distinct") >= 4) & (F.col("_var") >= 1e-18)).select(*g))
    edges = quantile_edges(join_on(distinct, usable, g, "left_semi"), "value", q, g, "_c")
    return binned(join_on(values, usable, g, "left_semi"), "value", edges, g).groupBy(*g, "bin", position).agg(F.sum("n_rows").alias("n_rows"))


def score_position_mi(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = (), position: str = "position_rank",
    max_pos: int = 6, q: int = 8,
) -> DataFrame:
    """Mutual information of binned score features and the position; constant features and features
    with fewer than four values are skipped."""
    counted = _binned_features(df, features, by, position, max_pos, q)
    g = [*by, "feature"]
    return _information(contingency(counted, "bin", position, g, "n_rows"), g)


def category_coverage(df: DataFrame, c: str, by: Sequence[str] = (), min_rows: int = 100, rows: str | None = None) -> DataFrame:
    """Distinct values, entropy in bits, its maximum and ratio, share of the five largest values; ``rows``: how many rows a row
    of ``df`` stands for."""
    by = list(by)
    many = F.count("*") if rows is None else F.sum(rows)
    counts = stage(df.groupBy(*by, F.col(c).cast("string").alias(c)).agg(many.alias("_c")))
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.count("*").alias("n_values"))
    totals = totals.where(F.col("n") >= min_rows)
    if by:
        joined = counts.join(totals, by)
    else:
        joined = counts.withColumn("_t", totals.select(F.struct("n", "n_values")).scalar()).select("_c", c, "_t.*")
        joined = joined.where(F.col("n").isNotNull())
    p = F.col("_c") / F.col("n")
    entropy = joined.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("n_values").alias("n_values"), (-F.sum(p * F.log2(p + 1e-12))).alias("entropy_bits")
    )
    top = counts.withColumn(
        "_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_c"), c))
    ).where("_r <= 5").groupBy(*by).agg(F.sum("_c").alias("_top"))
    out = entropy.join(top, by) if by else entropy.withColumn("_top", top.select("_top").scalar())
    h_max = F.when(F.col("n_values") > 1, F.log2(F.col("n_values").cast("double"))).otherwise(0.0)
    return (
        out.withColumn("entropy_max", h_max)
        .withColumn("entropy_ratio", F.when(F.col("entropy_max") > 0, F.col("entropy_bits") / F.col("entropy_max")))
        .withColumn("top5_share", F.col("_top") / F.col("n"))
        .drop("_top")
    )


def slice_meta(df: DataFrame, by: str, feed: str = "feed_id") -> DataFrame:
    """Rows and distinct feeds of each slice."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.count_distinct(feed).alias("feeds"))


def unbiasedness_audit(
    df: DataFrame, in_slice: Column, category: str, features: Sequence[str], position: str = "position_rank",
    label: str = "label", feed: str = "feed_id", max_pos: int = 6, min_rows: int = 200, n_perm: int = 80,
    n_perm_scores: int = 50,
) -> dict[str, DataFrame]:
    """All tests for a slice and its complement, one DataFrame per test.

    Groups below ``min_rows`` rows are left out of the independence tests.  Rows are made and written once; what asks for category,
    position and label works on their counts.
    """
    rows = df.withColumn("slice", F.when(in_slice, "tagged").otherwise("rest"))
    rows = written(rows.select("slice", feed, category, position, label, *features), "audited")
    meta = stage(slice_meta(rows, "slice", feed))
    large = small(meta.where(F.col("rows") >= min_rows).select("slice"))
    counts = stage(rows.groupBy("slice", category, position, label).agg(F.count("*").alias("n_rows")))
    first = counts.join(large, "slice", "left_semi").where(F.col(position) < max_pos)
    scores = _binned_features(rows.join(large, "slice", "left_semi"), features, ["slice"], position, max_pos, 8)
    return {
        "meta": meta,
        "category_position": permutation_mi(first, category, position, n_perm, 0, ["slice"], "n_rows").join(
            chi_square(first, category, position, ["slice"], "n_rows"), "slice"
        ),
        "score_position": permutation_mi(scores, "bin", position, n_perm_scores, 0, ["slice", "feature"], "n_rows"),
        "position_ctr": ctr_curve(counts, ["slice"], 15, 100, position, label, "n_rows"),
        "category_coverage": category_coverage(counts, category, ["slice"], rows="n_rows"),
    }
