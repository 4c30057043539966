"""Position bias: click-through by position, propensities, and how far a score follows the position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankeval.functions.stats import t_test_p
from rankeval.operators.metrics import ndcg_orders, rank_table
from rankeval.operators.ranges import join_on, prefix_sums
from rankeval.sources.staging import small, stage


def ctr_by_position(
    df: DataFrame, by: Sequence[str] = (), position: str = "position_rank", label: str = "label", rows: str | None = None
) -> DataFrame:
    """A3: impressions, clicks and click-through rate per position; ``rows``: how many rows a row of ``df`` stands for."""
    shown, clicks = F.count(label), F.sum(label)
    if rows is not None:
        shown, clicks = F.sum(F.when(F.col(label).isNotNull(), F.col(rows)).otherwise(0)), F.sum(F.col(label) * F.col(rows))
    return (
        df.groupBy(*by, position)
        .agg(shown.alias("impressions"), clicks.cast("bigint").alias("clicks"))
        .withColumn("ctr", F.col("clicks") / F.col("impressions"))
    )


def ctr_curve(
    df: DataFrame, by: Sequence[str] = (), max_pos: int = 15, min_rows: int = 100,
    position: str = "position_rank", label: str = "label", rows: str | None = None,
) -> DataFrame:
    """A4: rate and count of the first positions, only for groups of at least ``min_rows`` rows; ``rows`` as above."""
    per_pos = stage(ctr_by_position(df, by, position, label, rows))
    sizes = per_pos.groupBy(*by).agg(F.sum("impressions").alias("_n")).where(F.col("_n") >= min_rows)
    if by:
        kept = join_on(per_pos, sizes, list(by), "left_semi")
    else:
        kept = per_pos.where(sizes.select("_n").scalar().isNotNull())
    return kept.where(F.col(position) < max_pos).select(*by, position, "ctr", F.col("impressions").alias("count"))


def mean_score_by_position(df: DataFrame, score: str, by: Sequence[str] = (), position: str = "position_rank") -> DataFrame:
    """A5."""
    return df.groupBy(*by, position).agg(F.avg(score).alias("mean_score"))


def propensity(
    df: DataFrame, fit_on: str = "train", floor: float = 0.05, position: str = "position_rank",
    label: str = "label", split: str = "split",
) -> DataFrame:
    """M4: click-through rate of each position over the best one, clipped to [floor, 1].

    ``fit_on="train"`` uses the rows whose split is "train"; "all" uses every row.
    """
    rows = df.where(F.col(split) == "train") if fit_on == "train" else df
    rates = stage(ctr_by_position(rows, (), position, label))
    best = F.greatest(rates.agg(F.max("ctr")).scalar(), F.lit(1e-6))
    return rates.select(
        position, "ctr", F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col("ctr") / best)).alias("propensity")
    )


def ipw_weight(
    df: DataFrame, propensities: DataFrame, floor: float = 0.05, position: str = "position_rank",
    label: str = "label",
) -> DataFrame:
    """Add ``propensity`` (1 for a position never seen: the best rate is the default) and
    ``ipw_weight`` (1/propensity for clicks, else 1).

    The propensity table has one row per position; it is broadcast if that is few enough.
    """
    table = small(propensities.select(position, F.col("propensity").alias("_p")))
    p = F.greatest(F.lit(floor), F.coalesce("_p", F.lit(1.0)))
    return (
        df.join(table, position, "left")
        .withColumn("propensity", p)
        .drop("_p")
        .withColumn("ipw_weight", F.when(F.col(label) == 1, 1.0 / F.col("propensity")).otherwise(1.0))
    )


def ipw_stats(df: DataFrame, label: str = "label") -> DataFrame:
    """M4: range of the weights and their mean by class."""
    w = F.col("ipw_weight")
    return df.agg(
        F.min(w).alias("min_weight"),
        F.max(w).alias("max_weight"),
        F.avg(F.when(F.col(label) == 1, w)).alias("mean_clicked"),
        F.avg(F.when(F.col(label) == 0, w)).alias("mean_not_clicked"),
    )


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """M9: correlation of average ranks with its two-sided p-value.

    Rows are counted per distinct (a, b) first; the ranks come from the distinct values of each column.
    """
    by = list(by)
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = stage(rows.groupBy(*by, a, b).agg(F.count("*").alias("_c")))
    ranks_a = rank_table(pairs, a, by, F.col("_c")).select(*by, a, F.col("average_rank").alias("_ra"))
    ranks_b = rank_table(pairs, b, by, F.col("_c")).select(*by, b, F.col("average_rank").alias("_rb"))
    return _rank_correlation(join_on(join_on(pairs, ranks_b, [*by, b]), ranks_a, [*by, a]), by)


def _rank_correlation(ranked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correlation of ``_ra`` and ``_rb`` over rows that stand for ``_c`` rows each."""
    c, x, y = F.col("_c").cast("double"), F.col("_ra"), F.col("_rb")
    sums = ranked.groupBy(*by).agg(
        F.sum(c).alias("n"), F.sum(c * x).alias("sx"), F.sum(c * y).alias("sy"),
        F.sum(c * x * x).alias("sxx"), F.sum(c * y * y).alias("syy"), F.sum(c * x * y).alias("sxy"),
    )
    r = F.expr("(n * sxy - sx * sy) / nullif(sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy), 0)")
    out = sums.select(*by, F.col("n").cast("bigint").alias("n"), r.alias("spearman_r"))
    t = F.col("spearman_r") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - F.pow("spearman_r", F.lit(2))))
    return out.withColumn("p_value", t_test_p(t, (F.col("n") - 2).cast("double")))


def linear_r2(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """R squared of a linear fit of ``a`` on ``b``; 0 when ``b`` is constant."""
    x = F.col(b).cast("double")
    r2 = F.pow(F.corr(x, F.col(a).cast("double")), F.lit(2.0))
    return df.groupBy(*by).agg(F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(r2).alias("r2"))


def score_cube(
    df: DataFrame, scores: Mapping[str, str], label: str, position: str, weight: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Counts per (keys, ``model``, ``_score``, position), staged: rows (``_c``), labelled rows by class (``_p``, ``_q``), their
    weights (``_wp``, ``_wq``) and the sum of the labels (``_pc``).  AUCs, rank correlation and fit are read off it."""
    cells = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("_score")) for n, c in scores.items()])
    y, w = F.col("_y"), F.col("_w")
    long = df.select(*by, position, F.col(label).cast("int").alias("_y"), weight.alias("_w"), F.inline(cells))
    return stage(long.groupBy(*by, "model", "_score", position).agg(
        F.count("*").alias("_c"), F.count_if(y == 1).alias("_p"), F.count_if(y != 1).alias("_q"), F.sum("_y").alias("_pc"),
        F.sum(F.when(y == 1, w).otherwise(0)).alias("_wp"), F.sum(F.when(y != 1, w).otherwise(0)).alias("_wq"),
    ))


def _cube_areas_and_ranks(cube: DataFrame, position: str, g: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both AUCs per group, and the average rank (``_rb``) of each score among rows with a position: one order of the distinct scores
    serves all three."""
    ok = F.col("_score").isNotNull() & ~F.isnan("_score") & (F.abs("_score") < float("inf"))
    sums = [F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(c) for c in ("_p", "_q", "_wp", "_wq", "_pc")]
    per_score = stage(cube.where("_score is not null").groupBy(*g, "_score").agg(
        F.sum(F.when(F.col(position).isNotNull(), F.col("_c")).otherwise(0)).alias("_c"), *sums))
    ranked = stage(prefix_sums(per_score, g, ["_score"], {"_below": "_q", "_wbelow": "_wq", "_before": "_c"}))
    area = lambda p, q, below: F.try_divide(
        F.sum(F.col(p).cast("double") * (F.col(below).cast("double") + 0.5 * F.col(q))), F.sum(p).cast("double") * F.sum(q))
    areas = ranked.groupBy(*g).agg(
        F.sum(F.col("_p") + F.col("_q")).alias("n"), F.coalesce(area("_p", "_q", "_below"), F.lit(float("nan"))).alias("raw_auc"),
        F.coalesce(area("_wp", "_wq", "_wbelow"), F.lit(float("nan"))).alias("ipw_auc"))
    return areas, ranked.select(*g, "_score", (F.col("_before") + (F.col("_c") + 1) / 2).alias("_rb"))


def _cube_fit(cube: DataFrame, position: str, g: Sequence[str]) -> DataFrame:
    """M10 from counts, in two passes so that large values lose nothing."""
    c, x, y = F.col("_c").cast("double"), F.col(position).cast("double"), F.col("_score")
    both = cube.where(x.isNotNull() & y.isNotNull())
    mean = both.groupBy(*g).agg((F.sum(c * x) / F.sum(c)).alias("_mx"), (F.sum(c * y) / F.sum(c)).alias("_my"))
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    sums = join_on(both, small(mean), g).groupBy(*g).agg(
        F.sum(c * dx * dx).alias("_xx"), F.sum(c * dy * dy).alias("_yy"), F.sum(c * dx * dy).alias("_xy"))
    spread = cube.groupBy(*g).agg((F.min(x) == F.max(x)).alias("_flat"))
    r2 = F.try_divide(F.col("_xy") * F.col("_xy"), F.col("_xx") * F.col("_yy"))
    return join_on(spread, sums, g, "left").select(*g, F.when(F.col("_flat"), F.lit(0.0)).otherwise(r2).alias("r2"))


def debias_report(
    df: DataFrame, scores: Mapping[str, str] | Sequence[str], feed: str = "feed_id", label: str = "label",
    position: str = "position_rank", by: Sequence[str] = (), k: int = 10,
) -> DataFrame:
    """One row per model (and group) with rank correlation to the position, raw and
    propensity-weighted AUC, NDCG against the display order and r squared on the position.

    ``df`` carries ``propensity`` from :func:`ipw_weight`; every row weighs 1/propensity in the weighted AUC.  Rows are read twice:
    for the cube of counts, and for the gains of the feeds.
    """
    names = dict(scores) if isinstance(scores, Mapping) else {s: s for s in scores}
    by, g = list(by), [*by, "model"]
    narrow = stage(df.select(*by, feed, label, position, "propensity", *dict.fromkeys(names.values())))
    cube = score_cube(narrow, names, label, position, 1.0 / F.col("propensity"), by)
    areas, score_ranks = _cube_areas_and_ranks(cube, position, g)
    pairs = cube.where(F.col("_score").isNotNull() & F.col(position).isNotNull())
    places = rank_table(pairs, position, g, F.col("_c")).select(*g, position, F.col("average_rank").alias("_ra"))
    rank = _rank_correlation(join_on(join_on(pairs, small(places), [*g, position]), score_ranks, [*g, "_score"]), g).drop("n")
    display = "display order"
    gains = stage(ndcg_orders(narrow, feed, label, names | {display: -F.col(position).cast("double")}, k, by))
    shown = gains.where(F.col("order") == display).select(*by, F.col("ndcg").alias("ndcg_display"))
    order = gains.where(F.col("order") != display).select(*by, F.col("order").alias("model"), F.col("ndcg").alias("ndcg_model"))
    out = join_on(join_on(join_on(areas, rank, g, "left"), _cube_fit(cube, position, g), g, "left"), order, g, "left")
    if by:
        out = join_on(out, shown, by, "left")
    else:
        out = out.withColumn("ndcg_display", shown.select("ndcg_display").scalar())
    return out.withColumn("ndcg_delta", F.col("ndcg_model") - F.col("ndcg_display")).withColumn("ipw_auc_delta", F.col("ipw_auc") - F.col("raw_auc"))
