"""Ranking metrics: AUC, log loss, NDCG, per-feature reports, pair losses, score differences."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankeval.functions.scores import clip, valid_score
from rankeval.operators.ranges import join_on, ordered_index, prefix_sums
from rankeval.operators.sampling import random_scores
from rankeval.sources.staging import small, stage, written

_FEED_ROWS = 1 << 16  # rows of a feed that one task sorts; larger feeds are counted first


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unpivot(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form ``(*keep, feature, value)`` of double feature columns; null counts as 0."""
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value"))
            for f in features
        ]
    )
    return df.select(*keep, F.inline(pairs))


def position_rank(df: DataFrame, feed: str, order_cols: Sequence[str], name: str = "position_rank") -> DataFrame:
    """Zero-based place of a card in its feed; pass enough order columns to make it unique."""
    return ordered_index(df, [feed], order_cols, name)


def rank_by_score(df: DataFrame, feed: str, score: str, ties: Sequence[str], name: str = "score_rank") -> DataFrame:
    """Zero-based place of each candidate of a feed by descending score."""
    keyed = df.withColumn("_neg", -F.col(score).cast("double"))
    return ordered_index(keyed, [feed], ["_neg", *ties], name).drop("_neg")


def rank_table(df: DataFrame, c: str, by: Sequence[str] = (), rows: Column | None = None) -> DataFrame:
    """Distinct values of ``c`` per group with their count and average rank (1-based).

    ``rows`` is the number of rows a row of ``df`` stands for when ``df`` is already counted.
    """
    ties = F.count("*") if rows is None else F.sum(rows)
    counted = stage(df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(ties.alias("ties")))
    ranked = prefix_sums(counted, by, [c], {"_below": "ties"})
    return ranked.withColumn("average_rank", F.col("_below") + (F.col("ties") + 1) / 2).drop("_below")


def average_rank(df: DataFrame, c: str, by: Sequence[str] = (), name: str = "average_rank") -> DataFrame:
    """Every row with the average rank of its value, ties sharing the mean rank."""
    keys = [*by, c]
    return join_on(df, rank_table(df, c, by).select(*keys, F.col("average_rank").alias(name)), keys, "left")


def auc(
    df: DataFrame,
    score: Column | str,
    label: Column | str,
    by: Sequence[str] = (),
    weight: Column | str | None = None,
) -> DataFrame:
    """M1, M5: exact tie-aware ROC AUC per group, NaN when a class is missing.

    Rows are first counted per (group, score); only distinct scores are sorted.  With ``weight`` every
    positive/negative pair counts ``w_pos * w_neg``.  Null labels and null or non-finite scores are left out.
    """
    s, y = _col(score), _col(label)
    w = F.lit(1) if weight is None else _col(weight)
    scored = df.select(*by, s.cast("double").alias("_s"), y.cast("int").alias("_y"), w.alias("_w"))
    counted = stage(
        scored.where(valid_score(F.col("_s")) & F.col("_y").isNotNull())
        .groupBy(*by, "_s")
        .agg(
            F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0)).alias("_p"),
            F.sum(F.when(F.col("_y") == 1, 0).otherwise(F.col("_w"))).alias("_q"),
            F.count("*").alias("_c"),
            F.sum("_y").alias("_pc"),
        )
    )
    ranked = prefix_sums(counted, by, ["_s"], {"_below": "_q"})
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    out = ranked.groupBy(*by).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.sum("_pc"), F.lit(0)).cast("bigint").alias("pos"),
        F.sum(p * (F.col("_below").cast("double") + 0.5 * q)).alias("_u"),
        F.sum(p).alias("_sp"),
        F.sum(q).alias("_sq"),
    )
    area = F.when((F.col("_sp") > 0) & (F.col("_sq") > 0), F.col("_u") / (F.col("_sp") * F.col("_sq")))
    return out.select(
        *by, "n", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.coalesce(area, F.lit(math.nan)).alias("auc")
    )


def _loss(p: Column | str, label: Column | str, eps: float) -> Column:
    """Cross entropy of a row; null without a label or a probability."""
    q = clip(_col(p).cast("double"), eps, 1 - eps)
    return -F.log(F.when(_col(label) == 1, q).when(_col(label) == 0, 1 - q))


def log_loss(
    df: DataFrame, p: Column | str, label: Column | str, by: Sequence[str] = (), eps: float = 1e-6
) -> DataFrame:
    """M3: mean negative log likelihood of clipped probabilities; ``excluded`` rows have no label or no probability."""
    loss = _loss(p, label, eps)
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"), F.count_if(loss.isNull()).alias("excluded"))


def weighted_ce(df: DataFrame, p: Column | str, label: Column | str, weight: Column | str, eps: float = 1e-6) -> DataFrame:
    """Mean of class weight times cross entropy; ``excluded`` as in :func:`log_loss`."""
    loss = _loss(p, label, eps)
    return df.agg(F.avg(_col(weight) * loss).alias("weighted_ce"), F.count_if(loss.isNull()).alias("excluded"))


def _discounts(k: int) -> Column:
    """Sum of the first discounts, at places 0 to ``k``."""
    discounts = [0.0]
    for i in range(k):
        discounts.append(discounts[-1] + 1.0 / math.log2(i + 2))
    return F.array(*[F.lit(d) for d in discounts])


def _top_gain(grouped: DataFrame, keys: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """Discounted gain of the first ``k`` places when groups of tied ``value`` share their mean gain.

    ``grouped`` has one row per (keys, value) with its row count ``_c`` and summed gain ``_g``.  The first
    ``k`` distinct values already cover ``k`` places, so the window keeps at most ``k`` rows per feed on the
    map side before anything is shuffled.
    """
    table = _discounts(k)
    w = W.partitionBy(*keys).orderBy(F.col(value).desc())
    top = grouped.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    start = F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lo = F.least(start, F.lit(k)).cast("int")
    hi = F.least(start + F.col("_c"), F.lit(k)).cast("int")
    return (
        top.withColumn("_d", F.get(table, hi) - F.get(table, lo))
        .groupBy(*keys)
        .agg(F.sum(F.col("_g") / F.col("_c") * F.col("_d")).alias(name))
    )


def _gains(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts (``_c``) and summed labels (``_g``) per (keys, value) of rows counted in ``_c``."""
    return rows.groupBy(*keys, value).agg(F.sum(F.col("_c") * F.col("_y")).alias("_g"), F.sum("_c").alias("_c"))


def ndcg_per_feed(
    df: DataFrame, feed: str, label: str, score: Column | str, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """M6: NDCG@k of every feed with at least two rows and one click; tied scores share their gain.  Rows without a feed id belong
    to no feed; a null group is a group."""
    keys = [*by, feed]
    rows = df.select(*keys, _col(score).cast("double").alias("_s0"), F.col(label).cast("double").alias("_y"))
    gains = _feed_gains(written(rows.where(F.col(feed).isNotNull()), "ranked"), keys, ["_s0"], k)
    return gains.select(*keys, "feed_rows", F.col("_ndcg")[0].alias("ndcg"))


def _feed_gains(rows: DataFrame, keys: Sequence[str], scores: Sequence[str], k: int) -> DataFrame:
    """Per qualifying feed of the staged ``rows``: ``feed_rows`` and ``_ndcg``, the NDCG@k of each order by descending score.

    The rows are dealt by feed once; each order is a sort within the partition.  Feeds above ``_FEED_ROWS`` are counted per distinct
    score first, spread over all tasks.
    """
    large = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > _FEED_ROWS).drop("_n")
    large = small(large)
    if large.isEmpty():
        return _gains_by_window(rows, keys, scores, k)
    few = _gains_by_window(join_on(rows, large, keys, "left_anti"), keys, scores, k)
    return few.unionByName(_gains_by_count(join_on(rows, large, keys, "left_semi"), keys, scores, k))


def _gains_by_window(rows: DataFrame, keys: Sequence[str], scores: Sequence[str], k: int) -> DataFrame:
    table = _discounts(k)
    dcg = []
    for i, s in enumerate([*scores, "_y"]):  # the best order is the one by label
        w = W.partitionBy(*keys).orderBy(F.col(s).desc())
        tied = w.rangeBetween(W.currentRow, W.currentRow)
        rows = rows.withColumns({"_r": F.rank().over(w), "_at": F.row_number().over(w), "_c": F.count("*").over(tied), "_g": F.sum("_y").over(tied)})
        lo, hi = F.least(F.col("_r") - 1, F.lit(k)).cast("int"), F.least(F.col("_r") - 1 + F.col("_c"), F.lit(k)).cast("int")
        gain = F.when(F.col("_at") == F.col("_r"), F.col("_g") / F.col("_c") * (F.get(table, hi) - F.get(table, lo)))
        gone = {"_r", "_at", "_c", "_g", s} - {"_y"}
        rows = rows.select(*[c for c in rows.columns if c not in gone], gain.alias(f"_dcg{i}"))
        dcg.append(F.sum(f"_dcg{i}").alias(f"_dcg{i}"))
    per_feed = rows.groupBy(*keys).agg(F.count("*").alias("feed_rows"), F.sum("_y").alias("_gain"), *dcg)
    best = F.col(f"_dcg{len(scores)}")
    return per_feed.where("feed_rows >= 2 and _gain > 0").select(
        *keys, "feed_rows", F.array(*[F.col(f"_dcg{i}") / best for i in range(len(scores))]).alias("_ndcg")
    )


def _gains_by_count(rows: DataFrame, keys: Sequence[str], scores: Sequence[str], k: int) -> DataFrame:
    by_label = _gains(rows.groupBy(*keys, "_y").agg(F.count("*").alias("_c")), keys, "_y")
    cells = F.array(*[F.struct(F.lit(i).alias("_order"), F.col(s).alias("_s")) for i, s in enumerate(scores)])
    by_score = rows.select(*keys, "_y", F.inline(cells)).groupBy(*keys, "_order", "_s").agg(F.sum("_y").alias("_g"), F.count("*").alias("_c"))
    got = _top_gain(by_score, [*keys, "_order"], "_s", k, "_dcg")
    both = join_on(got, _ideal_gain(by_label, keys, k), keys).withColumn("_one", F.col("_dcg") / F.col("_ideal"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("_order", "_one"))), lambda x: x["_one"])
    return both.groupBy(*keys, "feed_rows").agg(in_order.alias("_ndcg"))


def _ideal_gain(by_label: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``feed_rows`` and the best gain (``_ideal``) of the feeds with at least two rows and one click."""
    eligible = by_label.groupBy(*keys).agg(F.sum("_c").alias("feed_rows"), F.sum("_g").alias("_gain"))
    best = _top_gain(by_label, keys, "_y", k, "_ideal")
    return join_on(eligible.where("feed_rows >= 2 and _gain > 0").drop("_gain"), best, keys)


def ndcg(
    df: DataFrame, feed: str, label: str, score: Column | str, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """M6: mean NDCG@k over the qualifying feeds of each group."""
    per_feed = ndcg_per_feed(df, feed, label, score, k, by)
    return per_feed.groupBy(*by).agg(F.count("*").alias("feeds"), F.avg("ndcg").alias("ndcg"))


def ndcg_orders(
    df: DataFrame, feed: str, label: str, orders: Mapping[str, Column | str], k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """M6 for several orders of the same rows: keys, ``order`` and the mean ``ndcg``.

    The rows of a feed, its clicks and its best gain are the same for all orders and are counted once.
    """
    keys = [*by, feed]
    scores = {f"_s{i}": _col(c).cast("double") for i, c in enumerate(orders.values())}
    rows = df.where(F.col(feed).isNotNull()).select(*keys, F.col(label).cast("double").alias("_y"), *[c.alias(n) for n, c in scores.items()])
    names = F.array(*[F.lit(n) for n in orders])
    cells = _feed_gains(written(rows, "ranked"), keys, list(scores), k).select(*by, F.inline(F.arrays_zip(names.alias("order"), F.col("_ndcg").alias("ndcg"))))
    return cells.groupBy(*by, "order").agg(F.avg("ndcg").alias("ndcg"))


def counterfactual_ndcg(
    df: DataFrame, feed: str, label: str, score: str, position: str, k: int = 10, by: Sequence[str] = ()
) -> DataFrame:
    """M7: NDCG@k of the model order, of the display order, and their difference."""
    orders = {"model": score, "display": -F.col(position).cast("double")}
    return (
        ndcg_orders(df, feed, label, orders, k, by).groupBy(*by)
        .agg(
            F.max(F.when(F.col("order") == "model", F.col("ndcg"))).alias("ndcg_model"),
            F.max(F.when(F.col("order") == "display", F.col("ndcg"))).alias("ndcg_display"),
        )
        .withColumn("ndcg_delta", F.col("ndcg_model") - F.col("ndcg_display"))
    )


def feature_auc(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """M2: each feature alone as a score: auc, lift over 0.5 and its size; 0.5 where nothing varies."""
    long = unpivot(df, [*by, label], features)
    scored = auc(long, "value", label, [*by, "feature"])
    area = F.when(F.isnan("auc"), F.lit(0.5)).otherwise(F.col("auc"))
    return (
        scored.select(*by, "feature", "n", area.alias("auc"))
        .withColumn("lift", F.col("auc") - 0.5)
        .withColumn("abs_lift", F.abs("lift"))
    )


def feature_auc_comparison(df: DataFrame, features: Sequence[str], label: str, in_slice: Column) -> DataFrame:
    """Feature report on all rows next to the same report on a slice.

    One pass: slice rows are counted into both groups; rows come ordered by the size of the full lift.
    """
    groups = F.array_compact(F.array(F.lit("full"), F.when(in_slice, F.lit("slice"))))
    both = feature_auc(df.withColumn("_group", F.explode(groups)), features, label, ["_group"])
    full = both.where("_group = 'full'").drop("_group")
    part = both.where("_group = 'slice'").select(
        "feature", F.col("auc").alias("slice_auc"), F.col("lift").alias("slice_lift")
    )
    return full.join(part, "feature", "left").orderBy(F.desc("abs_lift"), "feature")


def feature_ndcg(
    df: DataFrame, features: Sequence[str], feed: str, label: str, position: str, row_key: Sequence[str],
    k: int = 10, seeds: int = 5,
) -> DataFrame:
    """Every feature as a ranker against the display order and a seeded random order.

    Features that never vary are left out.
    """
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    orders = [*values, -F.col(position).cast("double"), *random_scores(row_key, seeds)]
    scores = [f"_s{i}" for i in range(len(orders))]
    cells = [c.alias(n) for n, c in zip(scores, orders)]
    staged = written(df.select(feed, F.col(label).cast("double").alias("_y"), *cells), "ranked")
    varies = F.array(*[F.min(s) < F.max(s) for s in scores[: len(features)]])
    per_feed = _feed_gains(staged.where(F.col(feed).isNotNull()), [feed], scores, k)
    means = F.array(*[F.avg(F.col("_ndcg")[i]) for i in range(len(scores))])
    total = per_feed.agg(F.count("*").alias("feeds"), means.alias("_m")).where("feeds > 0")
    baseline = F.aggregate(F.slice("_m", len(features) + 2, max(1, seeds)), F.lit(0.0), lambda a, x: a + x) / seeds
    return (
        total.withColumn("_varies", staged.agg(varies.alias("v")).scalar())
        .withColumn("_display", F.col("_m")[len(features)])
        .withColumn("_random", baseline)
        .select("feeds", "_display", "_random", F.inline(F.arrays_zip(
            F.array(*[F.lit(f) for f in features]).alias("feature"), F.slice("_m", 1, len(features)).alias("ndcg"), F.col("_varies").alias("_v"))))
        .where("_v")
        .select(
            "feature",
            "feeds",
            "ndcg",
            (F.col("ndcg") - F.col("_display")).alias("delta_vs_display"),
            (F.col("ndcg") - F.col("_random")).alias("delta_vs_random"),
        )
        .orderBy(F.desc("ndcg"), "feature")
    )


def pair_losses(
    pairs: DataFrame, group: Sequence[str], score: str, is_positive: str, tau: float = 1.0,
    bce_weight: float = 1.0, infonce_weight: float = 1.0,
) -> DataFrame:
    """Mean over anchors of BCE(positive) + mean BCE(negatives) and of InfoNCE at temperature tau.

    ``pairs`` has one row per scored candidate of an anchor, exactly one of them positive.
    """
    s, y = F.col(score), F.col(is_positive).cast("int") == 1
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    top = pairs.groupBy(*group).agg(F.max(s / tau).alias("_top"))
    shifted = pairs.join(top, list(group))
    per_anchor = shifted.groupBy(*group).agg(
        (F.max(F.when(y, softplus(-s))) + F.avg(F.when(~y, softplus(s)))).alias("bce"),
        (F.max("_top") + F.log(F.sum(F.exp(s / tau - F.col("_top")))) - F.max(F.when(y, s / tau))).alias("infonce"),
    )
    return per_anchor.agg(
        F.count("*").alias("anchors"),
        F.avg("bce").alias("bce"),
        F.avg("infonce").alias("infonce"),
        F.avg(F.col("bce") * bce_weight + F.col("infonce") * infonce_weight).alias("total"),
    )


def score_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Both scores of the rows present on both sides, and their difference."""
    left = a.select(*keys, F.col(score).alias("score_a"))
    right = b.select(*keys, F.col(score).alias("score_b"))
    return left.join(right, list(keys)).withColumn("diff", F.col("score_a") - F.col("score_b"))


def score_diff_summary(diffs: DataFrame) -> DataFrame:
    """Score ranges of both sides and the size of the disagreement."""
    return diffs.agg(
        F.count("*").alias("n"),
        F.min("score_a").alias("min_a"),
        F.max("score_a").alias("max_a"),
        F.min("score_b").alias("min_b"),
        F.max("score_b").alias("max_b"),
        F.avg("diff").alias("mean_diff"),
        F.max(F.abs("diff")).alias("max_abs_diff"),
    )
