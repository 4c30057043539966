"""Summaries: splits, funnels, slices, days, models, latency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rankeval.operators.metrics import auc
from rankeval.operators.ranges import exact_percentiles


def _keyed_counts(df: DataFrame, by: Sequence[str], label: str, feed: str, user: str, *extra: Column) -> DataFrame:
    """Rows, clicks and distinct feeds and users per group in one pass.

    Every row counts once under its feed and once under its user; the distinct counts are then counts of those
    keys, so no task sees a whole group.
    """
    keys = F.array(
        F.struct(F.lit("feed").alias("_k"), F.col(feed).cast("string").alias("_v")),
        F.struct(F.lit("user").alias("_k"), F.col(user).cast("string").alias("_v")),
    )
    names = [f"_e{i}" for i in range(len(extra))]
    rows = df.select(*by, F.col(label).alias("_y"), *[c.alias(n) for c, n in zip(extra, names)], F.inline(keys))
    counted = rows.groupBy(*by, "_k", "_v").agg(
        F.count("*").alias("_c"), F.sum("_y").alias("_p"),
        *[f(n).alias(f"{n}{t}") for n in names for f, t in ((F.min, "_lo"), (F.max, "_hi"))],
    )
    is_feed = F.col("_k") == "feed"
    zero = F.lit(0)
    return counted.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(is_feed, F.col("_c"))), zero).alias("n"),
        F.coalesce(F.sum(F.when(is_feed, F.col("_p"))), zero).cast("bigint").alias("pos"),
        F.count_if(is_feed & F.col("_v").isNotNull()).alias("feeds"),
        F.count_if(~is_feed & F.col("_v").isNotNull()).alias("users"),
        *[f(f"{n}{t}").alias(f"{n}{t}") for n in names for f, t in ((F.min, "_lo"), (F.max, "_hi"))],
    )


def split_summary(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", feed: str = "feed_id", user: str = "user_id"
) -> DataFrame:
    """A1: n, pos, neg, ctr, distinct feeds and users."""
    by = list(by)
    return _keyed_counts(df, by, label, feed, user).select(
        *by, "n", "pos", (F.col("n") - F.col("pos")).alias("neg"),
        (F.col("pos") / F.greatest(F.lit(1), F.col("n"))).alias("ctr"), "feeds", "users",
    )


def run_metadata(df: DataFrame, label: str = "label", position: str = "position_rank", feed: str = "feed_id",
                 user: str = "user_id") -> DataFrame:
    """Rows, click rate, position range, sessions, users."""
    return _keyed_counts(df, [], label, feed, user, F.col(position)).select(
        F.col("n").alias("rows"), (F.col("pos") / F.greatest(F.lit(1), F.col("n"))).alias("click_rate"),
        F.col("_e0_lo").alias("min_position"), F.col("_e0_hi").alias("max_position"), F.col("feeds").alias("sessions"), "users",
    )


def slice_names(slices: Mapping[str, Column]) -> Column:
    """Array of the names of all (overlapping) slices a row belongs to."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()]))


def click_session_flag(df: DataFrame, feed: str = "feed_id", label: str = "label", name: str = "click_session") -> DataFrame:
    """Flag the rows of feeds with at least one click.

    A join with the distinct clicked feeds: a window over the feed would put a hot feed into one task.
    """
    clicked = df.where(F.col(label) == 1).select(feed).distinct().withColumn(name, F.lit(True))
    return df.join(clicked, feed, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def slice_report(
    df: DataFrame, slices: Mapping[str, Column], score: str, label: str = "label"
) -> DataFrame:
    """Counts, rate and AUC of overlapping slices in one pass; empty slices give zeros and NaN."""
    tagged = df.withColumn("split", F.explode(slice_names(slices)))
    scored = auc(tagged, score, label, ["split"])
    names = F.explode(F.array(*[F.lit(n) for n in slices]))
    all_names = df.sparkSession.range(1).select(names.alias("split"))
    return all_names.join(scored, "split", "left").select(
        "split",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "pos", "neg")],
        (F.coalesce("pos", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("n", F.lit(0)))).alias("ctr"),
        F.coalesce("auc", F.lit(float("nan"))).alias("auc"),
    )


def daily_auc(
    scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label", day: str = "bizdate",
    only_tagged: bool = False, overall: bool = True,
) -> DataFrame:
    """AUC per day (first eight characters of the date) with the overall row, day "OVERALL"."""
    rows = scores.where(F.col("is_tagged") == 1) if only_tagged else scores
    d = F.substring(F.coalesce(F.col(day), F.lit("")), 1, 8)
    days = F.array(d, F.lit("OVERALL")) if overall else F.array(d)
    out = auc(rows.select(*by, score, label, F.explode(days).alias("day")), score, label, [*by, "day"])
    return out.withColumn("ctr", F.col("pos") / F.greatest(F.lit(1), F.col("n")))


def model_day_matrix(
    scores: DataFrame, models: Sequence[str], model: str = "model", score: str = "score", label: str = "label",
    day: str = "bizdate",
) -> DataFrame:
    """One row per day seen by any model, one AUC column per model, null where a model has no rows."""
    table = daily_auc(scores, [model], score, label, day)
    return table.groupBy("day").pivot(model, list(models)).agg(F.first("auc"))


def latency_summary(
    calls: DataFrame, by: Sequence[str] = (), elapsed_s: str | None = None, elapsed: str = "elapsed_ms",
    service: Sequence[str] = (),
) -> DataFrame:
    """Per level requests, success, failure, rate, latency statistics, queries per second, status counts.

    ``service`` names nullable server-side timings summarised by average, p50 and p95 without their nulls.
    Percentiles are exact and interpolated, 0 when there is nothing to summarise.
    """
    by = list(by)
    # per status first: the totals and the status counts come from the same small table
    per_status = calls.groupBy(*by, "status").agg(
        F.count("*").alias("_c"), F.count_if("ok").alias("_ok"), F.sum(elapsed).alias("_sum"), F.count(elapsed).alias("_n"),
        F.min(elapsed).alias("_min"), F.max(elapsed).alias("_max"),
        *([F.max(elapsed_s).alias("_wall")] if elapsed_s else []),
        *[f(s).alias(f"_{s}_{t}") for s in service for f, t in ((F.sum, "sum"), (F.count, "n"))],
    )
    statuses = F.sort_array(F.collect_list(F.struct(F.col("status").cast("string"), "_c")))
    base = per_status.groupBy(*by).agg(
        F.sum("_c").alias("requests"),
        F.sum("_ok").alias("success"),
        (F.sum("_sum") / F.sum("_n")).alias("avg_ms"),
        F.min("_min").alias("min_ms"),
        F.max("_max").alias("max_ms"),
        *([F.max("_wall").alias("_wall")] if elapsed_s else []),
        *[F.coalesce(F.try_divide(F.sum(f"_{s}_sum"), F.sum(f"_{s}_n")), F.lit(0.0)).alias(f"{s}_avg") for s in service],
        F.to_json(F.map_from_entries(statuses)).alias("status_counts"),
    )
    base = base.withColumn("failure", F.col("requests") - F.col("success")).withColumn(
        "failure_rate", F.col("failure") / F.col("requests")
    )
    if elapsed_s:
        base = base.withColumn("qps", F.when(F.col("_wall") > 0, F.col("requests") / F.col("_wall")).otherwise(0.0))
        base = base.drop("_wall")
    timings = F.array(
        *[F.struct(F.lit(s).alias("_metric"), F.col(s).cast("double").alias("_t")) for s in [elapsed, *service]]
    )
    probs = [0.5, 0.9, 0.95, 0.99]
    table = exact_percentiles(calls.select(*by, F.inline(timings)), "_t", probs, [*by, "_metric"], "_p")

    def value(metric: str, i: int, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_metric") == metric, F.get("_p", F.lit(i)))), F.lit(0.0)).alias(name)

    pct = table.groupBy(*by).agg(
        *[value(elapsed, i, f"p{round(p * 100)}_ms") for i, p in enumerate(probs)],
        *[value(s, i, f"{s}_p{round(probs[i] * 100)}") for s in service for i in (0, 2)],
    )
    if by:
        return base.join(pct, by, "left")
    names = pct.columns
    return base.withColumn("_p", pct.select(F.struct(*names)).scalar()).select(*base.columns, *[F.col(f"_p.{n}") for n in names])


def sweep_cutoff(
    levels: DataFrame, level: str = "concurrency", max_fail: float = 0.05, max_p95: float = 30000.0
) -> DataFrame:
    """Levels in order up to and including the first that fails too often or is too slow."""
    bad = (F.col("failure_rate") > max_fail) | (F.col("p95_ms") > max_p95)
    first_bad = levels.where(bad).agg(F.min(level)).scalar()
    return levels.where(first_bad.isNull() | (F.col(level) <= first_bad)).orderBy(level)


def label_union(frames: Mapping[str, DataFrame], name: str = "name") -> DataFrame:
    """U4: result tables under each other, every row labelled with its table."""
    parts = [f.select(F.lit(label).alias(name), "*") for label, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def report_json(df: DataFrame, digits: int = 6) -> DataFrame:
    """one JSON text per row, doubles rounded."""
    cols = [
        F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema
    ]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))
