"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankeval.sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to its smallest neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    moved = down.join(least, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u <> v")
    return moved.union(least.select(F.col("m").alias("u"), F.col("x").alias("v"))).distinct()


def labels(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` of every node with an edge in ``edges`` (``u``, ``v``); ``comp`` is the component's smallest node.

    Large and small stars in turn until nothing changes, in about as many rounds as the longest path has binary digits.
    Minima are combined before they are shuffled, and no neighbourhood is ever gathered.
    """
    now, seen = stage(edges.where("u <> v").select("u", "v").distinct()), None
    while True:
        now = stage(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(now.select("u", "u").distinct())
