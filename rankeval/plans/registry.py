"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """doubles rounded for comparison and export."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
