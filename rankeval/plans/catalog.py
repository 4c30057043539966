"""All registered queries."""

from rankeval.plans import data_queries, feed_queries, ranking_queries  # noqa: F401  (these register the queries)
from rankeval.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
