"""Registered queries against their SQL on the smallest tables (all of them: python -m tests.compare)."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "position_rank", "auc_by_slice", "feature_auc_side_by_side", "ndcg_by_slice", "feature_ndcg_report", "debias_report", "quantile_bins", "chi_square",
    "slice_report_overlapping", "model_day_matrix", "latency_summary", "mined_negatives", "negatives_by_ratio_then_fraction", "reconcile_summary",
    "flatten_impressions", "conversation_groups", "full_prompt", "budgeted_prompt", "request_round_trip", "ranked_groups", "score_table",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 2
