"""The audit makes its rows once, and its tests of counts say what those of rows say."""

import pytest
from pyspark.sql import functions as F

from rankeval.operators import audit, debias, permutation
from tests.test_made_once import counted

DATA = [(i // 5, "st" if i % 3 else "u", f"c{i * i % 4}", i % 5, None if i % 50 == 7 else i * 7 % 3 // 2, i % 11 / 10.0) for i in range(1200)]
COLUMNS = "feed_id int, flight string, kind string, position_rank int, label int, quality double"


def values(df, keys):
    rows = [{k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in df.collect()]
    return sorted(rows, key=lambda r: [str(r[k]) for k in keys])


def test_rows_are_made_once_and_counts_agree_with_rows(spark):
    df, seen = counted(spark, DATA, COLUMNS)
    tag = F.col("flight") == "u"
    parts = audit.unbiasedness_audit(df, tag, "kind", ["quality"], n_perm=20, n_perm_scores=20)
    got = {k: values(v, [c for c in ("slice", "feature", "position_rank") if c in v.columns]) for k, v in parts.items()}
    assert seen.value == len(DATA)
    rows = spark.createDataFrame(DATA, COLUMNS).withColumn("slice", F.when(tag, "tagged").otherwise("rest"))
    assert got["position_ctr"] == values(debias.ctr_curve(rows, ["slice"]), ["slice", "position_rank"])
    assert got["category_coverage"] == values(audit.category_coverage(rows, "kind", ["slice"]), ["slice"])
    want = audit.permutation_mi(rows, "kind", "position_rank", 20, 0, ["slice"]).join(audit.chi_square(rows, "kind", "position_rank", ["slice"]), "slice")
    assert got["category_position"] == values(want, ["slice"])


def test_category_position_and_label_are_read_once(spark):
    """The rows behind the tests of categories and positions are counts: no plan of theirs reads a row of the audit."""
    df = spark.createDataFrame(DATA, COLUMNS)
    parts = audit.unbiasedness_audit(df, F.col("flight") == "u", "kind", ["quality"], n_perm=5, n_perm_scores=5)
    for name in ("category_position", "position_ctr", "category_coverage"):
        assert "audited" not in parts[name]._jdf.queryExecution().optimizedPlan().toString()


def test_replicates_are_spread_over_tasks(spark):
    cells = spark.createDataFrame([(a, b, 1 + a * b) for a in range(3) for b in range(3)], "a int, b int, _c long").withColumn("g", F.lit(0))
    assert permutation._parts(cells, "a", "b", ["g"], 200).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("rows", [None, "n"])
def test_positions_without_labels(spark, rows):
    df = spark.createDataFrame([(0, None, 3), (1, 1, 2), (1, None, 4)], "position_rank int, label int, n long")
    got = {r["position_rank"]: (r["impressions"], r["clicks"]) for r in debias.ctr_by_position(df, rows=rows).collect()}
    assert got == {0: (0, None), 1: ((1, 1) if rows is None else (2, 2))}
