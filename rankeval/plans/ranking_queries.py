"""Metrics, bias and audit queries over the impressions view."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankeval.operators import audit, debias, metrics, permutation, ranges, reports, sampling
from rankeval.plans.registry import query, rounded
from rankeval.sources.staging import stage
from rankeval.plans.views import (
    FEATURES, IMPRESSIONS_SQL, POSITION_ORDER, ROW_KEY, TAG, impressions, ranked_impressions, table,
)

IMP = "WITH " + IMPRESSIONS_SQL
SLICE = "CASE WHEN contains(flight_ids,'URGENT') THEN 'tagged' ELSE 'rest' END"


def tagged(df):
    return df.withColumn("slice", F.when(F.col("flight_ids").contains(TAG), "tagged").otherwise("rest"))


def features_sql(cols="*", src="imp"):
    return "(" + " UNION ALL ".join(
        f"SELECT {cols}, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src}" for f in FEATURES
    ) + ")"


def auc_sql(src, by, score, label="label", weight="1"):
    """SQL text: AUC per group from counts per score."""
    g = ", ".join(by)
    part = f"PARTITION BY {g}" if by else ""
    grp = f"GROUP BY {g}" if by else ""
    sel = f"{g}, " if by else ""
    return f"""(SELECT {sel}sum(c)::BIGINT AS n, sum(pc)::BIGINT AS pos, (sum(c)-sum(pc))::BIGINT AS neg,
      CASE WHEN sum(p)>0 AND sum(q)>0 THEN sum(p*(below+0.5*q))/(sum(p)*sum(q)) ELSE 'nan'::DOUBLE END AS auc FROM
      (SELECT *, coalesce(sum(q) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM
       (SELECT {sel}{score} AS s, sum(({weight})*{label})::DOUBLE AS p, sum(({weight})*(1-{label}))::DOUBLE AS q, count(*) AS c,
               sum({label}) AS pc FROM {src} GROUP BY {sel}{score})) {grp})"""


def ndcg_sql(src, keys, feed, score, label="label", k=10):
    """SQL text: per-feed NDCG@k, ties share their mean gain (expands the places of every tie)."""
    g = ", ".join([*keys, feed])
    return f"""(SELECT {g}, sum(CASE WHEN rk<={k} THEN gain/log2(rk+1) ELSE 0 END)/sum(CASE WHEN ik<={k} THEN {label}/log2(ik+1) ELSE 0 END) AS ndcg
      FROM (SELECT {g}, {label}, avg({label}::DOUBLE) OVER (PARTITION BY {g}, s) AS gain,
              row_number() OVER (PARTITION BY {g} ORDER BY s DESC) AS rk,
              row_number() OVER (PARTITION BY {g} ORDER BY {label} DESC) AS ik
            FROM (SELECT *, {score} AS s FROM {src})) GROUP BY {g} HAVING count(*)>=2 AND sum({label})>0)"""


@query("position_rank", f"{IMP} SELECT feed_id, section_index, item_id, supp_id, ship_day, position_rank FROM imp")
def _(spark, sf):
    return ranked_impressions(spark, sf).select(
        "feed_id", "section_index", "item_id", "supp_id", "ship_day", "position_rank"
    )


@query("average_rank", f"""{IMP} SELECT DISTINCT slice, quality, rank() OVER (PARTITION BY slice ORDER BY quality)
  + (count(*) OVER (PARTITION BY slice, quality)-1)/2.0::DOUBLE AS average_rank FROM (SELECT *, {SLICE} AS slice FROM imp)""")
def _(spark, sf):
    df = tagged(impressions(spark, sf)).select("slice", "quality")
    return metrics.average_rank(df, "quality", ["slice"]).distinct()


@query("candidate_rank_by_score", f"""{IMP} SELECT feed_id, section_index, item_id, supp_id, ship_day,
  row_number() OVER (PARTITION BY feed_id ORDER BY novelty DESC, section_index, item_id, supp_id, ship_date)-1 AS score_rank FROM imp""")
def _(spark, sf):
    out = metrics.rank_by_score(impressions(spark, sf), "feed_id", "novelty", POSITION_ORDER)
    return out.select("feed_id", "section_index", "item_id", "supp_id", "ship_day", "score_rank")


@query("auc_by_slice", f"""{IMP} SELECT slice, n, pos, neg, round(auc,6) AS auc FROM
  {auc_sql(f'(SELECT *, {SLICE} AS slice FROM imp)', ['slice'], 'quality')}""")
def _(spark, sf):
    return rounded(metrics.auc(tagged(impressions(spark, sf)), "quality", "label", ["slice"]), ["auc"])


@query("auc_overall_many_scores", f"{IMP} SELECT n, pos, neg, round(auc,6) AS auc FROM {auc_sql('imp', [], 'novelty')}")
def _(spark, sf):
    return rounded(metrics.auc(impressions(spark, sf), "novelty", "label"), ["auc"])


# a probability that some rows do not have, as a null or as NaN
PROBABILITY_SQL = "CASE WHEN item_id%7<>0 AND item_id%11<>0 THEN greatest(1e-6, least(1-1e-6, click_likelihood/50)) END"


def probability():
    some = F.when(F.col("item_id") % 7 != 0, F.col("click_likelihood") / 50)
    return F.when(F.col("item_id") % 11 == 0, float("nan")).otherwise(some)


@query("log_loss_by_slice", f"""{IMP} SELECT slice, round(avg(-ln(CASE WHEN label=1 THEN p ELSE 1-p END)),6) AS log_loss, count(*) FILTER (p IS NULL) AS excluded FROM
  (SELECT *, {SLICE} AS slice, {PROBABILITY_SQL} AS p FROM imp) GROUP BY slice""")
def _(spark, sf):
    df = tagged(impressions(spark, sf)).withColumn("p", probability())
    return rounded(metrics.log_loss(df, "p", "label", ["slice"]), ["log_loss"])


@query("weighted_cross_entropy", f"""{IMP}, w AS (SELECT sum(label) AS pos, sum(1-label) AS neg FROM imp)
  SELECT round(avg((CASE WHEN label=1 THEN (pos+neg)/(2.0::DOUBLE*pos) ELSE (pos+neg)/(2.0::DOUBLE*neg) END)*
    -ln(CASE WHEN label=1 THEN p ELSE 1-p END)),6) AS weighted_ce, count(*) FILTER (p IS NULL) AS excluded FROM
  (SELECT *, {PROBABILITY_SQL} AS p FROM imp), w""")
def _(spark, sf):
    df = impressions(spark, sf).select("label", probability().alias("p"))
    w = sampling.class_weights(df).select(F.struct("weight_pos", "weight_neg")).scalar()
    df = df.withColumn("_w", w).withColumn(
        "weight", F.when(F.col("label") == 1, F.col("_w.weight_pos")).otherwise(F.col("_w.weight_neg"))
    )
    return rounded(metrics.weighted_ce(df, "p", "label", "weight"), ["weighted_ce"])


@query("feature_auc_by_slice", f"""{IMP} SELECT slice, feature, n, round(auc,6) AS auc, round(auc-0.5,6) AS lift, round(abs(auc-0.5),6) AS abs_lift
  FROM {auc_sql(features_sql(f'{SLICE} AS slice, label'), ['slice', 'feature'], 'value')}""")
def _(spark, sf):
    out = metrics.feature_auc(tagged(impressions(spark, sf)), FEATURES, "label", ["slice"])
    return rounded(out, ["auc", "lift", "abs_lift"])


@query("feature_auc_side_by_side", f"""{IMP} SELECT f.feature, f.n, round(f.auc,6) AS auc, round(f.auc-0.5,6) AS lift,
    round(abs(f.auc-0.5),6) AS abs_lift, round(s.auc,6) AS slice_auc, round(s.auc-0.5,6) AS slice_lift
  FROM {auc_sql(features_sql('label'), ['feature'], 'value')} f LEFT JOIN
       {auc_sql(features_sql('label', "(SELECT * FROM imp WHERE contains(flight_ids,'URGENT'))"), ['feature'], 'value')} s ON f.feature=s.feature""")
def _(spark, sf):
    df = impressions(spark, sf)
    out = metrics.feature_auc_comparison(df, FEATURES, "label", F.col("flight_ids").contains(TAG))
    return rounded(out, ["auc", "lift", "abs_lift", "slice_auc", "slice_lift"])


@query("ndcg_by_slice", f"""{IMP} SELECT slice, count(*) AS feeds, round(avg(ndcg),6) AS ndcg FROM
  {ndcg_sql(f'(SELECT *, {SLICE} AS slice FROM imp)', ['slice'], 'feed_id', 'quality')} GROUP BY slice""")
def _(spark, sf):
    df = tagged(impressions(spark, sf))
    return rounded(metrics.ndcg(df, "feed_id", "label", "quality", 10, ["slice"]), ["ndcg"])


@query("counterfactual_ndcg", f"""{IMP} SELECT round(m,6) AS ndcg_model, round(d,6) AS ndcg_display, round(m-d,6) AS ndcg_delta FROM
  (SELECT avg(ndcg) AS m FROM {ndcg_sql('imp', [], 'feed_id', 'quality')}), (SELECT avg(ndcg) AS d FROM {ndcg_sql('imp', [], 'feed_id', '-position_rank')})""")
def _(spark, sf):
    out = metrics.counterfactual_ndcg(ranked_impressions(spark, sf), "feed_id", "label", "quality", "position_rank")
    return rounded(out, ["ndcg_model", "ndcg_display", "ndcg_delta"])


RANDOM_SQL = "('0x'||substr(md5('42|'||seed||'|'||feed_id||'|'||section_index||'|'||item_id||'|'||supp_id||'|'||ship_day),1,15))::BIGINT"


@query("feature_ndcg_report", f"""{IMP}, per_feature AS (SELECT feature, count(*) AS feeds, avg(ndcg) AS ndcg FROM
    {ndcg_sql(features_sql('feed_id, label'), ['feature'], 'feed_id', 'value')} GROUP BY feature),
  display AS (SELECT avg(ndcg) AS d FROM {ndcg_sql('imp', [], 'feed_id', '-position_rank')}),
  rnd AS (SELECT avg(a) AS r FROM (SELECT seed, avg(ndcg) AS a FROM
    {ndcg_sql('(SELECT * FROM imp, range(5) t(seed))', ['seed'], 'feed_id', RANDOM_SQL)} GROUP BY seed))
  SELECT feature, feeds, round(ndcg,6) AS ndcg, round(ndcg-d,6) AS delta_vs_display, round(ndcg-r,6) AS delta_vs_random
  FROM per_feature, display, rnd""")
def _(spark, sf):
    out = metrics.feature_ndcg(ranked_impressions(spark, sf), FEATURES, "feed_id", "label", "position_rank", ROW_KEY)
    return rounded(out, ["ndcg", "delta_vs_display", "delta_vs_random"])


@query("ctr_by_position", f"""{IMP} SELECT position_rank, count(*) AS impressions, sum(label)::BIGINT AS clicks,
  round(sum(label)/count(*),6) AS ctr FROM imp GROUP BY position_rank""")
def _(spark, sf):
    return rounded(debias.ctr_by_position(ranked_impressions(spark, sf)), ["ctr"])


@query("ctr_curve_by_slice", f"""{IMP}, s AS (SELECT *, {SLICE} AS slice FROM imp)
  SELECT slice, position_rank, round(avg(label),6) AS ctr, count(*) AS count FROM s
  WHERE slice IN (SELECT slice FROM s GROUP BY slice HAVING count(*)>=100) AND position_rank<15 GROUP BY slice, position_rank""")
def _(spark, sf):
    return rounded(debias.ctr_curve(tagged(ranked_impressions(spark, sf)), ["slice"]), ["ctr"])


@query("mean_score_by_position", f"{IMP} SELECT position_rank, round(avg(quality),6) AS mean_score FROM imp GROUP BY position_rank")
def _(spark, sf):
    return rounded(debias.mean_score_by_position(ranked_impressions(spark, sf), "quality"), ["mean_score"])


SPLIT_SQL = "CASE WHEN ('0x'||substr(md5('42|'||feed_id),1,8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END"
PROP_SQL = f"""{IMP}, s AS (SELECT *, {SPLIT_SQL} AS split FROM imp),
  rates AS (SELECT position_rank, avg(label) AS ctr FROM s WHERE split='train' GROUP BY position_rank),
  prop AS (SELECT position_rank, ctr, greatest(0.05, least(1.0, ctr/greatest(1e-6,(SELECT max(ctr) FROM rates)))) AS propensity FROM rates),
  w AS (SELECT s.*, greatest(0.05, coalesce(propensity,1.0)) AS propensity, CASE WHEN label=1 THEN 1.0/greatest(0.05, coalesce(propensity,1.0)) ELSE 1.0 END AS ipw_weight
        FROM s LEFT JOIN prop USING (position_rank))"""


def weighted_rows(spark, sf):
    # the propensities and the weighted rows both read the ranked rows, of which the reports need these columns
    narrow = ranked_impressions(spark, sf).select("feed_id", "flight_ids", "label", "position_rank", "quality", "click_likelihood")
    df = stage(sampling.split_by(narrow, "feed_id"))
    return debias.ipw_weight(df, debias.propensity(df))


@query("position_propensity", f"{PROP_SQL} SELECT position_rank, round(ctr,6) AS ctr, round(propensity,6) AS propensity FROM prop")
def _(spark, sf):
    df = sampling.split_by(ranked_impressions(spark, sf), "feed_id")
    return rounded(debias.propensity(df), ["ctr", "propensity"])


@query("ipw_weight_stats", f"""{PROP_SQL} SELECT round(min(ipw_weight),6) AS min_weight, round(max(ipw_weight),6) AS max_weight,
  round(avg(CASE WHEN label=1 THEN ipw_weight END),6) AS mean_clicked, round(avg(CASE WHEN label=0 THEN ipw_weight END),6) AS mean_not_clicked FROM w""")
def _(spark, sf):
    return rounded(debias.ipw_stats(weighted_rows(spark, sf)), ["min_weight", "max_weight", "mean_clicked", "mean_not_clicked"])


@query("ipw_weighted_auc", f"""{PROP_SQL} SELECT split, n, pos, neg, round(auc,6) AS auc FROM {auc_sql('w', ['split'], 'quality', weight='1.0/propensity')}""")
def _(spark, sf):
    df = weighted_rows(spark, sf).withColumn("w", 1.0 / F.col("propensity"))
    return rounded(metrics.auc(df, "quality", "label", ["split"], weight="w"), ["auc"])


SPEAR_SQL = """SELECT model, count(*) AS n, round(corr(ra, rb),6) AS spearman_r FROM (SELECT model,
  rank() OVER (PARTITION BY model ORDER BY position_rank) + (count(*) OVER (PARTITION BY model, position_rank)-1)/2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score)-1)/2.0::DOUBLE AS rb FROM {src}) GROUP BY model"""


def scored_long(df):
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("score")) for m in ("quality", "click_likelihood")])
    return df.select("*", F.inline(cells))


LONG_SQL = "(SELECT *, 'quality' AS model, quality::DOUBLE AS score FROM {s} UNION ALL SELECT *, 'click_likelihood', click_likelihood::DOUBLE FROM {s})"


@query("spearman_position_score", f"{IMP} {SPEAR_SQL.format(src=LONG_SQL.format(s='imp'))}")
def _(spark, sf):
    df = scored_long(ranked_impressions(spark, sf))
    return rounded(debias.spearman(df, "position_rank", "score", ["model"]).drop("p_value"), ["spearman_r"])


@query("linear_r2", f"{IMP} SELECT model, round(pow(corr(position_rank::DOUBLE, score),2),6) AS r2 FROM {LONG_SQL.format(s='imp')} GROUP BY model")
def _(spark, sf):
    return rounded(debias.linear_r2(scored_long(ranked_impressions(spark, sf)), "score", "position_rank", ["model"]), ["r2"])


@query("debias_report", f"""{PROP_SQL}, t AS (SELECT * FROM w WHERE split='test'), l AS {LONG_SQL.format(s='t')},
  sp AS ({SPEAR_SQL.format(src='l')}),
  ra AS (SELECT * FROM {auc_sql('l', ['model'], 'score')}), wa AS (SELECT * FROM {auc_sql('l', ['model'], 'score', weight='1.0/propensity')}),
  nm AS (SELECT model, avg(ndcg) AS m FROM {ndcg_sql('l', ['model'], 'feed_id', 'score')} GROUP BY model),
  nd AS (SELECT model, avg(ndcg) AS d FROM {ndcg_sql('l', ['model'], 'feed_id', '-position_rank')} GROUP BY model),
  r2 AS (SELECT model, round(pow(corr(position_rank::DOUBLE, score),2),6) AS r2 FROM l GROUP BY model)
  SELECT model, ra.n, round(ra.auc,6) AS raw_auc, round(wa.auc,6) AS ipw_auc, round(wa.auc-ra.auc,6) AS ipw_auc_delta, spearman_r, r2,
    round(m,6) AS ndcg_model, round(d,6) AS ndcg_display, round(m-d,6) AS ndcg_delta
  FROM ra JOIN wa USING (model) JOIN sp USING (model) JOIN nm USING (model) JOIN nd USING (model) JOIN r2 USING (model)""")
def _(spark, sf):
    df = weighted_rows(spark, sf).where("split = 'test'")
    out = debias.debias_report(df, ["quality", "click_likelihood"]).drop("p_value")
    return rounded(out, ["raw_auc", "ipw_auc", "ipw_auc_delta", "spearman_r", "r2", "ndcg_model", "ndcg_display", "ndcg_delta"])


# a third of the priorities has no slice at all; the SQL side gives it a name until the end
NULL_SLICE_SQL = "CASE WHEN contains(flight_ids,'URGENT') THEN 'tagged' WHEN contains(flight_ids,'LOW') THEN 'none' ELSE 'rest' END"


def with_null_slice(df):
    none = F.when(F.col("flight_ids").contains("LOW"), F.lit(None))
    return df.withColumn("slice", F.when(F.col("flight_ids").contains(TAG), "tagged").otherwise(none.otherwise("rest")))


@query("ndcg_with_null_slice", f"""{IMP} SELECT nullif(slice,'none') AS slice, count(*) AS feeds, round(avg(ndcg),6) AS ndcg FROM
  {ndcg_sql(f'(SELECT *, {NULL_SLICE_SQL} AS slice FROM imp)', ['slice'], 'feed_id', 'quality')} GROUP BY slice""")
def _(spark, sf):
    df = with_null_slice(impressions(spark, sf))
    return rounded(metrics.ndcg(df, "feed_id", "label", "quality", 10, ["slice"]), ["ndcg"])


@query("debias_report_with_null_slice", f"""{PROP_SQL}, t AS (SELECT *, {NULL_SLICE_SQL} AS slice FROM w WHERE split='test'), l0 AS {LONG_SQL.format(s='t')},
  l AS (SELECT * EXCLUDE model, slice||'|'||model AS model FROM l0), sp AS ({SPEAR_SQL.format(src='l')}),
  ra AS (SELECT * FROM {auc_sql('l', ['model'], 'score')}), wa AS (SELECT * FROM {auc_sql('l', ['model'], 'score', weight='1.0/propensity')}),
  nm AS (SELECT model, avg(ndcg) AS m FROM {ndcg_sql('l', ['model'], 'feed_id', 'score')} GROUP BY model),
  nd AS (SELECT model, avg(ndcg) AS d FROM {ndcg_sql('l', ['model'], 'feed_id', '-position_rank')} GROUP BY model),
  r2 AS (SELECT model, round(pow(corr(position_rank::DOUBLE, score),2),6) AS r2 FROM l GROUP BY model)
  SELECT nullif(split_part(model,'|',1),'none') AS slice, split_part(model,'|',2) AS model, ra.n, round(ra.auc,6) AS raw_auc, round(wa.auc,6) AS ipw_auc, round(wa.auc-ra.auc,6) AS ipw_auc_delta, spearman_r, r2,
    round(m,6) AS ndcg_model, round(d,6) AS ndcg_display, round(m-d,6) AS ndcg_delta
  FROM ra JOIN wa USING (model) JOIN sp USING (model) JOIN nm USING (model) JOIN nd USING (model) JOIN r2 USING (model)""")
def _(spark, sf):
    """M6, M7, M9, M10, M11 in groups, one of them null."""
    df = with_null_slice(weighted_rows(spark, sf).where("split = 'test'"))
    out = debias.debias_report(df, ["quality", "click_likelihood"], by=["slice"]).drop("p_value")
    return rounded(out, ["raw_auc", "ipw_auc", "ipw_auc_delta", "spearman_r", "r2", "ndcg_model", "ndcg_display", "ndcg_delta"])


CELLS_SQL = f"""{IMP}, base AS (SELECT *, {SLICE} AS slice FROM imp WHERE position_rank<6),
  c AS (SELECT slice, card_type, position_rank, count(*) AS n_ab FROM base GROUP BY ALL),
  m AS (SELECT *, sum(n_ab) OVER (PARTITION BY slice, card_type) AS n_a, sum(n_ab) OVER (PARTITION BY slice, position_rank) AS n_b,
          sum(n_ab) OVER (PARTITION BY slice) AS n FROM c)"""


@query("mutual_information", f"""{CELLS_SQL} SELECT slice, round(sum(n_ab/n*ln((n_ab::DOUBLE*n)/(n_a::DOUBLE*n_b))),6) AS mi, max(n)::BIGINT AS n FROM m GROUP BY slice""")
def _(spark, sf):
    df = tagged(ranked_impressions(spark, sf)).where("position_rank < 6")
    return rounded(audit.mutual_information(df, "card_type", "position_rank", ["slice"]), ["mi"])


@query("chi_square", f"""{CELLS_SQL} SELECT slice, max(n)::BIGINT AS n, round(sum(power(n_ab-(n_a::DOUBLE*n_b/n),2)/(n_a::DOUBLE*n_b/n)),4) AS chi2,
  ((count(DISTINCT card_type)-1)*(count(DISTINCT position_rank)-1))::BIGINT AS dof FROM m GROUP BY slice""")
def _(spark, sf):
    df = tagged(ranked_impressions(spark, sf)).where("position_rank < 6")
    return rounded(audit.chi_square(df, "card_type", "position_rank", ["slice"]).drop("p_value"), ["chi2"], 4)


@query("permutation_mi")
def _(spark, sf):
    df = tagged(ranked_impressions(spark, sf)).where("position_rank < 6")
    return audit.permutation_mi(df, "card_type", "position_rank", 80, 0, ["slice"])


@query("permutation_observed", f"""{CELLS_SQL} SELECT slice, round(sum(n_ab/n*ln((n_ab::DOUBLE*n)/(n_a::DOUBLE*n_b))),6) AS mi_obs, true AS law_holds FROM m GROUP BY slice""")
def _(spark, sf):
    """What the permutations leave as it is, and bounds that their statistics keep."""
    df = tagged(ranked_impressions(spark, sf)).where("position_rank < 6")
    out = audit.permutation_mi(df, "card_type", "position_rank", 40, 7, ["slice"])
    holds = F.expr("mi_null_mean > 0 and mi_null_std > 0 and mi_perm_p between 1 / 41 and 1 and abs(mi_z * mi_null_std - (mi_obs - mi_null_mean)) < 1e-9")
    return rounded(out.select("slice", "mi_obs", holds.alias("law_holds")), ["mi_obs"])


@query("permutation_margins", f"""{IMP}, base AS (SELECT {NULL_SLICE_SQL} AS slice, card_type, position_rank FROM imp WHERE position_rank<6)
  SELECT nullif(slice,'none') AS slice, replicate, 'card_type' AS margin, card_type AS value, count(*)::BIGINT AS n FROM base, range(3) t(replicate) GROUP BY ALL
  UNION ALL SELECT nullif(slice,'none'), replicate, 'position', position_rank::VARCHAR, count(*)::BIGINT FROM base, range(3) t(replicate) GROUP BY ALL""")
def _(spark, sf):
    """The re-dealt tables have the margins of the rows, group by group."""
    df = with_null_slice(ranked_impressions(spark, sf)).where("position_rank < 6")
    dealt = stage(permutation.deal_tables(df, "card_type", "position_rank", 3, 0, ["slice"]))
    side = lambda name, c: dealt.groupBy("slice", "replicate", F.lit(name).alias("margin"), F.col(c).cast("string").alias("value")).agg(F.sum("n").alias("n"))
    return side("card_type", "card_type").unionByName(side("position", "position_rank"))


EDGES_SQL = """e AS (SELECT feature, list_distinct(list_sort(quantile_cont(value, [0.125,0.25,0.375,0.5,0.625,0.75,0.875]))) AS inner_edges,
   min(value) AS lo, max(value) AS hi FROM f GROUP BY feature),
  binned AS (SELECT f.*, len(list_filter(inner_edges, lambda x: x < value AND x > lo AND x < hi)) AS bin FROM f JOIN e USING (feature))"""


@query("quantile_bins", f"""{IMP}, f AS {features_sql('position_rank')}, {EDGES_SQL}
  SELECT feature, bin, count(*) AS rows, min(value) AS lowest, max(value) AS highest FROM binned GROUP BY feature, bin""")
def _(spark, sf):
    long = metrics.unpivot(impressions(spark, sf), [], FEATURES)
    return audit.quantile_bins(long, "value", 8, ["feature"]).groupBy("feature", "bin").agg(
        F.count("*").alias("rows"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )


@query("score_position_mi", f"""{IMP}, f AS (SELECT * FROM {features_sql('position_rank', '(SELECT * FROM imp WHERE position_rank<6)')}), {EDGES_SQL},
  c AS (SELECT feature, bin, position_rank, count(*) AS n_ab FROM binned GROUP BY ALL),
  m AS (SELECT *, sum(n_ab) OVER (PARTITION BY feature, bin) AS n_a, sum(n_ab) OVER (PARTITION BY feature, position_rank) AS n_b, sum(n_ab) OVER (PARTITION BY feature) AS n FROM c)
  SELECT feature, round(sum(n_ab/n*ln((n_ab::DOUBLE*n)/(n_a::DOUBLE*n_b))),6) AS mi, max(n)::BIGINT AS n FROM m GROUP BY feature""")
def _(spark, sf):
    return rounded(audit.score_position_mi(ranked_impressions(spark, sf), FEATURES), ["mi"])


@query("category_coverage", f"""{IMP}, c AS (SELECT {SLICE} AS slice, card_type, count(*) AS c FROM imp GROUP BY ALL),
  t AS (SELECT *, c/sum(c) OVER (PARTITION BY slice) AS p, sum(c) OVER (PARTITION BY slice) AS n, row_number() OVER (PARTITION BY slice ORDER BY c DESC, card_type) AS r FROM c)
  SELECT slice, max(n)::BIGINT AS n, count(*) AS n_values, round(-sum(p*log2(p+1e-12)),4) AS entropy_bits, round(log2(count(*)),4) AS entropy_max,
    round(-sum(p*log2(p+1e-12))/log2(count(*)),4) AS entropy_ratio, round(sum(CASE WHEN r<=5 THEN c ELSE 0 END)/max(n),4) AS top5_share FROM t GROUP BY slice""")
def _(spark, sf):
    out = audit.category_coverage(tagged(impressions(spark, sf)), "card_type", ["slice"])
    return rounded(out, ["entropy_bits", "entropy_max", "entropy_ratio", "top5_share"], 4)


@query("slice_meta", f"{IMP} SELECT {SLICE} AS slice, count(*) AS rows, count(DISTINCT feed_id) AS feeds FROM imp GROUP BY 1")
def _(spark, sf):
    return audit.slice_meta(tagged(impressions(spark, sf)), "slice")


@query("unbiasedness_audit")
def _(spark, sf):
    parts = audit.unbiasedness_audit(
        ranked_impressions(spark, sf), F.col("flight_ids").contains(TAG), "card_type", FEATURES
    )
    return reports.label_union(parts, "test")


@query("split_summary", f"""{IMP} SELECT {SLICE} AS slice, count(*) AS n, sum(label)::BIGINT AS pos, (count(*)-sum(label))::BIGINT AS neg,
  round(sum(label)/count(*),6) AS ctr, count(DISTINCT feed_id) AS feeds, count(DISTINCT user_id) AS users FROM imp GROUP BY 1""")
def _(spark, sf):
    return rounded(reports.split_summary(tagged(impressions(spark, sf)), ["slice"]), ["ctr"])


@query("run_metadata", f"""{IMP} SELECT count(*) AS rows, round(avg(label),6) AS click_rate, min(position_rank) AS min_position,
  max(position_rank) AS max_position, count(DISTINCT feed_id) AS sessions, count(DISTINCT user_id) AS users FROM imp""")
def _(spark, sf):
    return rounded(reports.run_metadata(ranked_impressions(spark, sf)), ["click_rate"])


@query("daily_auc_with_overall", f"""{IMP}, d AS (SELECT substr(bizdate,1,8) AS day, quality, label FROM imp UNION ALL SELECT 'OVERALL', quality, label FROM imp)
  SELECT day, n, pos, neg, round(pos/n,6) AS ctr, round(auc,6) AS auc FROM {auc_sql('d', ['day'], 'quality')}""")
def _(spark, sf):
    return rounded(reports.daily_auc(impressions(spark, sf), (), "quality"), ["auc", "ctr"])


@query("model_day_matrix", f"""{IMP}, l AS {LONG_SQL.format(s='imp')}, d AS (SELECT model, substr(bizdate,1,8) AS day, score, label FROM l UNION ALL SELECT model, 'OVERALL', score, label FROM l),
  a AS (SELECT * FROM {auc_sql('d', ['model', 'day'], 'score')})
  SELECT day, round(max(CASE WHEN model='quality' THEN auc END),6) AS quality, round(max(CASE WHEN model='click_likelihood' THEN auc END),6) AS click_likelihood FROM a GROUP BY day""")
def _(spark, sf):
    out = reports.model_day_matrix(scored_long(impressions(spark, sf)).drop("quality", "click_likelihood"), ["quality", "click_likelihood"])
    return rounded(out, ["quality", "click_likelihood"])


@query("slice_report_overlapping", f"""{IMP}, f AS (SELECT *, max(label) OVER (PARTITION BY feed_id)=1 AS cs FROM imp),
  s AS (SELECT 'ALL' AS split, quality, label FROM f UNION ALL SELECT 'tagged', quality, label FROM f WHERE contains(flight_ids,'URGENT')
    UNION ALL SELECT 'click_session', quality, label FROM f WHERE cs UNION ALL SELECT 'tagged_click_session', quality, label FROM f WHERE cs AND contains(flight_ids,'URGENT'))
  SELECT split, n, pos, neg, round(pos/n,6) AS ctr, round(auc,6) AS auc FROM {auc_sql('s', ['split'], 'quality')}
  UNION ALL SELECT 'never', 0, 0, 0, 0.0, 'nan'::DOUBLE""")
def _(spark, sf):
    df = reports.click_session_flag(impressions(spark, sf))
    tag, session = F.col("flight_ids").contains(TAG), F.col("click_session")
    slices = {"ALL": F.lit(True), "tagged": tag, "click_session": session, "tagged_click_session": tag & session, "never": F.lit(False)}
    return rounded(reports.slice_report(df, slices, "quality"), ["ctr", "auc"])


CALLS_SQL = """calls AS (SELECT user_id % 8 AS concurrency, event_type<>'error' AS ok, CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status,
  value AS elapsed_ms, CASE WHEN event_type='view' THEN NULL ELSE value*0.5 END AS latency_ms FROM events)"""


def calls(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        (F.col("user_id") % 8).alias("concurrency"), (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("elapsed_ms"),
        F.when(F.col("event_type") != "view", F.col("value") * 0.5).alias("latency_ms"),
    )


LEVELS_SQL = f"""WITH {CALLS_SQL} SELECT concurrency, count(*) AS requests, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failure,
  round(count(*) FILTER (NOT ok)/count(*),6) AS failure_rate, round(avg(elapsed_ms),6) AS avg_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms,
  round(quantile_cont(elapsed_ms,0.5),6) AS p50_ms, round(quantile_cont(elapsed_ms,0.9),6) AS p90_ms, round(quantile_cont(elapsed_ms,0.95),6) AS p95_ms,
  round(quantile_cont(elapsed_ms,0.99),6) AS p99_ms, round(avg(latency_ms),6) AS latency_ms_avg, round(quantile_cont(latency_ms,0.5),6) AS latency_ms_p50,
  round(quantile_cont(latency_ms,0.95),6) AS latency_ms_p95,
  '{{"200":'||count(*) FILTER (ok)||',"500":'||count(*) FILTER (NOT ok)||'}}' AS status_counts FROM calls GROUP BY concurrency"""
LEVEL_DOUBLES = ["failure_rate", "avg_ms", "p50_ms", "p90_ms", "p95_ms", "p99_ms", "latency_ms_avg", "latency_ms_p50", "latency_ms_p95"]


@query("latency_summary", LEVELS_SQL)
def _(spark, sf):
    return rounded(reports.latency_summary(calls(spark, sf), ["concurrency"], service=["latency_ms"]), LEVEL_DOUBLES)


@query("call_rate_per_second", f"""WITH {CALLS_SQL} SELECT concurrency, count(*) AS requests, round(count(*)/(10.0::DOUBLE*(1+concurrency)),6) AS qps FROM calls GROUP BY concurrency""")
def _(spark, sf):
    """Requests over the wall-clock seconds of their level."""
    timed = calls(spark, sf).withColumn("wall_s", (F.col("concurrency") + 1) * 10.0)
    return rounded(reports.latency_summary(timed, ["concurrency"], elapsed_s="wall_s").select("concurrency", "requests", "qps"), ["qps"])


@query("sweep_cutoff", f"""WITH lv AS ({LEVELS_SQL}) SELECT concurrency, failure_rate, p95_ms FROM lv
  WHERE concurrency <= coalesce((SELECT min(concurrency) FROM lv WHERE failure_rate>0.2 OR p95_ms>(SELECT median(p95_ms) FROM lv)), 1000000)""")
def _(spark, sf):
    lv = rounded(reports.latency_summary(calls(spark, sf), ["concurrency"], service=["latency_ms"]), LEVEL_DOUBLES)
    mid = lv.agg(F.median("p95_ms")).scalar()
    return reports.sweep_cutoff(lv, max_fail=0.2, max_p95=mid).select("concurrency", "failure_rate", "p95_ms")


@query("exact_percentiles_one_group", "SELECT list_transform(quantile_cont(value,[0.0,0.25,0.5,0.95,1.0]), lambda x: round(x,6)) AS percentiles FROM events")
def _(spark, sf):
    out = ranges.exact_percentiles(table(spark, sf, "events"), "value", [0.0, 0.25, 0.5, 0.95, 1.0])
    return out.select(F.transform("percentiles", lambda x: F.round(x, 6)).alias("percentiles"))


@query("report_json", f"""{IMP} SELECT '{{"position_rank":'||position_rank||',"impressions":'||count(*)||',"clicks":'||sum(label)||',"ctr":'||round(sum(label)/count(*),6)||'}}' AS json FROM imp GROUP BY position_rank""")
def _(spark, sf):
    return reports.report_json(debias.ctr_by_position(ranked_impressions(spark, sf)))


@query("labelled_result_union", f"""{IMP} SELECT 'Full' AS name, position_rank, round(avg(quality),6) AS mean_score FROM imp GROUP BY position_rank
  UNION ALL SELECT 'Tagged', position_rank, round(avg(quality),6) FROM imp WHERE contains(flight_ids,'URGENT') GROUP BY position_rank""")
def _(spark, sf):
    df = ranked_impressions(spark, sf)
    parts = {"Full": df, "Tagged": df.where(F.col("flight_ids").contains(TAG))}
    return rounded(reports.label_union({k: debias.mean_score_by_position(v, "quality") for k, v in parts.items()}), ["mean_score"])
