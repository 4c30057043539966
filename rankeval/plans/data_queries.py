"""Sampling, mining, quality, source, scoring and model queries."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F

from rankeval.functions import loose, requests, scores
from rankeval.functions.text import ellipsize, one_line, strip, trim_ts, word_count
from rankeval.operators import debias, flatten, metrics, models, quality, ranker, reports, sampling, scoring
from rankeval.plans.feed_queries import CONTEXT_SQL, FEEDS, FLAT_SQL, FULL_SQL, flat
from rankeval.plans.ranking_queries import IMP, SLICE, calls, tagged
from rankeval.plans.registry import query, rounded
from rankeval.plans.views import FEATURES, FEED_TAG, ROW_KEY, TAG, impressions, ranked_impressions, raw_feeds, table
from rankeval.sources import readers, store, writers
from rankeval.sources.staging import scratch_path, stage

KEYS = ROW_KEY
KEY_TEXT = "feed_id||'|'||section_index||'|'||item_id||'|'||supp_id||'|'||ship_day"
KEY_LIST = ", ".join(KEYS)


def h60(seed, text):
    return f"('0x'||substr(md5('{seed}|'||{text}),1,15))::BIGINT"


# ---- sampling ------------------------------------------------------------------------------------------------

@query("split_by_feed", f"""{IMP} SELECT split, count(*) AS rows, count(DISTINCT feed_id) AS feeds FROM
  (SELECT *, CASE WHEN ('0x'||substr(md5('42|'||feed_id),1,8))::BIGINT % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM imp) GROUP BY split""")
def _(spark, sf):
    return sampling.split_by(impressions(spark, sf), "feed_id").groupBy("split").agg(
        F.count("*").alias("rows"), F.count_distinct("feed_id").alias("feeds")
    )


@query("holdout_flag", f"""{IMP} SELECT ('0x'||substr(md5('0|'||{KEY_TEXT}),1,8))::BIGINT % 100 < 10 AS is_holdout, count(*) AS rows, sum(label)::BIGINT AS clicks FROM imp GROUP BY 1""")
def _(spark, sf):
    return sampling.holdout(impressions(spark, sf), KEYS).groupBy("is_holdout").agg(F.count("*").alias("rows"), F.sum("label").alias("clicks"))


def smallest_sql(src, seed, keep):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}|'||{KEY_TEXT}), {KEY_LIST}) AS rn FROM {src}) WHERE rn<=({keep}))"


@query("negatives_by_ratio", f"""{IMP}, n AS (SELECT * FROM imp WHERE label=0) SELECT {KEY_LIST}, label FROM imp WHERE label=1
  UNION ALL SELECT {KEY_LIST}, label FROM {smallest_sql('n', 43, 'SELECT round_even(1.5*sum(label),0)::BIGINT FROM imp')}""")
def _(spark, sf):
    return sampling.downsample_negatives(impressions(spark, sf), KEYS, ratio=1.5).select(*KEYS, "label")


@query("negatives_by_ratio_then_fraction", f"""{IMP}, n AS (SELECT * FROM imp WHERE label=0), r AS (SELECT * EXCLUDE rn FROM {smallest_sql('n', 43, 'SELECT round_even(1.5*sum(label),0)::BIGINT FROM imp')})
  SELECT {KEY_LIST}, label FROM imp WHERE label=1 UNION ALL SELECT {KEY_LIST}, label FROM {smallest_sql('r', 44, 'SELECT round_even(0.3*count(*),0)::BIGINT FROM r')}""")
def _(spark, sf):
    return sampling.downsample_negatives(impressions(spark, sf), KEYS, ratio=1.5, frac=0.3).select(*KEYS, "label")


@query("sample_rows", f"{IMP} SELECT {KEY_LIST} FROM {smallest_sql('imp', 42, '1000')}")
def _(spark, sf):
    return sampling.sample_n(impressions(spark, sf), 1000, KEYS).select(*KEYS)


@query("class_weights", f"""{IMP} SELECT sum(label)::BIGINT AS pos, sum(1-label)::BIGINT AS neg, round(count(*)/(2.0::DOUBLE*sum(label)),6) AS weight_pos,
  round(count(*)/(2.0::DOUBLE*sum(1-label)),6) AS weight_neg, round(sum(1-label)/sum(label)::DOUBLE,6) AS scale_pos_weight FROM imp""")
def _(spark, sf):
    return rounded(sampling.class_weights(impressions(spark, sf)), ["weight_pos", "weight_neg", "scale_pos_weight"])


ITEM = ["section_index", "item_id", "supp_id", "ship_day"]
ITEM_LIST = ", ".join(ITEM)
NEG_LIST = ", ".join(f"c.{c} AS neg_{c}" for c in ITEM)
ANCHOR_LIST = ", ".join(f"a.{c} AS anchor_{c}" for c in ITEM)
MINE_SQL = f"""{IMP}, a AS (SELECT *, {h60(42, KEY_TEXT)} AS h FROM imp WHERE label=1),
  o AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY {h60(43, KEY_TEXT)}, {ITEM_LIST})-1 AS idx, count(*) OVER (PARTITION BY feed_id) AS m FROM imp WHERE label=0),
  am AS (SELECT a.*, coalesce(s.m,0) AS m FROM a LEFT JOIN (SELECT DISTINCT feed_id, m FROM o) s USING (feed_id)),
  ses AS (SELECT a.feed_id AS anchor_feed, {ANCHOR_LIST}, 'in_session' AS source, c.feed_id AS neg_feed, {NEG_LIST}
    FROM am a, range(20) t(j), o c WHERE c.feed_id=a.feed_id AND j<least(20,a.m) AND c.idx=(a.h+j*greatest(1,a.m//20))%a.m),
  ring AS (SELECT *, row_number() OVER (ORDER BY md5('42|'||feed_id), feed_id, {h60(44, KEY_TEXT)}, {ITEM_LIST})-1 AS idx FROM a),
  blk AS (SELECT feed_id, min(idx) AS f, count(*) AS sz FROM ring GROUP BY feed_id), tot AS (SELECT count(*) AS n FROM a),
  short AS (SELECT am.*, 20-m AS need, f, sz, n, n-sz AS others FROM am JOIN blk USING (feed_id), tot WHERE m<20 AND n>sz),
  crs AS (SELECT a.feed_id AS anchor_feed, {ANCHOR_LIST}, 'cross_feed' AS source, c.feed_id AS neg_feed, {NEG_LIST}
    FROM short a, range(20) t(j), ring c WHERE j<least(need,others) AND c.idx=(f+sz+(a.h+j*greatest(1,others//need))%others)%n),
  pairs AS (SELECT * FROM ses UNION ALL SELECT * FROM crs)"""


def mined(spark, sf):
    return sampling.mine_negatives(impressions(spark, sf), "feed_id", ITEM)


@query("mined_negatives", f"{MINE_SQL} SELECT * FROM pairs")
def _(spark, sf):
    return mined(spark, sf)


@query("mining_stats", f"""{MINE_SQL}, g AS (SELECT anchor_feed, {', '.join('anchor_' + c for c in ITEM)}, count(*) AS n, count(*) FILTER (source='in_session') AS i, count(*) FILTER (source='cross_feed') AS x FROM pairs GROUP BY ALL)
  SELECT count(*) AS anchors, round(avg(n),6) AS avg_negatives, sum(i)::BIGINT AS in_session, sum(x)::BIGINT AS cross_feed FROM g""")
def _(spark, sf):
    stats = sampling.mining_stats(mined(spark, sf), ["anchor_feed", *[f"anchor_{c}" for c in ITEM]])
    return rounded(stats, ["avg_negatives"])


@query("pair_losses", f"""{IMP}, p AS (SELECT feed_id, position_rank=0 AS y, quality*10-worthiness*20 AS s FROM imp WHERE feed_id IN (SELECT feed_id FROM imp GROUP BY feed_id HAVING count(*)>1)),
  g AS (SELECT feed_id, max(CASE WHEN y THEN ln(1+exp(-s)) END)+avg(CASE WHEN NOT y THEN ln(1+exp(s)) END) AS bce, ln(sum(exp(s/0.5)))-max(CASE WHEN y THEN s/0.5 END) AS nce FROM p GROUP BY feed_id)
  SELECT count(*) AS anchors, round(avg(bce),6) AS bce, round(avg(nce),6) AS infonce, round(avg(bce+nce),6) AS total FROM g""")
def _(spark, sf):
    df = ranked_impressions(spark, sf).select(
        "feed_id", (F.col("position_rank") == 0).alias("y"), (F.col("quality") * 10 - F.col("worthiness") * 20).alias("s")
    )
    many = df.where("not y").select("feed_id").distinct()
    return rounded(metrics.pair_losses(df.join(many, "feed_id", "left_semi"), ["feed_id"], "s", "y", tau=0.5), ["bce", "infonce", "total"])


# ---- quality -------------------------------------------------------------------------------------------------

@query("feature_coverage", f"""{IMP}, f AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v FROM imp" for f in FEATURES)})
  SELECT feature, count(*) AS total, count(v) AS non_null, count(*) FILTER (v IS NULL OR v<>0) AS non_zero, round(avg(v),6) AS mean, round(stddev_samp(v),6) AS std,
    min(v) AS min, max(v) AS max, round(median(v),6) AS median, 0.0::DOUBLE AS null_rate, round(1-(count(*) FILTER (v<>0))/count(*)::DOUBLE,6) AS zero_rate, round((count(*) FILTER (v<>0))/count(*)::DOUBLE,6) AS coverage_rate
  FROM f GROUP BY feature""")
def _(spark, sf):
    return quality.feature_coverage(impressions(spark, sf), FEATURES, 6)


@query("field_coverage", """WITH d AS (SELECT *, doc_id%4<>0 AS has_title FROM documents), n AS (SELECT count(*) AS n FROM d WHERE doc_id%10<>9),
  e AS (SELECT 'record' AS level, 'id' AS field, true AS f FROM d WHERE doc_id%10<>9 UNION ALL SELECT 'record', 'lang', lang<>'en' FROM d WHERE doc_id%10<>9
    UNION ALL SELECT 'record', 'features', doc_id%3<>0 FROM d WHERE doc_id%10<>9 UNION ALL SELECT 'record', 'interests', true FROM d WHERE doc_id%10<>9
    UNION ALL SELECT 'features', 'size', n_chars%5<>0 FROM d WHERE doc_id%10<>9 AND doc_id%3<>0 UNION ALL SELECT 'interests', 'positive', true FROM d WHERE doc_id%10<>9)
  SELECT level, field, count(*) AS present, count(*) FILTER (f) AS non_empty, round((count(*) FILTER (f))*100.0::DOUBLE/(SELECT n FROM n),6) AS coverage_pct FROM e GROUP BY level, field""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    text = F.expr("""case when doc_id % 10 = 9 then '{broken' else concat('{"id":', doc_id, ',"lang":"', if(lang = 'en', '', lang), '","features":',
        if(doc_id % 3 = 0, '{}', concat('{"size":', n_chars % 5, '}')), ',"interests":{"positive":[]}}') end""")
    return rounded(quality.field_coverage(d.select(text.alias("json"))), ["coverage_pct"])


RIGHT_SQL = "r AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey%7=0 THEN o_totalprice+1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey%10<>3)"
FIELDS = ["o_custkey", "o_orderstatus", "o_totalprice"]


def two_sides(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", *FIELDS)
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return o.where("o_orderkey % 10 <> 4"), o.where("o_orderkey % 10 <> 3").withColumn("o_totalprice", changed)


@query("reconcile_summary", f"""WITH l AS (SELECT * FROM orders WHERE o_orderkey%10<>4), {RIGHT_SQL}
  SELECT count(*) FILTER (l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL) AS "both", count(*) FILTER (r.o_orderkey IS NULL) AS only_left, count(*) FILTER (l.o_orderkey IS NULL) AS only_right,
   0 AS diff_o_custkey, 0 AS diff_o_orderstatus, count(*) FILTER (l.o_totalprice<>r.o_totalprice) AS diff_o_totalprice FROM l FULL JOIN r ON l.o_orderkey=r.o_orderkey""")
def _(spark, sf):
    left, right = two_sides(spark, sf)
    keep = lambda d: quality.last_by_key(d, ["o_orderkey"], ["o_totalprice"])
    return quality.reconcile_summary(quality.reconcile(keep(left), keep(right), ["o_orderkey"], FIELDS), FIELDS)


@query("reconcile_examples", f"""WITH {RIGHT_SQL} SELECT 'o_totalprice' AS field, l.o_orderkey FROM orders l JOIN r USING (o_orderkey) WHERE l.o_totalprice<>r.o_totalprice AND l.o_orderkey%10<>4 ORDER BY l.o_orderkey LIMIT 3""")
def _(spark, sf):
    left, right = two_sides(spark, sf)
    m = quality.reconcile(left, right, ["o_orderkey"], FIELDS)
    return quality.mismatch_examples(m, FIELDS, ["o_orderkey"]).select("field", "o_orderkey")


@query("key_match_sides", f"""WITH l AS (SELECT * FROM orders WHERE o_orderkey%10<>4), {RIGHT_SQL} SELECT CASE WHEN r.o_orderkey IS NULL THEN 'only_left' WHEN l.o_orderkey IS NULL THEN 'only_right' ELSE 'both' END AS side, count(*) AS n
  FROM l FULL JOIN r ON l.o_orderkey=r.o_orderkey GROUP BY 1""")
def _(spark, sf):
    left, right = two_sides(spark, sf)
    return quality.key_match(left, right, ["o_orderkey"]).groupBy("side").agg(F.count("*").alias("n"))


@query("key_sets", """WITH l AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey%3=0), r AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey%3<>0)
  SELECT 'union' AS set, count(*) AS keys FROM (SELECT * FROM l UNION SELECT * FROM r) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM l INTERSECT SELECT * FROM r)
  UNION ALL SELECT 'only_left', count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'only_right', count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return quality.key_sets(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0"), ["o_custkey"])


@query("user_count_comparison", """WITH l AS (SELECT o_custkey, count(*) AS c FROM orders WHERE o_orderkey%3=0 GROUP BY 1), r AS (SELECT o_custkey, count(*) AS c FROM orders WHERE o_orderkey%3<>0 GROUP BY 1)
  SELECT CASE WHEN r.c IS NULL THEN 'only_left' WHEN l.c IS NULL THEN 'only_right' WHEN l.c=r.c THEN 'equal' WHEN l.c>r.c THEN 'left_more' ELSE 'right_more' END AS outcome, count(*) AS users
  FROM l FULL JOIN r ON l.o_custkey=r.o_custkey GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return quality.user_counts(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 <> 0"), "o_custkey")


@query("empty_interest_share", f"""{FEEDS} SELECT count(*) AS rows, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM positive)) AS empty,
  round((count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM positive)))*100.0::DOUBLE/count(*),6) AS empty_pct FROM cards""")
def _(spark, sf):
    df = flat(spark, sf, require_interests=False)
    return rounded(quality.empty_share(df, F.size("interests.positive") == 0), ["empty_pct"])


PROFILE_SQL = f"""{FEEDS}, {FLAT_SQL}, u AS (SELECT user_id, count(*) AS samples, bool_or(doc_id IN (SELECT doc_id FROM history)) AS has_history, bool_or(has_features) AS has_features,
  bool_or(doc_id IN (SELECT doc_id FROM convs)) AS has_conversations FROM flat GROUP BY user_id)"""


def profiles(spark, sf):
    return quality.user_profile(
        flat(spark, sf), F.size("history") > 0, F.col("features").isNotNull(), F.size("interests.conversations") > 0
    )


@query("user_profiles", f"{PROFILE_SQL} SELECT * FROM u")
def _(spark, sf):
    return profiles(spark, sf)


@query("users_per_profile", f"""{PROFILE_SQL}, p AS (SELECT 'history_and_features' AS profile, * FROM u WHERE has_history AND has_features UNION ALL SELECT 'no_history', * FROM u WHERE NOT has_history
  UNION ALL SELECT 'most_samples', * FROM u) SELECT profile, user_id, samples FROM p QUALIFY row_number() OVER (PARTITION BY profile ORDER BY samples DESC, user_id)=1""")
def _(spark, sf):
    return quality.pick_users(profiles(spark, sf))


@query("preview_rows", f"""{IMP}, o AS (SELECT {KEY_LIST}, label, row_number() OVER (ORDER BY {KEY_LIST}) AS rn, row_number() OVER (PARTITION BY label ORDER BY {KEY_LIST}) AS rl FROM imp)
  SELECT {KEY_LIST}, label, 'first' AS which FROM o WHERE rn=1 UNION ALL SELECT {KEY_LIST}, label, 'first_positive' FROM o WHERE label=1 AND rl=1""")
def _(spark, sf):
    return quality.preview(impressions(spark, sf).select(*KEYS, "label"), KEYS)


@query("first_rows_per_label", f"{IMP} SELECT {KEY_LIST}, label FROM imp QUALIFY row_number() OVER (PARTITION BY label ORDER BY {KEY_LIST})<=10")
def _(spark, sf):
    return quality.first_per_label(impressions(spark, sf).select(*KEYS, "label"), 10, KEYS)


@query("fixture_pair", f"""{FEEDS}, {FLAT_SQL}, rich AS (SELECT flat.* FROM flat JOIN negative USING (doc_id) JOIN clicks USING (doc_id) JOIN ups USING (doc_id) JOIN downs USING (doc_id) JOIN history USING (doc_id)
    WHERE title<>'' AND doc_id IN (SELECT doc_id FROM convs)),
  u AS (SELECT user_id, min(feed_id||' '||itemid) AS k, count(DISTINCT label) AS l FROM rich GROUP BY user_id HAVING count(*)>=2),
  pick AS (SELECT user_id FROM u ORDER BY l DESC, k LIMIT 1)
  SELECT user_id, feed_id, itemid, label FROM rich JOIN pick USING (user_id) QUALIFY row_number() OVER (PARTITION BY label ORDER BY feed_id, itemid)=1""")
def _(spark, sf):
    rows = flat(spark, sf).where(flatten.is_rich()).select("user_id", "feed_id", "candidate.itemid", "label")
    return quality.pick_fixture_pair(rows, F.lit(True), ["feed_id", "itemid"])


CAL_SQL = """cal AS (SELECT event_type AS "case", count(*) AS n, min(value/1000) AS lo, max(value/1000) AS hi, avg(value/1000) AS mean, greatest(5e-3, max(value/1000)-min(value/1000)+2e-2) AS tol, count(DISTINCT round(value/1000,6)) AS k
   FROM events WHERE event_id%2=0 GROUP BY 1)"""


def scored_events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("case"), (F.col("value") / 1000).alias("score"))


@query("calibration", f"""WITH {CAL_SQL} SELECT "case", n, round(lo,6) AS score_min, round(hi,6) AS score_max, round(mean,6) AS score_mean, round(tol,6) AS tolerance, k AS unique_scores FROM cal""")
def _(spark, sf):
    out = quality.calibrate(scored_events(spark, sf).where("event_id % 2 = 0")).withColumn("unique_scores", F.size("unique_scores").cast("bigint"))
    return rounded(out, ["score_min", "score_max", "score_mean", "tolerance"])


@query("golden_check", f"""WITH {CAL_SQL} SELECT "case", count(*) AS n, round(max(abs(value/1000-mean)),6) AS max_diff, round(max(tol),6) AS tolerance, bool_and(abs(value/1000-mean)<=tol) AS ok
  FROM (SELECT *, event_type AS "case" FROM events WHERE event_id%2=1) JOIN cal USING ("case") GROUP BY "case\"""")
def _(spark, sf):
    e = scored_events(spark, sf)
    return rounded(quality.verify(e.where("event_id % 2 = 1"), quality.calibrate(e.where("event_id % 2 = 0"))), ["max_diff", "tolerance"])


@query("title_test_set", """WITH t AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS title, lang AS body FROM documents)
  SELECT title, body FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS r FROM t WHERE len(regexp_extract_all(title,'\\S+'))>=3) WHERE r=1 ORDER BY doc_id LIMIT 10000""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", strip(F.split("text", "\n")[0]).alias("title"), F.col("lang").alias("body"))
    return quality.build_test_set(d, ["doc_id"])


@query("score_differences", f"""{IMP} SELECT count(*) AS n, round(min(quality),6) AS min_a, round(max(quality),6) AS max_a, round(min(click_likelihood/500),6) AS min_b, round(max(click_likelihood/500),6) AS max_b,
  round(avg(quality-click_likelihood/500),6) AS mean_diff, round(max(abs(quality-click_likelihood/500)),6) AS max_abs_diff FROM imp WHERE item_id%2=0""")
def _(spark, sf):
    df = impressions(spark, sf)
    a = df.select(*KEYS, F.col("quality").alias("score"))
    b = df.where("item_id % 2 = 0").select(*KEYS, (F.col("click_likelihood") / 500).alias("score"))
    out = metrics.score_diff_summary(metrics.score_diff(a, b, KEYS))
    return rounded(out, ["min_a", "max_a", "min_b", "max_b", "mean_diff", "max_abs_diff"])


@query("ranked_groups", """WITH c AS (SELECT p_size%10 AS request_id, p_brand AS group_id, p_partkey AS card_id, p_type AS t, p_retailprice AS price, p_size AS sz, length(p_name) AS nm FROM part),
  s AS (SELECT *, CASE WHEN substr(group_id,7,1)='1' THEN 0 WHEN substr(group_id,7,1)='2' THEN 1 ELSE 2 END AS src,
      CASE WHEN length(group_id)=8 THEN 0 ELSE 1 END AS band FROM c),
  g AS (SELECT request_id, group_id, min(src) AS a, min(band) AS b, max(sz) AS c1, max(price) AS c2 FROM s GROUP BY 1,2),
  gr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY a, b, c1 DESC, c2 DESC, group_id)-1 AS group_rank FROM g),
  cr AS (SELECT *, row_number() OVER (PARTITION BY request_id, group_id ORDER BY price DESC, nm DESC, card_id)-1 AS card_rank FROM s)
  SELECT request_id, group_id, card_id, group_rank, card_rank FROM cr JOIN gr USING (request_id, group_id) WHERE card_rank<4""")
def _(spark, sf):
    p = table(spark, sf, "part")
    digit = F.substring("p_brand", 7, 1)
    cards = p.select(
        (F.col("p_size") % 10).alias("request_id"), F.col("p_brand").alias("group_id"), F.col("p_partkey").alias("card_id"),
        F.when(digit == "1", "inline curation").when(digit == "2", "user interactions").otherwise("chat history").alias("source"),
        F.when(F.length("p_brand") == 8, 0.95).otherwise(0.85).alias("strength"),
        F.col("p_size").alias("g1"), F.col("p_retailprice").alias("g2"), F.length("p_name").alias("c2"),
    )
    out = ranker.rank_groups(cards, group_signals=["g1", "g2"], card_signals=["g2", "c2"])
    return out.select("request_id", "group_id", "card_id", "group_rank", "card_rank")


# ---- loose values and scores ---------------------------------------------------------------------------------

@query("numeric_feature_bag", """SELECT event_id, (CASE WHEN event_id%10=9 THEN 0 ELSE 4 END)::INT AS n, CASE WHEN event_id%10<>9 THEN (event_id%100)::DOUBLE END AS a, CASE WHEN event_id%10<>9 THEN value END AS b,
  CASE WHEN event_id%10<>9 THEN 1.0::DOUBLE END AS c, CASE WHEN event_id%10<>9 THEN json_extract(props,'$.k')::DOUBLE END AS k FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    text = F.expr("""case when event_id % 10 = 9 then '{"a":' else concat('{"a":', event_id % 100, ',"b":"', value, '","c":true,"d":"x1","e":null,"f":[1],"ParentId":7,', substr(props, 2)) end""")
    m = loose.numeric_features(text)
    get = lambda k: F.try_element_at(m, F.lit(k)).alias(k)
    return e.select("event_id", F.size(m).alias("n"), get("a"), get("b"), get("c"), get("k"))


@query("wide_projection", """SELECT l_orderkey%50 AS bucket, count(*) AS rows, sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END)::BIGINT AS clicks, round(sum(l_discount),6) AS quality, round(sum(l_tax),6) AS novelty, 0.0::DOUBLE AS absent
  FROM lineitem GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    wide = li.select(
        F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("feed_id"), F.col("l_linenumber").cast("string").alias("sectionIndex"),
        F.lit("0").alias("cardIndex"), F.col("l_linestatus").alias("cardType"), F.when(F.col("l_returnflag") == "R", "2").alias("clicks"),
        F.lit("1").alias("impressions"), F.lit(None).cast("string").alias("flight_ids"),
        loose.numeric_features(F.to_json(F.struct(F.col("l_discount").alias("quality"), F.col("l_tax").cast("string").alias("novelty")))).alias("features"),
    )
    out = flatten.wide_projection(wide, ["quality", "novelty", "absent"])
    return rounded(out.groupBy((F.col("feed_id") % 50).alias("bucket")).agg(
        F.count("*").alias("rows"), F.sum("is_clicked").alias("clicks"), F.sum("quality").alias("quality"), F.sum("novelty").alias("novelty"), F.sum("absent").alias("absent")
    ), ["quality", "novelty", "absent"])


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]  # all that the table has


@query("one_hot_categories", f"""{IMP} SELECT position_rank, {', '.join(f'sum(CASE WHEN card_type=$c${t}$c$ THEN 1 ELSE 0 END)::BIGINT AS "card_type_{t}"' for t in PART_TYPES)} FROM imp GROUP BY position_rank""")
def _(spark, sf):
    ranked = ranked_impressions(spark, sf)
    cats = flatten.category_list(ranked, "card_type")
    out = flatten.one_hot(ranked, "card_type", cats)
    return out.groupBy("position_rank").agg(*[F.sum(f"`card_type_{c}`").alias(f"card_type_{c}") for c in cats])


NUMBER_SQL = "CASE WHEN event_id%4=0 THEN ' `'||value||'` ' WHEN event_id%4=1 THEN 'about 0.'||event_id||' or so' WHEN event_id%4=2 THEN 'Nothing' ELSE ' YES, '||value END"


@query("score_texts", f"""WITH t AS (SELECT event_id, {NUMBER_SQL} AS t FROM events), n AS (SELECT *, nullif(regexp_extract(t,'([01]?\\.\\d+|[01](?:\\.0+)?)',1),'')::DOUBLE AS x FROM t)
  SELECT event_id, CASE WHEN x<=1 THEN x END AS score, CASE WHEN lower(ltrim(t)) LIKE 'yes%' THEN 1.0::DOUBLE WHEN lower(ltrim(t)) LIKE 'no%' THEN 0.0 ELSE 0.5 END AS yes_no,
    coalesce(CASE WHEN x<=1 THEN x END, 0.5) AS filled, NOT coalesce(x<=1,false) AS failed FROM n""")
def _(spark, sf):
    t = F.expr("""case event_id % 4 when 0 then concat(' `', value, '` ') when 1 then concat('about 0.', event_id, ' or so') when 2 then 'Nothing' else concat(' YES, ', value) end""")
    e = table(spark, sf, "events").select("event_id", t.alias("t"))
    s = scores.parse_number_score(F.col("t"))
    return e.select("event_id", s.alias("score"), scores.parse_yes_no(F.col("t")).alias("yes_no"), scores.neutral_fallback(s).alias("f")).select(
        "event_id", "score", "yes_no", F.col("f.score").alias("filled"), F.col("f.failed").alias("failed")
    )


@query("class_probabilities", f"""{IMP}, p AS (SELECT *, exp(quality*30)/(exp(quality*30)+exp(worthiness*30)) AS two, (exp(quality*20)+0.5*exp(worthiness*20))/(exp(quality*20)+exp(worthiness*20)+exp(click_likelihood/25)) AS three FROM imp)
  SELECT {KEY_LIST}, round(two,6) AS two, round(three,6) AS three, CASE WHEN three>=0.41 THEN 1 ELSE 0 END AS pred, round(greatest(0.05, least(1, two)),6) AS clipped FROM p""")
def _(spark, sf):
    df = impressions(spark, sf)
    q, w, c = F.col("quality"), F.col("worthiness"), F.col("click_likelihood")
    out = df.select(*KEYS, scores.two_class_prob(q * 30, w * 30).alias("two"), scores.three_class(q * 20, w * 20, c / 25).alias("t"))
    out = out.select(*KEYS, "two", F.col("t.prob").alias("three"), F.col("t.pred").alias("pred"), scores.clip(F.col("two"), 0.05, 1.0).alias("clipped"))
    return rounded(out, ["two", "three", "clipped"])


@query("text_helpers", """SELECT doc_id, trim(text) AS stripped, CASE WHEN length(replace(text,chr(10),' '))>220 THEN substr(replace(text,chr(10),' '),1,219)||'…' ELSE replace(text,chr(10),' ') END AS short,
  '2024-01-0'||(doc_id%9+1)||' 10:20' AS ts, len(regexp_extract_all(text,'\\S+')) AS words FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    ts = F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("T10:20:30.5Z"))
    return d.select("doc_id", strip(F.concat(F.lit("\t "), F.col("text"), F.lit("\n"))).alias("stripped"), ellipsize(one_line(F.col("text")), 220).alias("short"),
                    trim_ts(ts).alias("ts"), word_count(F.col("text")).cast("bigint").alias("words"))


RESPONSES_SQL = """r AS (SELECT *, CASE WHEN event_type='error' THEN 'http_failure' WHEN user_id%5=0 THEN 'version_mismatch' WHEN event_type='signup' THEN 'parse_failure' ELSE 'ok' END AS outcome,
  CASE WHEN event_type='error' THEN '' WHEN user_id%5=0 THEN 'v1' ELSE 'v2' END AS model_version FROM events)"""


def responses(spark, sf, chat=False):
    e = table(spark, sf, "events")
    body = F.to_json(F.struct(
        F.when(F.col("event_type") != "signup", F.array(F.struct(F.lit("a").alias("id"), (F.col("value") / 100).alias("score")))).alias("scores"),
        F.when(F.col("user_id") % 5 == 0, "v1").otherwise("v2").alias("model_version"), F.col("value").alias("latency_ms"),
    ))
    if chat:
        message = F.struct(F.struct(F.lit("assistant").alias("role"), body.alias("content")).alias("message"))
        body = F.to_json(F.struct(F.array(message).alias("choices")))
    return e.select("event_id", (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") != "error", body).otherwise("").alias("body"))


@query("response_outcomes", f"WITH {RESPONSES_SQL} SELECT outcome, model_version, count(*) AS requests FROM r GROUP BY 1, 2")
def _(spark, sf):
    return scoring.outcome_report(responses(spark, sf), "v2")


@query("chat_response_scores", f"WITH {RESPONSES_SQL} SELECT event_id, outcome, CASE WHEN outcome='ok' THEN value/100 END AS score FROM r")
def _(spark, sf):
    return scoring.call_outcomes(responses(spark, sf, True), "v2", True).select("event_id", "outcome", "score")


@query("valid_score_counts", f"WITH {RESPONSES_SQL} SELECT count(*) AS rows, count(*) FILTER (outcome='ok') AS valid, count(*) FILTER (outcome<>'ok') AS invalid FROM r")
def _(spark, sf):
    return scoring.response_consistency(scoring.call_outcomes(responses(spark, sf), "v2"))


COUNTS_SQL = "len(pos) AS positives, coalesce(len(neg),0) AS negatives, coalesce(len(titles),0) AS titles, coalesce(len(clicks),0) AS clicks"


@query("request_round_trip", f"{FEEDS}, {CONTEXT_SQL} SELECT itemid, title, array_to_string(pos,'¦') AS positive, {COUNTS_SQL} FROM ctx")
def _(spark, sf):
    sent = requests.build_payload(flat(spark, sf)).select("candidate.itemid", requests.wrap_chat(F.col("payload"), "ranker").alias("chat"))
    got = requests.normalize_request(sent.select("itemid", requests.unwrap_chat(F.col("chat")).alias("request")))
    return got.select("itemid", F.col("candidates")[0].title.alias("title"), F.array_join("interests.positive", "¦").alias("positive"),
                      F.size("interests.positive").alias("positives"), F.size("interests.negative").alias("negatives"), F.size("history").alias("titles"),
                      F.size("interests.interactions.clicks").alias("clicks"))


@query("legacy_requests", """SELECT doc_id, substr(lang,1,2)||'  [domain='||source||'; strength=0.90]'||'¦'||'low  [strength=0.10]' AS positive, 2 AS titles, 'd'||doc_id AS card FROM documents""")
def _(spark, sf):
    text = F.expr("""concat('{"interests":[{"name":"low","strength":0.1},{"name":" ","strength":1},{"name":"', lang, '","domain":"', source, '","strength":"0.9"}],"shownTitles":["a","","b"],"id":"d', doc_id, '","title":"t"}')""")
    r = requests.normalize_request(table(spark, sf, "documents").select("doc_id", text.alias("request")))
    return r.select("doc_id", F.array_join("interests.positive", "¦").alias("positive"), F.size("history").alias("titles"), F.col("candidates")[0].id.alias("card"))


@query("payload_variants", f"""{FEEDS}, {CONTEXT_SQL}, n AS (SELECT doc_id, count(*) AS g FROM convs GROUP BY doc_id), c AS (SELECT ctx.*, coalesce(g,0) AS g FROM ctx LEFT JOIN n USING (doc_id)),
  k AS (SELECT *, (coalesce(len(clicks),0)>0)::INT+(coalesce(len(ups),0)>0)::INT+(coalesce(len(downs),0)>0)::INT AS e FROM c)
  SELECT itemid||'-baseline' AS itemid, len(pos) AS positives, g AS groups, coalesce(len(titles),0) AS titles FROM k UNION ALL SELECT itemid||'-no_conversations', len(pos), 0, coalesce(len(titles),0) FROM k
  UNION ALL SELECT itemid||'-candidate_only', 0, 0, 0 FROM k UNION ALL SELECT itemid||'-interactions_as_interests', len(pos)+e, g, coalesce(len(titles),0) FROM k""")
def _(spark, sf):
    v = requests.payload_variants(flat(spark, sf))
    return v.select("candidate.itemid", F.size("interests.positive").alias("positives"), F.size("interests.conversations").alias("groups"), F.size("history").alias("titles"))


def text_score(_model, texts):
    return [int(hashlib.md5(t.encode()).hexdigest()[:6], 16) / 16777216.0 for t in texts]


@query("batch_scores", f"""{FEEDS}, {CONTEXT_SQL}, p AS (SELECT itemid, {FULL_SQL} AS prompt FROM ctx) SELECT itemid, round(('0x'||substr(md5(prompt),1,6))::BIGINT/16777216.0::DOUBLE,6) AS score FROM p""")
def _(spark, sf):
    from rankeval.operators import prompts

    p = prompts.full_prompt(F.col("history"), F.col("interests"), F.col("candidate"))
    df = flat(spark, sf).select("candidate.itemid", p.alias("prompt"))
    return rounded(scoring.score_batches(df, lambda: None, text_score).drop("prompt"), ["score"])


def flaky_client(text):
    """Stand-in for a remote scorer: every seventh text always fails."""
    n = int(hashlib.md5(text.encode()).hexdigest()[:6], 16)
    if n % 7 == 0:
        raise TimeoutError("no answer")
    return {"score": n / 16777216.0, "status": 200}


@query("remote_call_scores", """WITH n AS (SELECT doc_id, ('0x'||substr(md5(text),1,6))::BIGINT AS n FROM documents) SELECT doc_id, round(CASE WHEN n%7=0 THEN 0.5 ELSE n/16777216.0::DOUBLE END,6) AS score, n%7=0 AS failed,
  CASE WHEN n%7=0 THEN 2 ELSE 1 END AS attempts FROM n""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    out = scoring.call_scorer(d, flaky_client, retries=2, backoff_s=0.0)
    return rounded(out.select("doc_id", "score", "failed", "attempts"), ["score"])


def hanging_client(text):
    """Stand-in for a remote scorer that sometimes never answers."""
    n = int(hashlib.md5(text.encode()).hexdigest()[:6], 16)
    if n % 97 == 0:
        time.sleep(3600)
    return {"score": n / 16777216.0}


@query("remote_call_time_limit", """WITH n AS (SELECT doc_id, ('0x'||substr(md5(text),1,6))::BIGINT AS n FROM documents) SELECT doc_id, round(CASE WHEN n%97=0 THEN 0.5 ELSE n/16777216.0::DOUBLE END,6) AS score, n%97=0 AS failed FROM n""")
def _(spark, sf):
    """Calls that hang leave neutral rows; eight calls in flight in the whole job."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    out = scoring.call_scorer(d, hanging_client, concurrency=8, retries=1, timeout_s=0.5, slots=4)
    return rounded(out.select("doc_id", "score", "failed"), ["score"])


def shout(_model, lines):
    return [line.upper() for line in lines]


@query("line_batch_job", "SELECT upper(event_type)||' '||event_id AS value FROM events")
def _(spark, sf):
    src, dst = scratch_path(spark, "lines"), scratch_path(spark, "answers")
    e = table(spark, sf, "events")
    e.select(F.explode(F.array(F.concat_ws(" ", "event_type", "event_id"), F.lit("  "))).alias("value")).write.text(src)
    scoring.score_lines(spark, src, dst, lambda: None, shout)
    return spark.read.text(dst)


# ---- sources -------------------------------------------------------------------------------------------------

@query("projected_scan", "SELECT o_orderstatus, count(*) AS n, count(NULL) AS absent, round(sum(o_totalprice),2) AS price FROM orders GROUP BY 1")
def _(spark, sf):
    df = readers.read_parquet(spark, f"{sf}/orders.parquet", {"o_orderstatus": "string", "o_totalprice": "double", "not_there": "string"})
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("not_there").alias("absent"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("projected_scan_mixed_types", """SELECT o_orderkey, CASE o_orderkey%4 WHEN 3 THEN '{"k":'||o_custkey||'}' ELSE o_custkey::VARCHAR END AS customer, CASE WHEN o_orderkey%4<>1 THEN o_totalprice END AS price FROM orders""")
def _(spark, sf):
    """Files that store one column as int, long, text and struct, and one that lacks another column."""
    path, o = scratch_path(spark, "mixed"), table(spark, sf, "orders")
    key = F.col("o_custkey")
    for i, stored in enumerate((key.cast("int"), key.cast("bigint"), key.cast("string"), F.struct(key.cast("bigint").alias("k")))):
        rows = o.where(F.col("o_orderkey") % 4 == i).select("o_orderkey", stored.alias("customer"), F.col("o_totalprice").alias("price"))
        (rows.drop("price") if i == 1 else rows).write.parquet(f"{path}/{i}")
    return readers.read_parquet(spark, path, {"o_orderkey": "bigint", "customer": "string", "price": "double"})


@query("day_scan", f"{IMP} SELECT count(*) AS n, sum(label)::BIGINT AS clicks FROM imp WHERE bizdate='19970310'")
def _(spark, sf):
    return readers.scan_day(spark, impressions(spark, sf), "19970310").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("clicks"))


ORDER_DAYS_SQL = "o AS (SELECT *, strftime(o_orderdate,'%Y%m%d') AS bizdate FROM orders)"


def order_days(spark, sf):
    return table(spark, sf, "orders").withColumn("bizdate", F.date_format("o_orderdate", "yyyyMMdd"))


@query("date_range_counts", f"""WITH {ORDER_DAYS_SQL}, d AS (SELECT strftime(x,'%Y%m%d') AS bizdate FROM range(DATE '1996-02-25', DATE '1996-03-06', INTERVAL 1 DAY) t(x))
  SELECT bizdate, count(o_orderkey) AS n FROM d LEFT JOIN o USING (bizdate) GROUP BY bizdate""")
def _(spark, sf):
    days = readers.date_range(spark, "19960225", "19960305")
    return days.join(order_days(spark, sf), "bizdate", "left").groupBy("bizdate").agg(F.count("o_orderkey").alias("n"))


@query("missing_days", f"""WITH {ORDER_DAYS_SQL}, d AS (SELECT strftime(x,'%Y%m%d') AS bizdate FROM range(DATE '1990-01-01', DATE '2002-01-01', INTERVAL 1 DAY) t(x))
  SELECT bizdate FROM d WHERE bizdate NOT IN (SELECT bizdate FROM o)""")
def _(spark, sf):
    return readers.missing_days(readers.date_range(spark, "19900101", "20011231"), order_days(spark, sf))


@query("ingested_days", f"""WITH {ORDER_DAYS_SQL} SELECT bizdate, count(*) AS n, round(sum(o_totalprice),2) AS price FROM o WHERE bizdate BETWEEN '19960225' AND '19960305' GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "days")
    src = order_days(spark, sf)
    writers.ingest_days(src, path, readers.date_range(spark, "19960225", "19960301"))
    writers.ingest_days(src, path, readers.date_range(spark, "19960228", "19960305"))
    back = readers.read_parquet(spark, path, partitioned=True).withColumn("bizdate", F.col("bizdate").cast("string"))
    return back.groupBy("bizdate").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


PREPARED_SQL = f"""{FEEDS}, {FLAT_SQL}, d AS (SELECT bizdate AS day, count(*) AS rows, sum(label)::BIGINT AS clicks FROM flat WHERE is_tagged=1 AND has_features AND bizdate<>'' GROUP BY 1)"""


@query("prepared_days", f"{PREPARED_SQL} SELECT day, rows, clicks, day>='20240104' AS in_second_run FROM d WHERE day BETWEEN '20240102' AND '20240106'")
def _(spark, sf):
    """Two overlapping runs into one target; each day once, by the run that brought it."""
    path, feeds = scratch_path(spark, "days"), raw_feeds(spark, sf)
    writers.prepare_days(feeds, path, readers.date_range(spark, "20240102", "20240103"), FEED_TAG)
    second = writers.prepare_days(feeds, path, readers.date_range(spark, "20240102", "20240106"), FEED_TAG)
    back = readers.read_parquet(spark, path, partitioned=True).groupBy(F.col("bizdate").cast("string").alias("day")).agg(F.sum("label").alias("clicks"))
    log = writers.ingested(spark, path).select("day", "rows").join(second.select("day", F.lit(True).alias("_s")), "day", "left")
    return log.join(back, "day").select("day", "rows", "clicks", F.coalesce("_s", F.lit(False)).alias("in_second_run"))


@query("jsonl_round_trip", f"""{IMP} SELECT count(*) AS n, sum(label)::BIGINT AS pos, sum(CASE WHEN contains(flight_ids,'URGENT') THEN 1 ELSE 0 END)::BIGINT AS tagged, (count(*)-sum(label))::BIGINT AS neg,
  round(avg(label),6) AS ctr, 0 AS without_user FROM imp""")
def _(spark, sf):
    path = scratch_path(spark, "samples")
    df = impressions(spark, sf).select(
        F.col("feed_id").cast("string").alias("feed_id"), "bizdate", "label", F.col("flight_ids").contains(TAG).cast("int").alias("is_tagged"), "card_type"
    )
    summary = writers.write_samples(df, path)
    back = readers.read_jsonl(spark, path, "feed_id string, user_id string, bizdate string, label int, is_tagged int")
    return rounded(summary, ["ctr"]).withColumn("without_user", back.agg(F.count_if(F.col("user_id").isNull())).scalar())


@query("jsonl_bad_lines", "SELECT count(*) AS lines, count(*) FILTER (doc_id%10=0) AS bad, count(*) FILTER (doc_id%10<>0) AS kept FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "lines")
    d = table(spark, sf, "documents")
    line = F.when(F.col("doc_id") % 10 == 0, F.lit('{"id": 1,')).otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), "text")))
    d.select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.text(path)
    good = readers.read_jsonl(spark, path, "id bigint, text string", {}, "skip").where("id is not null").agg(F.count("*")).scalar()
    return readers.bad_lines(spark, path).agg(F.sum("lines").alias("lines"), F.sum("bad").alias("bad")).withColumn("kept", good)


@query("score_table", f"""{IMP} SELECT row_number() OVER (ORDER BY {KEY_LIST})-1 AS idx, label, quality AS score, bizdate, contains(flight_ids,'URGENT')::INT AS is_tagged, feed_id, user_id FROM imp""")
def _(spark, sf):
    df = impressions(spark, sf).withColumn("is_tagged", F.col("flight_ids").contains(TAG).cast("int"))
    return writers.score_rows(df, "quality", KEYS)


@query("bench_csv_round_trip", """SELECT (user_id%8)::DOUBLE AS concurrency, count(*)::DOUBLE AS requests, round(avg(value),3) AS avg_ms, '{"200":'||count(*) FILTER (event_type<>'error')||',"500":'||count(*) FILTER (event_type='error')||'}' AS status_counts
  FROM events GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "bench")
    levels = reports.latency_summary(calls(spark, sf), ["concurrency"]).select("concurrency", "requests", F.round("avg_ms", 3).alias("avg_ms"), "status_counts")
    writers.write_bench_csv(levels.where("concurrency < 4"), path)
    writers.write_bench_csv(levels.where("concurrency >= 4"), path, append=True)
    return readers.read_bench_csv(spark, path, ["concurrency", "requests", "avg_ms", "status_counts"])


@query("tsv_titles", """SELECT trim(replace(text,chr(10),' ')) AS title, lang||doc_id AS body FROM documents WHERE doc_id%7<>0""")
def _(spark, sf):
    path = scratch_path(spark, "titles")
    d = table(spark, sf, "documents")
    title = one_line(F.col("text"))
    line = F.concat_ws("\t", F.lit("x"), F.lit("1"), F.lit(""), F.lit("u"), title, F.concat("lang", F.col("doc_id").cast("string")))
    d.select(F.when(F.col("doc_id") % 7 == 0, F.lit("too\tfew")).otherwise(line).alias("value")).write.text(path)
    return readers.read_tsv_titles(spark, path).select("title", "body")


@query("upsert_documents", """WITH o AS (SELECT *, o_custkey::VARCHAR AS id FROM orders) SELECT id, o_orderpriority, max(o_orderkey) AS o_orderkey FROM o GROUP BY id, o_orderpriority""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("conversation_id", F.col("o_custkey"))
    rows = writers.prepare_upsert(o, "o_orderpriority", latest=["o_orderkey"])
    path = scratch_path(spark, "store")
    writers.upsert(rows, "parquet", path=path)
    return spark.read.parquet(path).select("id", "o_orderpriority", "o_orderkey")


@query("upsert_twice", """WITH o AS (SELECT o_custkey::VARCHAR AS id, o_orderpriority, max(o_orderkey) AS a, max(o_orderkey) FILTER (o_orderkey%3=0) AS b FROM orders GROUP BY 1, 2)
  SELECT id, o_orderpriority, CASE WHEN b IS NULL THEN a ELSE -b END AS o_orderkey FROM o""")
def _(spark, sf):
    """A later write with the same ids and keys replaces rows, others stay."""
    o = table(spark, sf, "orders").withColumn("conversation_id", F.col("o_custkey")).select("conversation_id", "o_orderpriority", "o_orderkey")
    first = writers.prepare_upsert(o, "o_orderpriority", latest=["o_orderkey"])
    again = writers.prepare_upsert(o.where("o_orderkey % 3 = 0"), "o_orderpriority", latest=["o_orderkey"])
    path, keys = scratch_path(spark, "store"), ["id", "o_orderpriority"]
    store.upsert(first, path, keys, buckets=16)
    store.upsert(again.withColumn("o_orderkey", -F.col("o_orderkey")), path, keys)
    return store.read(spark, path).select("id", "o_orderpriority", "o_orderkey")


@query("upsert_without_ids", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    """Rows alike keep rows of their own."""
    rows = writers.prepare_upsert(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderpriority")
    return rows.dropDuplicates(["id"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("file_rows", "SELECT count(*) AS rows FROM documents")
def _(spark, sf):
    """Rows over all files of a table, each with a size."""
    files = readers.file_profile(table(spark, sf, "documents"))
    return files.where("bytes > 0").agg(F.sum("rows").alias("rows"))


@query("report_lines", "SELECT CASE doc_id%4 WHEN 0 THEN 'ALL ' WHEN 1 THEN 'tagged ' ELSE 'untagged ' END||doc_id||' '||n_chars AS line, doc_id::VARCHAR AS first FROM documents WHERE doc_id%4<>3")
def _(spark, sf):
    path = scratch_path(spark, "log")
    d = table(spark, sf, "documents")
    text = F.expr("concat(case doc_id % 4 when 0 then 'ALL ' when 1 then '  tagged ' when 2 then 'untagged ' else 'x ALL ' end, doc_id, ' ', n_chars, ' ')")
    d.select(text.alias("value")).write.text(path)
    return readers.extract_report_lines(spark, path).select("line", F.get("fields", F.lit(1)).alias("first"))


@query("output_summary", f"""{IMP} SELECT {SLICE} AS output, count(*) AS rows FROM imp GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "outputs")
    tagged(impressions(spark, sf)).withColumnRenamed("slice", "output").write.partitionBy("output").parquet(path)
    return quality.output_summary(spark, path).select("output", "rows")


DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
FIRST_SQL = "SELECT * FROM documents WHERE doc_id=(SELECT min(doc_id) FROM documents)"


def first_document(spark, sf):
    """The first document by id, as the only row of a table."""
    d = table(spark, sf, "documents").select(*DOCUMENT_TYPES)
    return d.where(F.col("doc_id") == d.agg(F.min("doc_id")).scalar())


@query("table_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, substr({c}::VARCHAR,1,200) AS preview FROM ({FIRST_SQL})" for c, t in DOCUMENT_TYPES.items()))
def _(spark, sf):
    return readers.profile_table(first_document(spark, sf))


@query("raw_feed_profile")
def _(spark, sf):
    return readers.profile_table(raw_feeds(spark, sf))


@query("raw_feed_profile_plain_columns", f"""{FEEDS}, one AS (SELECT * FROM feeds WHERE doc_id=(SELECT min(doc_id) FROM documents)) SELECT 'feed_id' AS "column", 'string' AS type, feed_id AS preview FROM one
  UNION ALL SELECT 'user_id', 'string', user_id FROM one UNION ALL SELECT 'bizdate', 'string', bizdate FROM one
  UNION ALL SELECT 'flight_ids', 'string', CASE WHEN doc_id%13<>0 THEN flight_ids END FROM one""")
def _(spark, sf):
    feeds = raw_feeds(spark, sf)
    first = table(spark, sf, "documents").agg(F.min("doc_id")).scalar()
    plain = feeds.where(F.col("feed_id") == F.concat(F.lit("f"), first.cast("string")))
    return readers.profile_table(plain).where(F.col("column").isin("feed_id", "user_id", "bizdate", "flight_ids"))


@query("metric_files", f"""{IMP}, r AS (SELECT item_id%3 AS run, item_id%2 AS ck, CASE WHEN contains(flight_ids,'URGENT') THEN 'tagged' ELSE 'rest' END AS split, label FROM imp)
  SELECT 'r'||run AS run, CASE WHEN ck=0 THEN '?' ELSE 'ckpt_'||ck END AS checkpoint, split, count(*) AS n, sum(label)::BIGINT AS pos, round(avg(label),6) AS ctr FROM r GROUP BY run, ck, split""")
def _(spark, sf):
    """One file of metric rows per run and checkpoint, and one that is no JSON."""
    path = scratch_path(spark, "metrics")
    rows = tagged(impressions(spark, sf)).select((F.col("item_id") % 3).alias("run"), (F.col("item_id") % 2).alias("ck"), F.col("slice").alias("split"), "label")
    per = rows.groupBy("run", "ck", "split").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.round(F.avg("label"), 6).alias("ctr"))
    whole = per.groupBy("run", "ck").agg(F.to_json(F.collect_list(F.struct("split", "n", "pos", "ctr"))).alias("text"))
    name = F.concat(F.lit("eval_r"), F.col("run").cast("string"), F.when(F.col("ck") != 0, F.concat(F.lit("_ckpt_"), F.col("ck").cast("string"))).otherwise(""), F.lit(".json"))
    files = whole.select(name.alias("name"), "text").unionByName(spark.createDataFrame([("eval_bad_1.json", "{nope")], "name string, text string"))
    write_named(files, path)
    return readers.collect_metric_files(spark, f"{path}/eval_*.json").select("run", "checkpoint", "split", "n", "pos", "ctr")


def write_named(files, path):
    """Each row's ``text`` as a file called ``name``: Spark names the files of a folder, so each gets a folder, whose file is renamed."""
    spark = files.sparkSession
    files.repartition("name").write.partitionBy("name").text(f"{path}/by-name")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    for status in fs.globStatus(at(f"{path}/by-name/name=*/part-*")):
        source = status.getPath()
        fs.rename(source, at(f"{path}/{source.getParent().getName().partition('=')[2]}"))


@query("run_logs", """WITH d AS (SELECT doc_id%7 AS run, doc_id, n_chars FROM documents), f AS (SELECT run, max(doc_id) AS last FROM d GROUP BY run)
  SELECT 'run'||run||'.log' AS file, CASE WHEN run<>3 THEN last||'.5' END AS samples_per_second, CASE WHEN run%2=0 THEN last||'.25' END AS steps_per_second, CASE WHEN run%3=0 THEN last::VARCHAR END AS peak_memory,
    CASE WHEN run=5 THEN 'OOM' WHEN run IN (2,4) THEN 'FAIL('||run||')' ELSE 'OK' END AS status FROM f""")
def _(spark, sf):
    """A log per run, each document a few of its lines; the last figures count, and running out of memory wins over an exit code."""
    path = scratch_path(spark, "logs")
    d = table(spark, sf, "documents").select((F.col("doc_id") % 7).alias("run"), "doc_id")
    lines = F.expr("""concat_ws('\n', concat('step ', doc_id), if(run <> 3, concat("{'train_samples_per_second': ", doc_id, '.5}'), null), if(run % 2 = 0, concat('train_steps_per_second=', doc_id, '.25'), null),
        if(run % 3 = 0, concat('max memory: ', doc_id, ' GiB'), null), if(run = 5, 'torch.OutOfMemoryError: x', null))""")
    whole = d.groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", lines.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    write_named(whole.select(F.concat(F.lit("run"), F.col("run").cast("string"), F.lit(".log")).alias("name"), "text"), path)
    codes = spark.createDataFrame([("run2.log", 2), ("run4.log", 4), ("run5.log", 1)], "file string, exit_code int")
    return readers.extract_run_log(spark, f"{path}/run*.log", codes)


# ---- models --------------------------------------------------------------------------------------------------

def train_test(spark, sf):
    narrow = ranked_impressions(spark, sf).select(*KEYS, "flight_ids", "label", "position_rank", *FEATURES)
    df = stage(sampling.split_by(narrow, "feed_id"))
    df = sampling.holdout(debias.ipw_weight(df, debias.propensity(df)), KEYS)
    return df.where("split = 'train'"), df.where("split = 'test'")


@query("ctr_model_report")
def _(spark, sf):
    train, test = train_test(spark, sf)
    scored = models.predict(models.ctr_model(train, FEATURES, validation="is_holdout"), test)
    tag = F.col("flight_ids").contains(TAG)
    area = reports.slice_report(scored, {"ALL": F.lit(True), "tagged": tag, "rest": ~tag}, "score")
    loss = metrics.log_loss(scored.withColumn("split", F.explode(reports.slice_names({"ALL": F.lit(True), "tagged": tag, "rest": ~tag}))), "score", "label", ["split"])
    return area.join(loss, "split")


@query("debias_models")
def _(spark, sf):
    train, test = train_test(spark, sf)
    _, scored = models.debias_models(train, test, FEATURES, validation="is_holdout")
    return models.compare(scored, feed="feed_id")


@query("train_test_matrix")
def _(spark, sf):
    train, test = train_test(spark, sf)
    tag = F.col("flight_ids").contains(TAG)
    return models.train_test_matrix({"full": train, "tagged": train.where(tag)}, {"full": test, "tagged": test.where(tag)}, FEATURES, KEYS)


@query("cross_evaluation")
def _(spark, sf):
    """Three models of all rows and three of the slice on the slice's test rows, two without their position; and what the shown
    order and chance reach."""
    train, test = train_test(spark, sf)
    tag = F.col("flight_ids").contains(TAG)
    fitted = {}
    for name, rows in (("full", train), ("tagged", train.where(tag))):
        some, _ = models.debias_models(rows, test.where(tag), FEATURES, validation="is_holdout")
        fitted |= {f"{name}_{k}": m for k, m in some.items()}
    one = models.cross_eval(fitted, test.where(tag), drop_position=["full_position_aware", "tagged_position_aware"])
    shown = test.where(tag).withColumn("score", -F.col("position_rank").cast("double"))
    chance = test.where(tag).withColumn("score", sampling.stable_hash(42, *KEYS) / F.lit(float(1 << 60)))
    rest = {"shown_order": shown, "random": chance}
    areas = [metrics.auc(d, "score", "label").select(F.lit(n).alias("model"), "auc", "n", "pos", "neg") for n, d in rest.items()]
    return one.unionByName(areas[0].unionByName(areas[1]), allowMissingColumns=True)


@query("feature_importance")
def _(spark, sf):
    """Gain and number of splits of the click model and of all models without position bias."""
    train, test = train_test(spark, sf)
    fitted, _ = models.debias_models(train, test, FEATURES, validation="is_holdout")
    return models.feature_importance(spark, {"click": models.ctr_model(train, FEATURES, validation="is_holdout"), **fitted}, 15)
