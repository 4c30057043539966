"""Flattening, context and prompt queries over documents shaped as raw feeds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rankeval.functions import context as ctx, loose
from rankeval.functions.text import word_count
from rankeval.operators import differences, flatten, prompts, quality, sampling
from rankeval.plans.registry import query, rounded
from rankeval.plans.views import FEED_TAG, FEEDS_SQL, raw_feeds, table
from rankeval.sources import readers
from rankeval.sources.staging import stage, written

FEEDS = "WITH " + FEEDS_SQL
SEP = "¦"


def joined(c):
    return F.array_join(c, SEP)


def jsql(c):
    return f"coalesce(array_to_string({c},'{SEP}'),'')"


def parsed(spark, sf):
    df = raw_feeds(spark, sf)
    return df.select(
        "*",
        loose.json_array(F.col("interests"), ctx.INTEREST).alias("p"),
        loose.json_array(F.col("negative_interests"), ctx.INTEREST).alias("q"),
        loose.json_array(F.col("shown_10d"), ctx.EVENT).alias("s"),
        loose.json_array(F.col("interactions_90d"), ctx.EVENT).alias("x"),
        loose.json_array(F.col("conversation"), ctx.MESSAGE).alias("c"),
    )


@query("interest_texts", f"""{FEEDS} SELECT feed_id, {jsql('pos')} AS positive, {jsql('neg')} AS negative
  FROM feeds LEFT JOIN positive USING (doc_id) LEFT JOIN negative USING (doc_id)""")
def _(spark, sf):
    return parsed(spark, sf).select("feed_id", joined(ctx.interests(F.col("p"))).alias("positive"), joined(ctx.interests(F.col("q"))).alias("negative"))


@query("interest_caps", f"""{FEEDS} SELECT feed_id, {jsql('pos[1:3]')} AS positive, {jsql('neg[1:2]')} AS negative
  FROM feeds LEFT JOIN positive USING (doc_id) LEFT JOIN negative USING (doc_id)""")
def _(spark, sf):
    p, q = ctx.cap_interests(ctx.interests(F.col("p")), ctx.interests(F.col("q")), 3)
    return parsed(spark, sf).select("feed_id", joined(p).alias("positive"), joined(q).alias("negative"))


@query("shown_titles", f"{FEEDS} SELECT feed_id, {jsql('titles')} AS titles FROM feeds LEFT JOIN history USING (doc_id)")
def _(spark, sf):
    return parsed(spark, sf).select("feed_id", joined(ctx.shown_titles(F.col("s"))).alias("titles"))


@query("clicked_titles", f"{FEEDS} SELECT feed_id, {jsql('clicks')} AS titles FROM feeds LEFT JOIN clicks USING (doc_id)")
def _(spark, sf):
    return parsed(spark, sf).select("feed_id", joined(ctx.clicked_titles(F.col("s"))).alias("titles"))


@query("reaction_titles", f"{FEEDS} SELECT feed_id, {jsql('ups')} AS up, {jsql('downs')} AS down FROM feeds LEFT JOIN ups USING (doc_id) LEFT JOIN downs USING (doc_id)")
def _(spark, sf):
    x = F.col("x")
    return parsed(spark, sf).select(
        "feed_id", joined(ctx.reaction_titles(x, "thumbsUp")).alias("up"), joined(ctx.reaction_titles(x, "thumbsDown")).alias("down")
    )


@query("conversation_groups", f"""{FEEDS} SELECT 'f'||doc_id AS feed_id, g, gid AS id, started_at, {jsql('raw_msgs')} AS messages FROM groups_ranked""")
def _(spark, sf):
    g = parsed(spark, sf).select("feed_id", F.posexplode(ctx.group_conversations(F.col("c"))).alias("g", "v"))
    texts = F.transform("v.messages", lambda m: F.concat(F.lit("["), m.author, F.lit("]: "), m.text))
    return g.select("feed_id", (F.col("g") + 1).alias("g"), "v.id", "v.started_at", joined(texts).alias("messages"))


@query("conversation_groups_capped", f"""{FEEDS} SELECT 'f'||doc_id AS feed_id, g, {jsql('raw_msgs[-2:]')} AS messages FROM groups_ranked WHERE g<=2""")
def _(spark, sf):
    g = parsed(spark, sf).select("feed_id", F.posexplode(ctx.group_conversations(F.col("c"), 2, 2)).alias("g", "v"))
    texts = F.transform("v.messages", lambda m: F.concat(F.lit("["), m.author, F.lit("]: "), m.text))
    return g.select("feed_id", (F.col("g") + 1).alias("g"), joined(texts).alias("messages"))


@query("recent_turns", f"""{FEEDS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY made DESC, j) AS rk FROM msgs WHERE author='human'),
  t AS (SELECT doc_id, list(CASE WHEN length(raw_text)>200 THEN substr(raw_text,1,199)||'…' ELSE raw_text END ORDER BY rk) FILTER (raw_text<>'') AS turns FROM r WHERE rk<=3 GROUP BY doc_id)
  SELECT feed_id, {jsql('turns')} AS turns FROM feeds LEFT JOIN t USING (doc_id)""")
def _(spark, sf):
    return parsed(spark, sf).select("feed_id", joined(ctx.recent_turns(F.col("c"), 3)).alias("turns"))


DAY_SQL = "(bizdate='' OR (bizdate>='20240102' AND bizdate<='20240106'))"
FLAT_SQL = f"""flat AS (SELECT c.feed_id, c.user_id, c.bizdate, c.flight_ids, CASE WHEN contains(c.flight_ids,'uniform') THEN 1 ELSE 0 END AS is_tagged, label, itemid, title, summary, quality, has_features, place, c.doc_id
  FROM cards c JOIN positive USING (doc_id))"""


def flat(spark, sf, **kw):
    return flatten.flatten_impressions(raw_feeds(spark, sf), slice_tag=FEED_TAG, **kw)


@query("flatten_impressions", f"""{FEEDS}, {FLAT_SQL} SELECT feed_id, user_id, bizdate, flight_ids, is_tagged, label, itemid, title, summary,
  {jsql('pos')} AS positive, {jsql('titles')} AS history, has_features AS with_features
  FROM flat JOIN positive USING (doc_id) LEFT JOIN history USING (doc_id) WHERE {DAY_SQL}""")
def _(spark, sf):
    df = flat(spark, sf, lo="20240102", hi="20240106")
    return df.select(
        "feed_id", "user_id", "bizdate", "flight_ids", "is_tagged", "label", "candidate.itemid", "candidate.title", "candidate.summary",
        joined(F.col("interests.positive")).alias("positive"), joined(F.transform("history", lambda h: h.title)).alias("history"),
        F.col("features").isNotNull().alias("with_features"),
    )


@query("prepare_day", f"""{FEEDS}, {FLAT_SQL} SELECT feed_id, itemid, label FROM flat WHERE bizdate='20240103' AND is_tagged=1 AND has_features""")
def _(spark, sf):
    return readers.prepare_day(raw_feeds(spark, sf), "20240103", FEED_TAG).select("feed_id", "candidate.itemid", "label")


@query("flatten_require_features", f"""{FEEDS}, {FLAT_SQL} SELECT feed_id, itemid, label FROM flat WHERE has_features AND contains(flight_ids,'uniform')""")
def _(spark, sf):
    return flat(spark, sf, tag=FEED_TAG, require_features=True).select("feed_id", "candidate.itemid", "label")


@query("reconcile_samples", f"""{FEEDS}, {FLAT_SQL} SELECT CASE WHEN bizdate='' THEN 'only_left' ELSE 'both' END AS side, count(*) AS n,
  count(*) FILTER (bizdate<>'' AND NOT (itemid LIKE '%-1' AND has_features)) AS same_features, count(*) FILTER (bizdate<>'') AS same_interests,
  count(*) FILTER (bizdate<>'' AND itemid NOT LIKE '%-2') AS same_label FROM flat GROUP BY 1""")
def _(spark, sf):
    """Q1 over samples with nested fields: the other side lacks undated feeds, some features, and turns some labels."""
    samples = flat(spark, sf).select("feed_id", "candidate.itemid", "bizdate", "label", "features", "interests")
    rows = written(quality.fingerprinted(samples, ["features", "interests"]), "samples")
    left = rows.drop("bizdate")
    right = rows.where("bizdate <> ''").select(
        "feed_id", "itemid", F.when(F.col("itemid").endswith("-2"), 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
        F.when(~F.col("itemid").endswith("-1"), F.col("features")).alias("features"), "interests",
    )
    fields = ["label", "features", "interests"]
    matched = quality.reconcile(left, right, ["feed_id", "itemid"], fields)
    return matched.groupBy("side").agg(F.count("*").alias("n"), *[F.count_if(F.col(f"same_{f}")).alias(f"same_{f}") for f in fields])


# what the other side of a comparison has changed, as Spark makes it and as SQL counts it
CHANGED_SQL = """d AS (SELECT f.*, coalesce(len(titles),0) AS n_titles, len(pos) AS n_pos, coalesce(len(raw_msgs),0) AS n_msgs FROM flat f LEFT JOIN history USING (doc_id) LEFT JOIN positive USING (doc_id)
    LEFT JOIN (SELECT doc_id, raw_msgs FROM groups_ranked WHERE g=1) USING (doc_id) WHERE bizdate<>''),
  c AS (SELECT 'only_left' AS side, NULL AS branch, NULL AS kind, NULL AS path FROM flat WHERE bizdate=''
    UNION ALL SELECT 'both', 'label', 'value', 'label' FROM d WHERE itemid LIKE '%-2'
    UNION ALL SELECT 'both', 'features', 'keys', 'features{novelty}' FROM d WHERE itemid LIKE '%-1' AND has_features
    UNION ALL SELECT 'both', 'candidate.title', 'value', 'candidate.title' FROM d WHERE itemid LIKE '%-0' AND doc_id%4=0
    UNION ALL SELECT 'both', 'history', 'value', 'history[1].title' FROM d WHERE doc_id%3=0 AND n_titles>=2
    UNION ALL SELECT 'both', 'interests.positive', 'size', 'interests.positive['||n_pos||']' FROM d WHERE doc_id%4=1
    UNION ALL SELECT 'both', 'interests.conversations', 'value', 'interests.conversations[0].messages['||(n_msgs-1)||']' FROM d WHERE doc_id%5=2 AND n_msgs>0)"""


def changed(df):
    doc = F.expr("cast(substr(feed_id, 2) as bigint)")
    item = F.col("itemid")
    first = F.col("interests.conversations")[0]
    cut = first.withField("messages", F.slice(first.messages, F.lit(1), F.size(first.messages) - 1))
    conversations = F.when((doc % 5 == 2) & (F.size("interests.conversations") > 0), F.transform("interests.conversations", lambda g, i: F.when(i == 0, cut).otherwise(g)))
    positive = F.when(doc % 4 == 1, F.array_append("interests.positive", F.lit("more")))
    interests = F.col("interests").withField("conversations", F.coalesce(conversations, F.col("interests.conversations")))
    return df.where("bizdate <> ''").select(
        "feed_id", "itemid", F.when(item.endswith("-2"), 1 - F.col("label")).otherwise(F.col("label")).alias("label"),
        F.when(item.endswith("-0") & (doc % 4 == 0), F.col("candidate").withField("title", F.concat("candidate.title", F.lit("!")))).otherwise(F.col("candidate")).alias("candidate"),
        interests.withField("positive", F.coalesce(positive, F.col("interests.positive"))).alias("interests"),
        F.when(doc % 3 == 0, F.transform("history", lambda h, i: F.when(i == 1, h.withField("title", F.concat(h.title, F.lit("?")))).otherwise(h))).otherwise(F.col("history")).alias("history"),
        F.when(item.endswith("-1"), F.map_filter("features", lambda k, _: k != "novelty")).otherwise(F.col("features")).alias("features"),
    )


@query("sample_differences", f"""{FEEDS}, {FLAT_SQL}, {CHANGED_SQL} SELECT side, branch, kind, path, count(*) AS rows FROM c GROUP BY ALL""")
def _(spark, sf):
    """Q1: every kind of change is found in its branch, at its place, and nowhere else."""
    left = flat(spark, sf).withColumn("itemid", F.col("candidate.itemid"))
    found = differences.differences(left, changed(left), ["feed_id", "itemid"], ["label", "candidate", "interests", "history", "features"])
    return found.groupBy("side", "branch", "kind", "path").agg(F.count("*").alias("rows"))


@query("feed_cap", f"""{FEEDS}, {FLAT_SQL}, k AS (SELECT DISTINCT feed_id FROM flat ORDER BY feed_id LIMIT 25) SELECT feed_id, itemid, label FROM flat JOIN k USING (feed_id)""")
def _(spark, sf):
    return flat(spark, sf, max_feeds=25).select("feed_id", "candidate.itemid", "label")


@query("feed_cap_half", f"""{FEEDS}, {FLAT_SQL}, k AS (SELECT DISTINCT feed_id FROM flat ORDER BY feed_id LIMIT (SELECT count(DISTINCT feed_id)//2 FROM flat)) SELECT feed_id, itemid, label FROM flat JOIN k USING (feed_id)""")
def _(spark, sf):
    """P21 with a cap of half of all feeds."""
    feeds = flatten.feed_records(raw_feeds(spark, sf), require_interests=True).count()
    return flat(spark, sf, max_feeds=feeds // 2).select("feed_id", "candidate.itemid", "label")


@query("feed_records", f"""{FEEDS} SELECT feed_id, bizdate, list(itemid ORDER BY place)::VARCHAR AS items, list(label ORDER BY place)::VARCHAR AS labels FROM cards GROUP BY feed_id, bizdate""")
def _(spark, sf):
    r = flatten.feed_records(raw_feeds(spark, sf))
    return r.select("feed_id", "bizdate", F.transform("candidates", lambda c: c.itemid).cast("string").alias("items"),
                    F.transform("candidates", lambda c: c.is_clicked.cast("int")).cast("string").alias("labels"))


@query("records_exploded", f"{FEEDS} SELECT feed_id, itemid, title, label FROM cards")
def _(spark, sf):
    return flatten.explode_records(flatten.feed_records(raw_feeds(spark, sf))).select("feed_id", "candidate.itemid", "candidate.title", "label")


@query("date_split", f"""{FEEDS}, s AS (SELECT feed_id, CASE WHEN bizdate='' THEN NULL WHEN bizdate<='20240104' THEN 'train' WHEN bizdate>='20240106' THEN 'eval' END AS split FROM feeds)
  SELECT split, count(*) AS feeds FROM s WHERE split IS NOT NULL GROUP BY split""")
def _(spark, sf):
    return flatten.date_split(raw_feeds(spark, sf), "20240104", "20240106").groupBy("split").agg(F.count("*").alias("feeds"))


@query("date_filter_blank_rules", f"""{FEEDS} SELECT count(*) FILTER (bizdate='' OR bizdate BETWEEN '20240102' AND '20240104') AS blank_kept,
  count(*) FILTER (bizdate BETWEEN '20240102' AND '20240104') AS blank_dropped FROM feeds""")
def _(spark, sf):
    d = F.col("bizdate")
    return raw_feeds(spark, sf).agg(
        F.count_if(flatten.date_between(d, "20240102", "20240104")).alias("blank_kept"),
        F.count_if(flatten.date_between(d, "20240102", "20240104", keep_blank=False)).alias("blank_dropped"),
    )


@query("tag_filter_and_flag", f"{FEEDS} SELECT contains(flight_ids,'uniform')::INT AS is_tagged, count(*) AS feeds FROM feeds GROUP BY 1")
def _(spark, sf):
    flag = F.coalesce(flatten.has_tag(F.col("flight_ids"), FEED_TAG), F.lit(False)).cast("int").alias("is_tagged")
    return raw_feeds(spark, sf).groupBy(flag).agg(F.count("*").alias("feeds"))


@query("four_way_outputs", f"""{FEEDS}, {FLAT_SQL}, o AS (SELECT *, bizdate='' OR bizdate BETWEEN '20240102' AND '20240104' AS tr, (bizdate='' OR bizdate>='20240105') AND has_features AS ev FROM flat)
  SELECT output, count(*) AS n, sum(label)::BIGINT AS pos FROM (SELECT 'train_all' AS output, label FROM o WHERE tr UNION ALL SELECT 'train_tagged', label FROM o WHERE tr AND is_tagged=1
    UNION ALL SELECT 'eval_all', label FROM o WHERE ev UNION ALL SELECT 'eval_tagged', label FROM o WHERE ev AND is_tagged=1) GROUP BY output""")
def _(spark, sf):
    out = flatten.four_way(flat(spark, sf), "20240102", "20240104", "20240105", FEED_TAG)
    return out.groupBy("output").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))


@query("funnel", f"""{FEEDS}, u AS (SELECT doc_id, bizdate, (SELECT count(*) FROM cards c WHERE c.doc_id=f.doc_id) AS shown,
    (SELECT count(*) FROM cards c WHERE c.doc_id=f.doc_id AND has_features) AS kept, doc_id%5+1 AS cands,
    EXISTS (SELECT 1 FROM positive p WHERE p.doc_id=f.doc_id) AS interested FROM feeds f), p AS (SELECT * FROM u WHERE {DAY_SQL})
  SELECT (SELECT count(*) FROM feeds) AS feeds_seen, count(*) FILTER (kept>0) AS feeds_kept, sum(cands)::BIGINT AS candidates, sum(shown)::BIGINT AS impressions_seen,
    sum(kept)::BIGINT AS impressions_kept, (sum(kept) FILTER (interested))::BIGINT AS samples FROM p""")
def _(spark, sf):
    return flatten.funnel(raw_feeds(spark, sf), "20240102", "20240106", require_features=True)


@query("feature_vectors_strict", f"""{FEEDS}, {FLAT_SQL} SELECT itemid, round(quality,6) AS quality, 0.5::DOUBLE AS novelty, 1.0::DOUBLE AS extra, 0.0::DOUBLE AS absent FROM flat WHERE has_features""")
def _(spark, sf):
    out = flatten.feature_columns(flat(spark, sf), "features", ["quality", "novelty", "extra", "absent"])
    return out.select("candidate.itemid", F.round("quality", 6).alias("quality"), "novelty", "extra", "absent")


@query("feature_vectors_falsy_and_strict_text", f"""{FEEDS}, {FLAT_SQL} SELECT 'falsy' AS policy, count(*) AS n FROM flat WHERE has_features AND doc_id%9<>0
  UNION ALL SELECT 'strict', 0 UNION ALL SELECT 'coalesce', count(*) FROM flat""")
def _(spark, sf):
    df = stage(flat(spark, sf).select("features"))  # read by three passes
    one = lambda p: flatten.feature_columns(df, "features", ["quality", "note"], p).agg(F.lit(p).alias("policy"), F.count("*").alias("n"))
    return one("falsy").unionByName(one("strict")).unionByName(one("coalesce"))


@query("rich_rows", f"""{FEEDS}, {FLAT_SQL} SELECT feed_id, itemid FROM flat JOIN negative USING (doc_id) JOIN clicks USING (doc_id) JOIN ups USING (doc_id) JOIN downs USING (doc_id) JOIN history USING (doc_id)
  WHERE title<>'' AND doc_id IN (SELECT doc_id FROM convs)""")
def _(spark, sf):
    return flat(spark, sf).where(flatten.is_rich()).select("feed_id", "candidate.itemid")


@query("generic_explode", """WITH h AS (SELECT user_id % 50 AS u, * FROM events), x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
  SELECT doc_id, i, trim(ls[i+1]) AS title, CASE WHEN i%2=0 THEN 1 ELSE 0 END AS label, least(len(ls),3) AS history_len, ls[len(ls)] AS last_title FROM (SELECT *, unnest(range(len(ls))) AS i FROM x)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    rows = d.select(
        "doc_id",
        F.expr("transform(ls, l -> named_struct('title', l, 'summary', ''))").alias("history"),
        F.lit("news").alias("interests"),
        F.expr("transform(ls, (l, i) -> named_struct('title', trim(l), 'summary', cast(i as string), 'clicked', if(i % 2 = 0, 1, 0)))").alias("items"),
    )
    out = flatten.flatten_generic(rows, 3)
    return out.select("doc_id", F.col("candidate.summary").cast("bigint").alias("i"), "candidate.title", "label", F.size("history").alias("history_len"),
                      F.expr("element_at(history, -1).title").alias("last_title"))


# ---- prompts -------------------------------------------------------------------------------------------------

NUM = "array_to_string([{fmt} FOR x, n IN {lst}], chr(10))"
CONTEXT_SQL = f"""{FLAT_SQL}, conv AS (SELECT doc_id, string_agg('  Conversation '||g||' ('||substr(replace(started_at,'T',' '),1,16)||'):'||array_to_string(list_transform(msgs, lambda m: chr(10)||'    '||m),''), chr(10) ORDER BY g) AS conv,
    count(*) AS n_conv FROM groups_ranked GROUP BY doc_id),
  ctx AS (SELECT f.*, p.pos, n.neg, h.titles, c.clicks, u.ups, d.downs, v.conv FROM flat f LEFT JOIN positive p USING (doc_id) LEFT JOIN negative n USING (doc_id) LEFT JOIN history h USING (doc_id)
    LEFT JOIN clicks c USING (doc_id) LEFT JOIN ups u USING (doc_id) LEFT JOIN downs d USING (doc_id) LEFT JOIN conv v USING (doc_id))"""


def numbered_sql(lst, body="x"):
    return f"array_to_string(list_transform({lst}, lambda x, i: '  '||i||'. '||{body}), chr(10))"


def bullets_sql(lst, head, mark="  - "):
    return f"CASE WHEN len({lst})>0 THEN '{head}'||array_to_string(list_transform({lst}, lambda x: chr(10)||'{mark}'||x),'') END"


HANG = "regexp_replace(x, '\\n *', chr(10)||'    ', 'g')"
INTER_SQL = "coalesce(nullif(concat_ws(chr(10), " + ", ".join([
    bullets_sql("ups", "USER_INTERACTIONS (positive signals, thumbs-up card titles):"),
    bullets_sql("downs", "USER_INTERACTIONS (negative signals, thumbs-down card titles):"),
    bullets_sql("clicks", "USER_INTERACTIONS (click signals, clicked card titles):"),
]) + "),''),'USER_INTERACTIONS: (none)')"
FULL_SQL = f"""concat_ws(chr(10), '{prompts.INTRO}', 'USER_INTERESTS (positive, ranked by strength):', {numbered_sql('pos', HANG)},
   CASE WHEN len(neg)>0 THEN 'USER_INTERESTS (negative, avoid):'||chr(10)||{numbered_sql('neg', HANG)} END, '', {INTER_SQL}, '',
   CASE WHEN conv IS NULL THEN 'CONVERSATIONS: (none)' ELSE 'CONVERSATIONS (recent groups, newest first):'||chr(10)||conv END, '',
   CASE WHEN len(titles)>0 THEN 'SHOWN_CARDS (last '||len(titles)||' cards shown to the user on previous days):'||chr(10)||{numbered_sql('titles')} ELSE 'SHOWN_CARDS: (none)' END, '',
   'CANDIDATE_ITEM:', '  title: '||title, CASE WHEN summary<>'' THEN '  summary: '||summary END, '', '{prompts.QUESTION}')"""


@query("full_prompt", f"{FEEDS}, {CONTEXT_SQL} SELECT itemid, {FULL_SQL} AS prompt FROM ctx")
def _(spark, sf):
    p = prompts.full_prompt(F.col("history"), F.col("interests"), F.col("candidate"))
    return flat(spark, sf).select("candidate.itemid", p.alias("prompt"))


COMPACT_SQL = f"""concat_ws(chr(10)||chr(10), '{prompts.SHORT_INTRO}',
  concat_ws(chr(10), {bullets_sql('pos', 'USER_INTERESTS (positive):')}, {bullets_sql('neg', 'USER_INTERESTS (negative):')}),
  nullif(concat_ws(chr(10), {bullets_sql('clicks[1:20]', 'USER_INTERACTIONS (clicks):')}, {bullets_sql('ups[1:10]', 'USER_INTERACTIONS (thumbs up):')}, {bullets_sql('downs[1:10]', 'USER_INTERACTIONS (thumbs down):')}),''),
  'RECENT_CONVERSATIONS:'||talk, {bullets_sql('titles[1:30]', 'SHOWN_CARDS (recent):')},
  concat_ws(chr(10), 'CANDIDATE:', CASE WHEN title<>'' THEN '  Title: '||title END, CASE WHEN summary<>'' THEN '  Summary: '||summary END), '{prompts.SHORT_QUESTION}')"""
TALK_SQL = """talk AS (SELECT doc_id, string_agg(array_to_string(list_transform(raw_msgs[-3:], lambda m: chr(10)||'  '||m),''), '' ORDER BY g) AS talk FROM groups_ranked WHERE g<=5 GROUP BY doc_id)"""


@query("compact_prompt", f"{FEEDS}, {CONTEXT_SQL}, {TALK_SQL} SELECT itemid, {COMPACT_SQL} AS prompt FROM ctx LEFT JOIN talk USING (doc_id)")
def _(spark, sf):
    p = prompts.compact_prompt(F.col("interests"), F.transform("history", lambda h: h.title), F.col("candidate"))
    return flat(spark, sf).select("candidate.itemid", p.alias("prompt"))


@query("capped_prompt", f"""{FEEDS}, {CONTEXT_SQL}, talk AS (SELECT doc_id, string_agg(array_to_string(list_transform(raw_msgs[-6:], lambda m: chr(10)||'  '||replace(m,']: ','] ')),'') , '' ORDER BY g) AS talk FROM groups_ranked WHERE g<=5 GROUP BY doc_id)
  SELECT itemid, concat_ws(chr(10)||chr(10), {bullets_sql('pos[1:30]', 'USER_INTERESTS:', '- ')}, {bullets_sql('titles[1:30]', 'SHOWN_CARDS:', '- ')}, 'RECENT_CONVERSATIONS:'||talk,
    concat_ws(chr(10), 'CANDIDATE:', 'Title: '||title, CASE WHEN summary<>'' THEN 'Summary: '||summary END), '{prompts.CAPPED_QUESTION}') AS prompt FROM ctx LEFT JOIN talk USING (doc_id)""")
def _(spark, sf):
    c = F.col("interests")
    p = prompts.capped_prompt(c.positive, F.transform("history", lambda h: h.title), c.conversations, F.col("candidate"))
    return flat(spark, sf).select("candidate.itemid", p.alias("prompt"))


@query("generic_prompt", f"""{FEEDS}, {CONTEXT_SQL} SELECT itemid, concat_ws(chr(10), 'User interests: '||user_id, CASE WHEN len(titles)>0 THEN 'User reading history:'||array_to_string(list_transform(titles, lambda x, i: chr(10)||i||'. '||x),'')
    ELSE 'User reading history: (none)' END, '', 'Candidate item:', title||CASE WHEN summary<>'' THEN ' - '||summary ELSE '' END, '', '{prompts.GENERIC_QUESTION}') AS prompt FROM ctx""")
def _(spark, sf):
    p = prompts.generic_prompt(F.col("history"), F.col("user_id"), F.col("candidate"))
    return flat(spark, sf).select("candidate.itemid", p.alias("prompt"))


def full_at(titles, conv):
    """SQL text of the full prompt with other titles and conversation text."""
    own = FULL_SQL.replace("len(titles)", f"len({titles})").replace("list_transform(titles", f"list_transform({titles}")
    return own.replace("conv IS NULL", f"{conv} IS NULL").replace("chr(10)||conv END", f"chr(10)||{conv} END")


BUDGET_SQL = f"""{FEEDS}, {CONTEXT_SQL}, gl AS (SELECT doc_id, list('  Conversation '||g||' ('||substr(replace(started_at,'T',' '),1,16)||'):'||array_to_string(list_transform(msgs, lambda m: chr(10)||'    '||m),'') ORDER BY g) AS gl FROM groups_ranked GROUP BY doc_id),
  base AS (SELECT ctx.*, gl, coalesce(len(titles),0) AS n, coalesce(len(gl),0) AS m FROM ctx LEFT JOIN gl USING (doc_id)),
  steps AS (SELECT *, unnest(list_concat([{{'h': n, 'c': m}}],
      CASE WHEN n>0 THEN list_transform(range(1, floor(log2(n))::BIGINT+2), lambda i: {{'h': (n // (2**i)::BIGINT), 'c': m}}) ELSE [] END,
      list_transform(range(1, m+1), lambda i: {{'h': 0::BIGINT, 'c': m-i}}))) AS s FROM base),
  numbered AS (SELECT *, titles[1:s.h] AS titles2, CASE WHEN s.c>0 THEN array_to_string(gl[1:s.c], chr(10)) END AS conv2, row_number() OVER (PARTITION BY itemid ORDER BY s.h DESC, s.c DESC)-1 AS k FROM steps),
  texts AS (SELECT itemid, k, n, m, s.h AS h, s.c AS c, {full_at('titles2', 'conv2')} AS prompt FROM numbered),
  tried AS (SELECT *, (k=0 AND length(prompt)<=700) OR len(regexp_extract_all(prompt,'\\S+'))<=280 AS fits FROM texts),
  chosen AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY itemid ORDER BY CASE WHEN fits THEN k ELSE 1000-k END)=1),
  budgeted AS (SELECT itemid, prompt, NOT (fits AND k=0) AS truncated, CASE WHEN fits THEN n-h ELSE n END AS dropped_history, CASE WHEN fits THEN m-c ELSE m END AS dropped_conversations FROM chosen)"""


@query("budgeted_prompt", f"{BUDGET_SQL} SELECT * FROM budgeted")
def _(spark, sf):
    out = prompts.budgeted_prompt(flat(spark, sf), 400)
    return out.select("candidate.itemid", "truncated", "dropped_history", "dropped_conversations", "prompt")


def count_words(text):
    """A counter outside the JVM; a tokenizer would stand here."""
    return len(re.findall(r"[^ \t\n\r\f\v]+", text))


@query("budgeted_prompt_ledger", f"{BUDGET_SQL} SELECT * EXCLUDE prompt, md5(prompt) AS prompt, true AS few_renders FROM budgeted")
def _(spark, sf):
    """The same prompts where tokens are counted in Python, with at most four texts put together for one."""
    out = prompts.budgeted_prompt_with(flat(spark, sf), 400, count_words, renders="renders")
    return out.select("candidate.itemid", "truncated", "dropped_history", "dropped_conversations", F.md5("prompt").alias("prompt"), (F.col("renders") <= 4).alias("few_renders"))


@query("prompt_fast_path", f"""{FEEDS}, {CONTEXT_SQL}, p AS (SELECT itemid, {FULL_SQL} AS prompt FROM ctx) SELECT itemid, prompt, false AS truncated FROM p
  WHERE length(prompt)<=700 OR len(regexp_extract_all(prompt, '\\S+'))<=280""")
def _(spark, sf):
    out = prompts.budgeted_prompt(flat(spark, sf), 400)
    return out.where("not truncated").select("candidate.itemid", "prompt", "truncated")


@query("truncation_stats", f"""{BUDGET_SQL} SELECT count(*) AS n, count(*) FILTER (truncated) AS truncated, round(count(*) FILTER (truncated)/greatest(1,count(*)),6) AS rate,
  round((sum(dropped_history) FILTER (truncated))/greatest(1,count(*) FILTER (truncated)),6) AS avg_dropped_history, round((sum(dropped_conversations) FILTER (truncated))/greatest(1,count(*) FILTER (truncated)),6) AS avg_dropped_conversations FROM budgeted""")
def _(spark, sf):
    out = prompts.truncation_stats(prompts.budgeted_prompt(flat(spark, sf), 400))
    return rounded(out, ["rate", "avg_dropped_history", "avg_dropped_conversations"])


WORDS_OF = "len(regexp_extract_all({0}, '\\S+'))"
GREEDY_SQL = f"""{FEEDS}, {CONTEXT_SQL}, {TALK_SQL}, b AS (SELECT itemid,
    concat_ws(chr(10), 'CANDIDATE:', CASE WHEN title<>'' THEN '  Title: '||title END, CASE WHEN summary<>'' THEN '  Summary: '||summary END) AS card,
    [concat_ws(chr(10), {bullets_sql('pos', 'USER_INTERESTS (positive):')}, {bullets_sql('neg', 'USER_INTERESTS (negative):')}),
     concat_ws(chr(10), {bullets_sql('clicks[1:20]', 'USER_INTERACTIONS (clicks):')}, {bullets_sql('ups[1:10]', 'USER_INTERACTIONS (thumbs up):')}, {bullets_sql('downs[1:10]', 'USER_INTERACTIONS (thumbs down):')}),
     coalesce({bullets_sql('titles[1:30]', 'SHOWN_CARDS (recent):')},''), coalesce('RECENT_CONVERSATIONS:'||talk,'')] AS secs FROM ctx LEFT JOIN talk USING (doc_id)),
  f AS (SELECT *, '{prompts.SHORT_INTRO}'||chr(10)||chr(10)||card||chr(10)||chr(10)||'{prompts.SHORT_QUESTION}' AS fixed FROM b),
  l AS (SELECT *, 200-{WORDS_OF.format('fixed')} AS room FROM f),
  s AS (SELECT itemid, room, unnest(range(1,5)) AS k, unnest(secs) AS sec FROM l),
  c AS (SELECT *, sum({WORDS_OF.format('sec')}) OVER (PARTITION BY itemid ORDER BY k) AS upto, {WORDS_OF.format('sec')} AS own FROM s WHERE sec<>''),
  bad AS (SELECT itemid, min(k) AS k FROM c WHERE upto>room GROUP BY itemid),
  ln AS (SELECT c.itemid, room-(upto-own) AS room, i, line, {WORDS_OF.format('line')} AS w FROM (SELECT c.*, unnest(string_split(sec,chr(10))) AS line, unnest(range(len(string_split(sec,chr(10))))) AS i FROM c JOIN bad USING (itemid, k)) c),
  lt AS (SELECT *, sum(w) OVER (PARTITION BY itemid ORDER BY i) AS upto FROM ln),
  part AS (SELECT itemid, string_agg(line, chr(10) ORDER BY i) AS part FROM lt WHERE upto<=room GROUP BY itemid),
  whole AS (SELECT c.itemid, string_agg(sec, chr(10)||chr(10) ORDER BY c.k) AS whole FROM c LEFT JOIN bad ON bad.itemid=c.itemid WHERE bad.k IS NULL OR c.k<bad.k GROUP BY c.itemid)
  SELECT itemid, CASE WHEN room<=0 THEN fixed ELSE concat_ws(chr(10)||chr(10), '{prompts.SHORT_INTRO}', whole, part, card, '{prompts.SHORT_QUESTION}') END AS prompt, {WORDS_OF.format("CASE WHEN room<=0 THEN fixed ELSE concat_ws(chr(10)||chr(10), '" + prompts.SHORT_INTRO + "', whole, part, card, '" + prompts.SHORT_QUESTION + "') END")} AS tokens
  FROM l LEFT JOIN whole USING (itemid) LEFT JOIN part USING (itemid)"""


@query("greedy_prompt", GREEDY_SQL)
def _(spark, sf):
    p = prompts.greedy_prompt(F.col("interests"), F.transform("history", lambda h: h.title), F.col("candidate"), 200)
    return flat(spark, sf).select("candidate.itemid", p.alias("prompt"), word_count(p).alias("tokens"))


@query("shrink_prompt")
def _(spark, sf):
    return prompts.shrink_prompt(flat(spark, sf), 400, 300).select("candidate.itemid", "tokens", "drops.*", "prompt")


@query("prompt_parity", f"""{FEEDS}, {CONTEXT_SQL}, {TALK_SQL}, b AS (SELECT itemid, {FULL_SQL} AS a, {COMPACT_SQL} AS b FROM ctx LEFT JOIN talk USING (doc_id)),
  s AS (SELECT *, string_split(a, chr(10)) AS la, string_split(b, chr(10)) AS lb FROM b)
  SELECT itemid, length(a) AS chars_a, length(b) AS chars_b, len(regexp_extract_all(a,'\\S+')) AS tokens_a, len(regexp_extract_all(b,'\\S+')) AS tokens_b, len(la) AS lines_a, len(lb) AS lines_b,
    contains(a,'CANDIDATE_ITEM') AS item_in_a, contains(b,'CANDIDATE_ITEM') AS item_in_b,
    len(list_filter(range(1, greatest(len(la),len(lb))+1), lambda i: coalesce(la[i],'(end)')<>coalesce(lb[i],'(end)'))) AS differing_lines FROM s""")
def _(spark, sf):
    df = flat(spark, sf)
    a = prompts.full_prompt(F.col("history"), F.col("interests"), F.col("candidate"))
    b = prompts.compact_prompt(F.col("interests"), F.transform("history", lambda h: h.title), F.col("candidate"))
    both = df.select("candidate.itemid", a.alias("a"), b.alias("b"))
    out = both.withColumn("r", prompts.prompt_parity(F.col("a"), F.col("b"), ["CANDIDATE_ITEM"]))
    return out.select("itemid", "r.chars_a", "r.chars_b", "r.tokens_a", "r.tokens_b", "r.lines_a", "r.lines_b",
                      F.expr("r.markers[0].in_a").alias("item_in_a"), F.expr("r.markers[0].in_b").alias("item_in_b"), "r.differing_lines")


@query("training_text", f"""{FEEDS}, {FLAT_SQL}, w AS (SELECT sum(label) AS p, sum(1-label) AS n FROM flat) SELECT itemid, CASE WHEN label=1 THEN title||' Yes' ELSE title||' No' END AS text,
  round(CASE WHEN label=1 THEN (p+n)/(2.0::DOUBLE*p) ELSE (p+n)/(2.0::DOUBLE*n) END,6) AS weight FROM flat, w""")
def _(spark, sf):
    df = written(flat(spark, sf).select("candidate.itemid", F.col("candidate.title").alias("prompt"), "label"), "titles")  # read twice
    out = prompts.training_text(df, sampling.class_weights(df))
    return rounded(out.select("itemid", "text", "weight"), ["weight"])


@query("group_prompt", f"""{FEEDS}, {CONTEXT_SQL}, one AS (SELECT doc_id, any_value(pos) AS pos, any_value(ups) AS ups, any_value(downs) AS downs, any_value(clicks) AS clicks, any_value(titles) AS titles, feed_id, user_id,
    string_agg('  - Card '||r||':'||chr(10)||'    - Id: '||itemid||chr(10)||'    - Title: '||title||chr(10)||'    - Summary: '||summary, chr(10) ORDER BY r) AS cards
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM ctx) GROUP BY doc_id, feed_id, user_id)
  SELECT feed_id, concat_ws(chr(10), '- BLENDED_GROUPS:', '  Group 0:', '  - MatchedInterest: '||user_id, cards, '- USER_INTERESTS:'||array_to_string(list_transform(pos, lambda x: chr(10)||'  - '||x),''), '- USER_INTERACTIONS:',
    coalesce(nullif(concat_ws(chr(10), {bullets_sql('ups', '  - Positive signals (thumbs up article titles):', '    - ')}, {bullets_sql('downs', '  - Negative signals (thumbs down article titles):', '    - ')},
      {bullets_sql('clicks', '  - Click signals (clicked card titles):', '    - ')}),''),'  No user interactions found.'),
    '- SHOWN_CARDS:', coalesce(nullif(array_to_string(list_transform(titles, lambda x: '  - '||x), chr(10)),''),' No shown cards found.')) AS prompt FROM one""")
def _(spark, sf):
    r = flatten.feed_records(raw_feeds(spark, sf)).where(F.size("interests.positive") > 0)
    cards = F.transform("candidates", lambda c: F.struct(c.itemid.alias("id"), c.title.alias("title"), c.summary.alias("summary")))
    groups = F.array(F.struct(F.col("user_id").alias("matched_interest"), cards.alias("cards")))
    return r.select("feed_id", prompts.group_prompt(groups, F.col("interests"), F.col("shown_titles")).alias("prompt"))


@query("group_prompt_whole", f"""{FEEDS}, {CONTEXT_SQL}, one AS (SELECT doc_id, any_value(pos) AS pos, any_value(neg) AS neg, any_value(conv) AS conv, any_value(ups) AS ups, any_value(downs) AS downs, any_value(clicks) AS clicks, any_value(titles) AS titles, feed_id, user_id, bizdate,
    string_agg('  - Card '||r||':'||chr(10)||'    - Id: '||itemid||chr(10)||'    - Title: '||title||chr(10)||'    - Summary: '||summary, chr(10) ORDER BY r) AS cards
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM ctx) GROUP BY doc_id, feed_id, user_id, bizdate)
  SELECT feed_id, md5(concat_ws(chr(10), '- BLENDED_GROUPS:', '  Group 0:', '  - MatchedInterest: '||user_id, cards, '- USER_INTERESTS:', '{prompts.GROUP_TALK}', coalesce(conv,'  (none)')||array_to_string(list_transform(pos, lambda x: chr(10)||'  - '||x),''),
    {bullets_sql('neg', prompts.GROUP_NEGATIVE, '    - ')}, '- USER_INTERACTIONS:',
    coalesce(nullif(concat_ws(chr(10), {bullets_sql('ups', '  - Positive signals (thumbs up article titles):', '    - ')}, {bullets_sql('downs', '  - Negative signals (thumbs down article titles):', '    - ')},
      {bullets_sql('clicks', '  - Click signals (clicked card titles):', '    - ')}),''),'  No user interactions found.'),
    '- SHOWN_CARDS:', coalesce(nullif(array_to_string(list_transform(titles, lambda x: '  - '||x), chr(10)),''),' No shown cards found.'), '{prompts.GROUP_NOW}'||bizdate, '{prompts.GROUP_PLACE}'||user_id)) AS prompt FROM one""")
def _(spark, sf):
    """R9 with conversations, negative interests, time and place."""
    r = flatten.feed_records(raw_feeds(spark, sf)).where(F.size("interests.positive") > 0)
    cards = F.transform("candidates", lambda c: F.struct(c.itemid.alias("id"), c.title.alias("title"), c.summary.alias("summary")))
    groups = F.array(F.struct(F.col("user_id").alias("matched_interest"), cards.alias("cards")))
    text = prompts.group_prompt(groups, F.col("interests"), F.col("shown_titles"), F.col("bizdate"), F.col("user_id"), whole=True)
    return r.select("feed_id", F.md5(text).alias("prompt"))


# ---- conversations -------------------------------------------------------------------------------------------

TURNS_SQL = """t AS (SELECT conv_id//8 AS feed, conv_id, turn, row_number() OVER (PARTITION BY conv_id//8 ORDER BY conv_id, turn) AS j, '2024-02-'||lpad(((conv_id*5+turn)%28+1)::VARCHAR,2,'0')||'T00:00:00Z' AS made,
    replace(trim(text, ' '||chr(9)||chr(10)||chr(13)), chr(10), ' ') AS line, CASE WHEN length(line)>220 THEN substr(line,1,219)||'…' ELSE line END AS text FROM conversations),
  g AS (SELECT feed, conv_id, min(made) AS started_at, min(j) AS first_j, count(*) FILTER (text<>'') AS messages, list(text ORDER BY made, j) FILTER (text<>'') AS texts FROM t GROUP BY feed, conv_id HAVING count(*) FILTER (text<>'')>0),
  r AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY started_at DESC, first_j) AS rk FROM g)"""


@query("conversation_table_groups", f"""WITH {TURNS_SQL} SELECT feed, rk AS g, conv_id::VARCHAR AS id, started_at, messages, md5(texts[len(texts)]) AS last FROM r""")
def _(spark, sf):
    """T5, W4, O4 over the table of conversations: eight of them are one user's."""
    c = table(spark, sf, "conversations")
    made = F.expr("concat('2024-02-', lpad(cast((conv_id * 5 + turn) % 28 + 1 as string), 2, '0'), 'T00:00:00Z')")
    author = F.when(F.col("role") == "user", "human").otherwise(F.col("role"))
    message = F.struct(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("conversation_id"), F.concat_ws("-", "conv_id", "turn").alias("message_id"),
        made.alias("createdAt"), author.alias("author"), "text")
    feeds = c.groupBy(F.expr("conv_id div 8").alias("feed")).agg(F.to_json(F.sort_array(F.collect_list(message))).alias("conversation"))
    groups = ctx.group_conversations(loose.json_array(F.col("conversation"), ctx.MESSAGE))
    g = feeds.select("feed", F.posexplode(groups).alias("g", "v"))
    return g.select("feed", (F.col("g") + 1).alias("g"), "v.id", "v.started_at", F.size("v.messages").cast("bigint").alias("messages"), F.md5(F.element_at("v.messages", -1)["text"]).alias("last"))
