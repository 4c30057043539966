"""The given tables in the shapes the operators work on, with the same shapes as DuckDB SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankeval.operators.metrics import position_rank
from rankeval.sources.staging import spread

FEATURES = ["quality", "worthiness", "click_likelihood", "novelty"]
TAG = "URGENT"
POSITION_ORDER = ["section_index", "item_id", "supp_id", "ship_date"]
ROW_KEY = ["feed_id", "section_index", "item_id", "supp_id", "ship_day"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per shown card: line items with their order (feed) and part (card).

    Orders are joined last: rows then lie by feed, as most readers want them next.
    """
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return (
        li.join(p, F.col("l_partkey") == F.col("p_partkey"))
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("feed_id"),
            F.col("o_custkey").alias("user_id"),
            F.date_format("o_orderdate", "yyyyMMdd").alias("bizdate"),
            F.col("o_orderpriority").alias("flight_ids"),
            F.col("p_type").alias("card_type"),
            F.col("l_linenumber").alias("section_index"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_suppkey").alias("supp_id"),
            F.col("l_shipdate").alias("ship_date"),
            F.date_format("l_shipdate", "yyyyMMdd").alias("ship_day"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
            F.col("l_discount").alias("quality"),
            F.col("l_tax").alias("worthiness"),
            F.col("l_quantity").alias("click_likelihood"),
            F.col("l_extendedprice").alias("novelty"),
        )
    )


def ranked_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_rank(impressions(spark, sf_dir), "feed_id", POSITION_ORDER)


# The same relation for DuckDB; queries follow after "WITH " + IMPRESSIONS_SQL.
IMPRESSIONS_SQL = """imp AS (
  SELECT l.l_orderkey AS feed_id, o.o_custkey AS user_id, strftime(o.o_orderdate,'%Y%m%d') AS bizdate,
         o.o_orderpriority AS flight_ids, p.p_type AS card_type, l.l_linenumber AS section_index,
         l.l_partkey AS item_id, l.l_suppkey AS supp_id, l.l_shipdate AS ship_date,
         strftime(l.l_shipdate,'%Y%m%d') AS ship_day,
         CASE WHEN l.l_returnflag='R' THEN 1 ELSE 0 END AS label,
         l.l_discount AS quality, l.l_tax AS worthiness, l.l_quantity AS click_likelihood,
         l.l_extendedprice AS novelty,
         row_number() OVER (PARTITION BY l.l_orderkey
           ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate) - 1 AS position_rank
  FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN part p ON l.l_partkey=p.p_partkey)"""


FEED_TAG = "uniform"


def raw_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw feed rows: one feed per document, every line whole as title, message and interest; up to four cards,
    whose titles are lines from all over the text.

    The nested columns are JSON texts with the loose types found in the wild: numbers as text, empty and absent
    values, elements that are no objects.
    """
    d = spread(table(spark, sf_dir, "documents")).withColumn("ls", F.split("text", "\n"))
    fields = "substr(js, 2, length(js) - 2)"
    card = """concat('{', {f}, ',"sectionIndex":', if(i % 4 = 3, 'null', cast((doc_id + i) % 3 as string)),
        ',"cardIndex":"', (doc_id * 7 + i * 5) % 4, '","is_clicked":',
        case when (doc_id + i) % 7 = 0 then '"false"' when (doc_id + i) % 3 = 0 then 'true' when (doc_id + i) % 3 = 1 then '""' else '0' end,
        ',"features":', if((doc_id + i) % 5 = 0, '"none"', concat('{"quality":', (doc_id + i) % 10 / 10.0, ',"novelty":"0.5","extra":true,"note":"', if(doc_id % 9 = 0, 'x', ''), '"}')), '}')""".replace("{f}", "{0}")
    card = card.replace("{0}", fields.replace("js", "to_json(named_struct('itemid', concat('c', doc_id, '-', i), 'title', ls[(doc_id + i * 7) % size(ls)], 'summary', if(i % 2 = 0, '', source)))"))
    day = lambda month, expr: f"concat('2024-{month}-', lpad(cast(({expr}) % 28 + 1 as string), 2, '0'), 'T00:00:00Z')"
    interest = """to_json(transform(ls, (l, j) -> named_struct('name', l, 'domain', lang, 'status', '',
        'intent', 'learn', 'strength', if(j = 3, null, (doc_id * 7 + j * 31) % 1000 / 1000.0), 'sources', array(source, lang), 'keywords', array(lang, source), 'rationale', l)))"""
    return d.select(
        F.expr("concat('f', doc_id)").alias("feed_id"),
        F.col("source").alias("user_id"),
        F.expr("if(doc_id % 11 = 0, '', concat('2024010', doc_id % 7 + 1))").alias("bizdate"),
        F.expr(f"if(doc_id % 13 = 0, null, concat(lang, if(doc_id % 3 = 0, ',{FEED_TAG}', '')))").alias("flight_ids"),
        F.expr(f"if(doc_id % 5 = 0, '[7]', concat('[7,', array_join(transform(sequence(0, cast(doc_id % 5 as int) - 1), i -> {card}), ','), ']'))").alias("candidate_cards"),
        F.expr(f"if(doc_id % 17 = 0, '[]', {interest})").alias("interests"),
        F.expr(f"if(doc_id % 2 = 0, {interest}, null)").alias("negative_interests"),
        F.expr(f"""to_json(transform(ls, (l, j) -> named_struct('event_time', {day('01', 'j * 7 + doc_id')}, 'cardTitle', concat(' ', l, ' '),
            'clickScenario', case j % 3 when 0 then 'navigate' when 1 then 'view' end)))""").alias("shown_10d"),
        F.expr("""to_json(transform(ls, (l, j) -> named_struct('cardTitle', l,
            'clickScenario', case j % 4 when 0 then 'thumbsUp' when 1 then 'thumbsDown' end)))""").alias("interactions_90d"),
        F.expr(f"""to_json(transform(ls, (l, j) -> named_struct('conversation_id', if(j % 5 = 4, null, concat('g', j % 3)), 'message_id', concat('m', j),
            'createdAt', {day('02', 'j * 11 + doc_id')}, 'author', if(j % 2 = 0, 'human', 'bot'), 'text', if(j % 6 = 5, ' ', concat('  ', l, ' ')))))""").alias("conversation"),
    )


# The same feeds for DuckDB, already parsed: one relation per nested column.
FEEDS_SQL = """lines AS (SELECT doc_id, source, lang, unnest(arr) AS line, unnest(range(len(arr))) AS j, len(arr) AS n_lines
    FROM (SELECT *, string_split(text, chr(10)) AS arr FROM documents)),
  feeds AS (SELECT doc_id, 'f'||doc_id AS feed_id, source AS user_id, CASE WHEN doc_id%11=0 THEN '' ELSE '2024010'||(doc_id%7+1) END AS bizdate,
    CASE WHEN doc_id%13=0 THEN '' ELSE lang||CASE WHEN doc_id%3=0 THEN ',uniform' ELSE '' END END AS flight_ids, source, lang FROM documents),
  cards AS (SELECT f.*, i, 'c'||doc_id||'-'||i AS itemid, (SELECT line FROM lines l WHERE l.doc_id=f.doc_id AND l.j=(f.doc_id+i*7)%l.n_lines) AS title,
    CASE WHEN i%2=0 THEN '' ELSE source END AS summary, (doc_id+i)%5<>0 AS has_features,
    CASE WHEN (doc_id+i)%7=0 OR (doc_id+i)%3=0 THEN 1 ELSE 0 END AS label, (doc_id+i)%10/10.0::DOUBLE AS quality,
    row_number() OVER (PARTITION BY doc_id, ((doc_id+i)%5<>0) ORDER BY (doc_id+i)%3, (doc_id*7+i*5)%4, i) AS place_f,
    row_number() OVER (PARTITION BY doc_id ORDER BY (doc_id+i)%3, (doc_id*7+i*5)%4, i) AS place
    FROM feeds f, range(5) t(i) WHERE i < doc_id%5 AND i%4<>3),
  interests AS (SELECT doc_id, j, trim(line) AS name, CASE WHEN j=3 THEN 0.0 ELSE (doc_id*7+j*31)%1000/1000.0::DOUBLE END AS strength,
    trim(line)||'  [domain='||lang||'; intent=learn; '||CASE WHEN j=3 THEN '' ELSE 'strength='||printf('%.2f',(doc_id*7+j*31)%1000/1000.0::DOUBLE)||'; ' END||'sources='||source||','||lang||']'
      ||chr(10)||'    keywords: '||lang||', '||source
      ||CASE WHEN trim(line)='' THEN '' ELSE chr(10)||'    why: '||CASE WHEN length(trim(line))>400 THEN substr(trim(line),1,399)||'…' ELSE trim(line) END END AS body
    FROM lines WHERE trim(line)<>''),
  positive AS (SELECT doc_id, list(body ORDER BY strength DESC, j) AS pos FROM interests WHERE doc_id%17<>0 GROUP BY doc_id),
  negative AS (SELECT doc_id, list(body ORDER BY strength DESC, j) AS neg FROM interests WHERE doc_id%2=0 GROUP BY doc_id),
  shown AS (SELECT doc_id, j, trim(line) AS title, '2024-01-'||lpad(((j*7+doc_id)%28+1)::VARCHAR,2,'0')||'T00:00:00Z' AS event_time FROM lines),
  shown_ranked AS (SELECT doc_id, title, min(rk) AS rk, min(CASE WHEN j%3=0 THEN rk END) AS click_rk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY event_time DESC, j) AS rk FROM shown)
    WHERE title<>'' GROUP BY doc_id, title),
  history AS (SELECT doc_id, list(title ORDER BY rk)[1:30] AS titles FROM shown_ranked GROUP BY doc_id),
  clicks AS (SELECT doc_id, list(title ORDER BY click_rk) AS clicks FROM shown_ranked WHERE click_rk IS NOT NULL GROUP BY doc_id),
  ups AS (SELECT doc_id, list(trim(line) ORDER BY j) AS ups FROM lines WHERE j%4=0 AND trim(line)<>'' GROUP BY doc_id),
  downs AS (SELECT doc_id, list(trim(line) ORDER BY j) AS downs FROM lines WHERE j%4=1 AND trim(line)<>'' GROUP BY doc_id),
  msgs AS (SELECT doc_id, j, CASE WHEN j%5=4 THEN 'm'||j ELSE 'g'||(j%3) END AS gid, '2024-02-'||lpad(((j*11+doc_id)%28+1)::VARCHAR,2,'0')||'T00:00:00Z' AS made,
    CASE WHEN j%2=0 THEN 'human' ELSE 'bot' END AS author, CASE WHEN j%6=5 THEN '' ELSE trim(line) END AS raw_text,
    CASE WHEN j%6=5 THEN '' WHEN length(trim(line))>220 THEN substr(trim(line),1,219)||'…' ELSE trim(line) END AS text FROM lines),
  convs AS (SELECT doc_id, gid, min(made) AS started_at, min(j) AS first_j, list('['||CASE WHEN author='human' THEN 'user' ELSE 'assistant' END||'] '||text ORDER BY made, j) FILTER (text<>'') AS msgs,
    list('['||author||']: '||text ORDER BY made, j) FILTER (text<>'') AS raw_msgs FROM msgs GROUP BY doc_id, gid HAVING count(*) FILTER (text<>'')>0),
  groups_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY started_at DESC, first_j) AS g FROM convs)"""
