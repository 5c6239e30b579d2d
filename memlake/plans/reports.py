"""Relational reports over records, sessions and events, each with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_active, is_live, review_band, superseder
from ..operators.curation import duplicate_groups
from ..operators.merge import latest
from ..operators.outcomes import percent
from ..operators.retrieval import top_k
from ..operators.sessions import sessionize
from .inputs import RECORDS, records, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {RECORDS} SELECT id, type, project FROM records WHERE NOT deleted AND type = 'en' ORDER BY updated_s DESC, id LIMIT 20")
def recent_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Newest live records of a type."""
    return records(spark, d).filter(is_live(F.col("deleted_at")) & (F.col("type") == "en")).orderBy(F.desc("updated_at"), "id").limit(20).select("id", "type", "project")


@query(f"WITH {RECORDS} SELECT id, updated_s FROM records WHERE updated_s BETWEEN 1704067200 + 86400 AND 1704067200 + 3 * 86400")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    """P4."""
    at = F.col("updated_at")
    return records(spark, d).filter(at.between(F.timestamp_seconds(F.lit(1704067200 + 86400)), F.timestamp_seconds(F.lit(1704067200 + 3 * 86400)))).select("id", F.unix_timestamp("updated_at").alias("updated_s"))


@query(f"WITH {RECORDS} SELECT type, CASE WHEN confidence < 0.3 THEN 'low' WHEN confidence < 0.6 THEN 'moderate' ELSE 'fine' END AS band, count(*)::BIGINT AS n, round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS low, round(max(confidence), 6) AS high FROM records WHERE NOT deleted AND coalesce(archived_reason, '') = '' GROUP BY ALL")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    """P1, P9, A1, A3."""
    rows = records(spark, d).filter(is_active(F.col("deleted_at"), F.col("archived_reason")))
    c = F.col("confidence")
    return rows.groupBy("type", review_band(c).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("avg_confidence"), F.round(F.min(c), 6).alias("low"), F.round(F.max(c), 6).alias("high"))


@query(f"WITH {RECORDS} SELECT id, project, confidence FROM records WHERE NOT deleted AND project = 'src3' ORDER BY confidence DESC, id LIMIT 10 OFFSET 10")
def filtered_page(spark: SparkSession, d: str) -> DataFrame:
    """P6, P12, K5."""
    return records(spark, d).filter(is_live(F.col("deleted_at")) & (F.col("project") == "src3")).orderBy(F.desc("confidence"), "id").offset(10).limit(10).select("id", "project", "confidence")


@query(f"""WITH {RECORDS}, a AS (SELECT * FROM records WHERE NOT deleted AND coalesce(archived_reason, '') = ''),
    parts AS (SELECT * FROM (SELECT id, updated_s, 1 AS tier FROM a WHERE type = 'de' ORDER BY updated_s DESC, id LIMIT 1)
        UNION ALL SELECT * FROM (SELECT id, updated_s, 2 AS tier FROM a WHERE type IN ('en', 'fr') AND confidence >= 0.7 ORDER BY updated_s DESC, id LIMIT 15)
        UNION ALL SELECT * FROM (SELECT id, updated_s, 3 AS tier FROM a WHERE type IN ('es', 'fr') ORDER BY updated_s DESC, id LIMIT 5))
    SELECT id, min(tier)::BIGINT AS tier FROM parts GROUP BY id""")
def tiered_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Limited branches, united by id."""
    a = records(spark, d).filter(is_active(F.col("deleted_at"), F.col("archived_reason")))
    newest = [F.desc("updated_at"), F.col("id")]
    one = a.filter("type = 'de'").orderBy(*newest).limit(1).select("id", F.lit(1).alias("tier"))
    two = a.filter((F.col("type").isin("en", "fr")) & (F.col("confidence") >= 0.7)).orderBy(*newest).limit(15).select("id", F.lit(2).alias("tier"))
    three = a.filter(F.col("type").isin("es", "fr")).orderBy(*newest).limit(5).select("id", F.lit(3).alias("tier"))
    return one.union(two).union(three).groupBy("id").agg(F.min("tier").cast("long").alias("tier"))


@query(f"WITH {RECORDS}, r AS (SELECT id, TRY_CAST(nullif(regexp_extract(archived_reason, 'by #([0-9]+)', 1), '') AS BIGINT) AS by_id FROM records) SELECT a.id, a.by_id FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.id = a.by_id)")
def superseded_in_set(spark: SparkSession, d: str) -> DataFrame:
    """Records whose superseder is in the same set."""
    r = records(spark, d).select("id", superseder(F.col("archived_reason")).alias("by_id")).filter("by_id IS NOT NULL")
    return r.join(records(spark, d).select(F.col("id").alias("by_id")), "by_id", "left_semi").select("id", "by_id")


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, round(avg(value), 9) AS avg_value FROM events GROUP BY ALL")
def event_daily_series(spark: SparkSession, d: str) -> DataFrame:
    """A2, A6, T3."""
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 9).alias("avg_value"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS avg_value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 20 GROUP BY 1")
def recent20_average(spark: SparkSession, d: str) -> DataFrame:
    """Average of each event's last twenty."""
    last = top_k(table(spark, d, "events"), ["event_type"], [F.desc("ts"), F.col("event_id")], 20)
    return last.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, count(*)::BIGINT AS served, round(max(value), 6) AS top_value FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY ALL")
def json_detail_counts(spark: SparkSession, d: str) -> DataFrame:
    """A19, P14."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").withColumn("k", k).filter("k IS NOT NULL").groupBy("k", "event_type").agg(F.count("*").alias("served"), F.round(F.max("value"), 6).alias("top_value"))


@query("WITH o AS (SELECT max(ts) AS now FROM events), c AS (SELECT event_type, count(*)::BIGINT AS total, count(*) FILTER (ts > now - INTERVAL 7 DAY)::BIGINT AS week, count(*) FILTER (value < 0.1 AND ts > now - INTERVAL 7 DAY)::BIGINT AS low FROM events, o GROUP BY 1) SELECT *, CASE WHEN week > 0 THEN round_even(100.0 * low / week, 1) END AS low_pct, CASE WHEN week < 5 THEN 0.0 WHEN low > 0.5 * week THEN 0.10 WHEN low > 0.3 * week THEN 0.05 ELSE 0.0 END::DOUBLE AS boost FROM c")
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the last seven days before a given moment, and a boost by their share."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    recent = F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")
    c = e.crossJoin(F.broadcast(now)).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(recent).alias("week"), F.count_if(recent & (F.col("value") < 0.1)).alias("low"))
    boost = F.when(F.col("week") < 5, 0.0).when(F.col("low") > 0.5 * F.col("week"), 0.10).when(F.col("low") > 0.3 * F.col("week"), 0.05).otherwise(0.0)
    return c.select("*", percent(F.col("low"), F.col("week")).alias("low_pct"), boost.alias("boost"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS nth FROM g)
    SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*)::BIGINT AS n FROM s GROUP BY user_id, nth""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """T4: runs of a user's events with gaps under an hour."""
    return sessionize(table(spark, d, "events"), "user_id", "ts", 60).select("user_id", F.unix_timestamp("start").alias("start_s"), "n")


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) <> 1")
def counts_left_join(spark: SparkSession, d: str) -> DataFrame:
    """One row per customer; orders are summed before the join."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total")).filter("orders <> 1")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def never_labelled(spark: SparkSession, d: str) -> DataFrame:
    """Anti join."""
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT lang, count(*)::BIGINT AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def labelled_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Semi join."""
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("labelled"))


@query("SELECT sha256(text) AS mark, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts, grouped by digest so that texts aren't shuffled."""
    return duplicate_groups(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("mark")), "mark")


@query("WITH g AS (SELECT sha256(text) AS mark, count(*) AS n FROM documents GROUP BY 1) SELECT n::BIGINT AS copies, count(*)::BIGINT AS groups FROM g GROUP BY 1")
def copies_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A5: counts of counts."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("groups"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """W5, J20."""
    return latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey, r - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    """W7, A38."""
    return top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT lang, source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT // 4 AS tokens FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the characters, by several keys at once."""
    docs = table(spark, d, "documents")
    return docs.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count("*").alias("n"), F.expr("sum(n_chars) div 4").alias("tokens"))


@query(f"WITH {RECORDS}, o AS (SELECT max(updated_s) AS now FROM records), b AS (SELECT (now - updated_s) // 86400 AS age, content FROM records, o) SELECT CASE WHEN age < 1 THEN '0-1' WHEN age < 2 THEN '1-2' WHEN age < 4 THEN '2-4' ELSE '4+' END AS band, count(*)::BIGINT AS n, count(*) FILTER (length(content) > 500)::BIGINT AS long_texts FROM b GROUP BY 1")
def age_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A21."""
    r = records(spark, d).select(F.unix_timestamp("updated_at").alias("s"), F.length("content").alias("size"))
    age = F.expr("(now - s) div 86400")
    rows = r.crossJoin(F.broadcast(r.agg(F.max("s").alias("now")))).withColumn("age", age)
    band = F.when(F.col("age") < 1, "0-1").when(F.col("age") < 2, "1-2").when(F.col("age") < 4, "2-4").otherwise("4+")
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("size") > 500).alias("long_texts"))


@query("WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(html) AS size FROM pages) SELECT host, count(*)::BIGINT AS pages, max(size)::BIGINT AS largest FROM p GROUP BY 1")
def pages_by_host(spark: SparkSession, d: str) -> DataFrame:
    """Grouped by a part of a string."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.length("html").alias("size"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.max("size").cast("long").alias("largest"))


@query("WITH s AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, coalesce(sum(n) FILTER (event_type = 'click'), 0)::BIGINT AS clicks, coalesce(sum(n) FILTER (event_type <> 'click'), 0)::BIGINT AS others FROM s GROUP BY 1")
def event_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counts side by side."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") != "click").alias("others"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pushed-down filter, pruned columns, partial sums."""
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM documents")
def places_in_group(spark: SparkSession, d: str) -> DataFrame:
    """W1, W6."""
    rows = table(spark, d, "documents").select("doc_id", "lang")
    w = Window.partitionBy("lang")
    return rows.select("doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("size"))
