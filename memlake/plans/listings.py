"""Listings, verbs and readouts, each with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing
from .inputs import DELIVERIES, RECORDS, deliveries, records, table

QUERIES, ORACLE = {}, {}
ACTIVE = "NOT deleted AND coalesce(archived_reason, '') = ''"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {RECORDS} SELECT id, project, type, sha256(content) AS mark FROM records WHERE id = 42")
def record_by_id(spark: SparkSession, d: str) -> DataFrame:
    """One record by its key; the filter reaches the scan."""
    return records(spark, d).filter("id = 42").select("id", "project", "type", F.sha2("content", 256).alias("mark"))


@query(f"WITH {RECORDS} SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY updated_s DESC, id DESC) - 1 AS rank FROM records WHERE {ACTIVE} AND type IN ('en', 'de') QUALIFY rank < 10")
def standing_records(spark: SparkSession, d: str) -> DataFrame:
    """What always goes along, the newest first."""
    return listing.standing(records(spark, d), ("en", "de"), 10).select("project", "id", "rank")


@query("SELECT page_id FROM pages WHERE lower(split_part(url, '/', 3)) LIKE 'th%'")
def hosts_with_prefix(spark: SparkSession, d: str) -> DataFrame:
    """P5: keys that start alike, whatever their case."""
    return listing.with_prefix(table(spark, d, "pages").select("page_id", F.upper(F.split_part("url", F.lit("/"), F.lit(3))).alias("host")), "host", "Th").select("page_id")


@query(f"WITH {RECORDS} SELECT id, {ACTIVE} AND project LIKE 'src1%' AS hit, CASE WHEN {ACTIVE} AND project LIKE 'src1%' THEN 'retracted' ELSE archived_reason END AS archived_reason FROM records")
def retraction(spark: SparkSession, d: str) -> DataFrame:
    """What a retraction by source archives."""
    return listing.retracted(records(spark, d).withColumn("source_ref", F.col("project")), "src1%", like=True).select("id", "hit", "archived_reason")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def without_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose JSON lacks a key, and those that are no JSON."""
    i = F.col("event_id")
    ref = F.when(i % 3 == 0, F.to_json(F.struct(i.alias("chunk"), "event_type"))).when(i % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("not json "), F.col("props")))
    return listing.without_key(table(spark, d, "events").select("event_id", ref.alias("source_ref")), "source_ref", "$.chunk").select("event_id")


@query(f"WITH {RECORDS} SELECT id FROM records WHERE NOT (coalesce(archived_reason, '') LIKE 'superseded by #%' AND (id + 1) IN (SELECT id FROM records WHERE type <> 'es')) AND type <> 'es'")
def unsuperseded(spark: SparkSession, d: str) -> DataFrame:
    """Records without those whose superseder is among them."""
    return listing.without_superseded(records(spark, d).filter("type <> 'es'").select("id", "archived_reason")).select("id")


@query("SELECT event_id FROM events QUALIFY ts >= max(ts) OVER (PARTITION BY user_id) - INTERVAL 600 MINUTE")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    """What happened shortly before a session's end."""
    return listing.last_minutes(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 600).select("event_id")


@query("""WITH r AS (SELECT doc_id AS id, lang AS content, source AS project, CASE WHEN doc_id % 5 = 0 THEN 'old' END AS archived_reason, doc_id % 7 = 0 AS deleted FROM documents WHERE doc_id % 4 <> 3),
    j AS (SELECT coalesce(r.id, doc_id) AS id, r.id IS NOT NULL AS old, doc_id AS i, content, project, archived_reason, coalesce(deleted, false) AS deleted FROM documents LEFT JOIN r ON r.id = doc_id)
    SELECT id, CASE WHEN old AND NOT deleted AND i % 3 = 0 THEN 'second ' || i WHEN old THEN content WHEN i % 3 = 0 THEN 'second ' || i ELSE 'added ' || i END AS content, CASE WHEN NOT deleted AND i % 6 = 1 THEN 'labelled' ELSE project END AS project, CASE WHEN NOT deleted AND i % 8 = 2 THEN 'done' ELSE archived_reason END AS archived_reason, deleted OR i % 9 = 4 AS deleted FROM j WHERE old OR i % 4 = 3""")
def record_verbs(spark: SparkSession, d: str) -> DataFrame:
    """Records after a log of verbs."""
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    rows = docs.filter("doc_id % 4 <> 3").select(i.alias("id"), F.col("lang").alias("content"), F.col("source").alias("project"), F.when(i % 5 == 0, "old").alias("archived_reason"), (i % 7 == 0).alias("deleted"))
    say = lambda x: F.concat(F.lit(f"{x} "), i.cast("string"))
    verb = lambda n, name, value, when: F.when(when, F.struct(F.lit(n).alias("seq"), F.lit(name).alias("verb"), value.alias("value")))
    said = F.array(verb(1, "add", say("added"), i % 4 == 3), verb(2, "update", say("first"), i % 3 == 0), verb(3, "update", say("second"), i % 3 == 0), verb(4, "label", F.lit("labelled"), i % 6 == 1), verb(5, "archive", F.lit("done"), i % 8 == 2), verb(6, "delete", F.lit(None).cast("string"), i % 9 == 4), verb(7, "update", say("late"), i % 9 == 4), verb(8, "label", F.lit("late"), i % 9 == 4))
    verbs = docs.select(i.alias("id"), F.explode(F.filter(said, lambda x: x.isNotNull())).alias("x")).select("id", "x.*")
    return listing.apply_verbs(rows, verbs)


@query("WITH s AS (SELECT user_id AS id, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY 1), r AS (SELECT user_id AS id, max(event_id) AS updated_at FROM events WHERE event_type = 'click' GROUP BY 1) SELECT r.id, updated_at FROM r LEFT JOIN s USING (id) WHERE seen IS NULL OR seen < updated_at")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """What changed after it was last looked at."""
    e = table(spark, d, "events")
    rules = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("updated_at"))
    return listing.to_review(rules, e.filter("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("reviewed_at")))


BRANCHES = """b AS (SELECT o_orderpriority AS org, o_custkey % 200 AS repo, 'b' || o_orderkey AS branch, o_orderstatus = 'F' AS merged, o_orderdate AS moved_at, o_orderkey FROM orders)"""


@query(f"""WITH {BRANCHES}, f AS (SELECT o_orderpriority AS org, o_custkey % 200 AS repo, 'b' || l_orderkey AS branch, count(*) AS files FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), s AS (SELECT b.*, floor((epoch(TIMESTAMP '1999-01-01') - epoch(moved_at::TIMESTAMP)) / 86400)::BIGINT AS age_days FROM b)
    SELECT org, repo, branch, age_days, coalesce(files, 0) AS files, row_number() OVER (PARTITION BY org ORDER BY age_days DESC, repo, branch) - 1 AS place FROM s LEFT JOIN f USING (org, repo, branch) WHERE NOT merged AND age_days >= 90 QUALIFY place < 50""")
def stranded_branches(spark: SparkSession, d: str) -> DataFrame:
    """Branches that no one merged, fifty of each owner."""
    o = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderpriority").alias("org"), (F.col("o_custkey") % 200).alias("repo"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("branch"), (F.col("o_orderstatus") == "F").alias("merged"), F.col("o_orderdate").cast("timestamp").alias("moved_at"))
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(o, "o_orderkey").select("org", "repo", "branch", F.col("l_linenumber").alias("path"))
    return listing.stranded(o, files, F.lit("1999-01-01").cast("timestamp"), 90).filter("place < 50")


@query(f"WITH {BRANCHES} SELECT org, repo, count(*) AS branches, count(*) FILTER (merged) AS merged, epoch(max(moved_at)::TIMESTAMP)::BIGINT AS last_move FROM b GROUP BY ALL")
def branch_readout(spark: SparkSession, d: str) -> DataFrame:
    """Branches of each repository."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("org"), (F.col("o_custkey") % 200).alias("repo"), (F.col("o_orderstatus") == "F").alias("merged"), F.col("o_orderdate").cast("timestamp").alias("moved_at"))
    return listing.branch_stats(o).withColumn("last_move", F.unix_timestamp("last_move"))


@query(f"WITH {DELIVERIES}, c AS (SELECT session_id, grade, count(*) AS n FROM deliveries WHERE grade IS NOT NULL GROUP BY ALL), m AS (SELECT session_id, grade AS majority FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, grade) = 1) SELECT session_id, any_value(majority)::BIGINT AS majority, round_even(median(grade), 0)::BIGINT AS median, count(grade) AS votes FROM deliveries JOIN m USING (session_id) GROUP BY 1")
def vote_median(spark: SparkSession, d: str) -> DataFrame:
    """The usual grade and the median one."""
    return listing.votes(deliveries(spark, d), "session_id", "grade").withColumn("majority", F.col("majority").cast("long"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT event_type AS kind, count(*) FILTER (n <= 50 AND value < 20) AS failed, round(count(*) FILTER (n <= 50 AND value < 20) / count(*) FILTER (n <= 50), 6) AS rate, round(count(*) FILTER (n <= 50 AND value < 20) / count(*), 6) AS rate_of_all FROM r GROUP BY 1")
def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    """Failures among the last fifty, of those and of all."""
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("id"), (F.col("value") < 20).alias("failed"))
    return listing.failure_rates(e, "kind").select("kind", "failed", F.round("rate", 6).alias("rate"), F.round("rate_of_all", 6).alias("rate_of_all"))


@query("""WITH e AS (SELECT event_type AS kind, ['block', 'fired', 'satisfied', 'abandoned'][user_id % 4 + 1] AS outcome FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 14 DAY AND ts <= TIMESTAMP '2024-01-20'), c AS (SELECT kind, count(*) AS n, count(*) FILTER (outcome = 'block') AS b, count(*) FILTER (outcome = 'fired') AS f, count(*) FILTER (outcome = 'satisfied') AS s, count(*) FILTER (outcome = 'abandoned') AS a FROM e GROUP BY 1)
    SELECT kind, n, b AS blocked, round(b / nullif(b + f, 0), 6) AS block_rate, round(s / nullif(s + a, 0), 6) AS satisfied_rate FROM c""")
def enforcement_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What enforcement did in two weeks."""
    outcome = F.element_at(F.array(*map(F.lit, ("block", "fired", "satisfied", "abandoned"))), (F.col("user_id") % 4 + 1).cast("int"))
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"))
    return listing.ledger(e, F.lit("2024-01-20").cast("timestamp"), 14)


@query("WITH q AS (SELECT page_id AS query_id, unnest(list_distinct([page_id % 7, page_id % 5, page_id % 3])) AS q FROM pages), f AS (SELECT doc_id % 7 AS q, doc_id AS id, (doc_id * 31 % 101) / 100.0::DOUBLE AS s FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id % 5, doc_id, (doc_id * 17 % 101) / 100.0::DOUBLE FROM documents WHERE doc_id % 3 = 0) SELECT query_id, id, round(max(s), 6) AS score FROM q JOIN f USING (q) GROUP BY ALL")
def multi_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries of several parts, the best score of each record."""
    p, i = F.col("page_id"), F.col("doc_id")
    asked = table(spark, d, "pages").select(p.alias("query_id"), F.concat_ws(" | ", *[F.concat(F.lit("q"), (p % k).cast("string")) for k in (7, 5, 3)], F.lit("")).alias("query"))
    docs = table(spark, d, "documents").filter("doc_id % 3 = 0")
    found = lambda k, m: docs.select(F.concat(F.lit("q"), (i % k).cast("string")).alias("query"), i.alias("id"), F.round(i * m % 101 / 100.0, 6).alias("score"))
    return listing.best_of_queries(asked, found(7, 31).unionByName(found(5, 17)))


@query("""SELECT page_id, sha256('{"a":"' || page_id || '","b \\"q\\"":null,"url":"' || url || '"}') AS mark FROM pages""")
def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash over JSON with its keys in order."""
    pairs = F.create_map(F.lit("url"), F.col("url"), F.lit('b "q"'), F.lit(None).cast("string"), F.lit("a"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", F.sha2(listing.canonical(pairs), 256).alias("mark"))


@query(f"""WITH {DELIVERIES}, p AS (SELECT session_id, memory_id AS winner, memory_id + id % 3 * 150 AS loser, id FROM deliveries), h AS (SELECT DISTINCT session_id, memory_id FROM deliveries),
    j AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.session_id = p.session_id AND h.memory_id = winner) THEN 'here' WHEN EXISTS (SELECT 1 FROM h WHERE h.memory_id = winner) THEN 'elsewhere' ELSE 'nowhere' END AS winner_place, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.session_id = p.session_id AND h.memory_id = loser) THEN 'here' WHEN EXISTS (SELECT 1 FROM h WHERE h.memory_id = loser) THEN 'elsewhere' ELSE 'nowhere' END AS loser_place FROM p)
    SELECT id, winner_place, loser_place, winner_place = 'here' AND loser_place = 'here' AND winner <> loser AS valid FROM j""")
def fit_label_places(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose two sides were delivered in their session, and where else."""
    rows = deliveries(spark, d)
    pairs = rows.select("id", "session_id", F.col("memory_id").alias("winner"), (F.col("memory_id") + F.col("id") % 3 * 150).alias("loser"))
    return listing.fit_labels(pairs, rows).select("id", "winner_place", "loser_place", "valid")
