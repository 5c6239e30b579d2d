"""Queries over text sources and streams, each with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import versioned_table
from ..sources import exports, text
from ..streaming import jobs, queue
from .inputs import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, merged batch by batch."""
    return jobs.upsert_stream(jobs.table_stream(spark, d, "events"), "user_id", "ts", "event_id", jobs.work_folder(spark)).select("user_id", "event_id", "event_type", "value")


@query("WITH w AS (SELECT event_type, epoch(date_trunc('day', ts))::BIGINT AS day_s, unnest(range(0, 7)) AS back FROM events) SELECT day_s - back * 86400 AS start_s, event_type, count(*)::BIGINT AS n FROM w GROUP BY ALL")
def sliding_7d(spark: SparkSession, d: str) -> DataFrame:
    """Counts in windows of seven days that start every day."""
    return jobs.windowed_counts(jobs.table_stream(spark, d, "events"), "ts", ["event_type"], "7 days", "1 day", "60 days", jobs.work_folder(spark))


@query("""WITH a AS (SELECT user_id, event_type, row_number() OVER w - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT user_id, count(*) AS run FROM a GROUP BY user_id, event_type, g) SELECT user_id, sum(run)::BIGINT AS n, max(run)::BIGINT AS best FROM r GROUP BY 1""")
def streak_state(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of one kind of event per user."""
    return jobs.streaks(jobs.table_stream(spark, d, "events"), "user_id", "ts", "event_type", jobs.work_folder(spark)).select("user_id", "n", "best")


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of user and kind, once."""
    rows = jobs.table_stream(spark, d, "events").select("user_id", "event_type", "ts")
    return jobs.first_seen(rows, ["user_id", "event_type"], "ts", "60 days", jobs.work_folder(spark)).select("user_id", "event_type")


@query("SELECT page_id, u AS unit FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=[\"'']([^\"''#]+)[\"'']', 1))) AS u FROM pages)")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages, as one section of the extractor."""
    files = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return text.sections(files, ("links",)).select(F.col("path").cast("long").alias("page_id"), "unit")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, length(text)::BIGINT AS size FROM conversations WHERE role IN ('user', 'assistant')")
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON lines of two dialects, parsed back."""
    t = table(spark, d, "conversations")
    nested = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    flat = F.to_json(F.struct("role", F.col("text").alias("content")))
    lines = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("nth"), F.when(F.col("conv_id") % 2 == 0, nested).otherwise(flat).alias("line"))
    return text.parse_turns(lines).select(F.col("session_id").alias("conv_id"), "idx", "role", F.length("text").cast("long").alias("size"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, list_filter([trim(x, ' ') for x in string_split_regex(regexp_replace(text, chr(10), chr(10) || chr(10), 'g'), '\\n\\s*\\n')], lambda x: x <> '') AS ps FROM documents),
    w AS (SELECT doc_id, ps, 0::BIGINT AS i, []::VARCHAR[] AS done FROM p
        UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN len(done) > 0 AND length(done[-1]) + 2 + length(ps[i + 1]) <= 2000 THEN list_append(done[:-2], done[-1] || chr(10) || chr(10) || ps[i + 1]) ELSE list_append(done, ps[i + 1]) END FROM w WHERE i < len(ps)),
    u AS (SELECT doc_id, unnest(done) AS chunk, unnest(range(0, len(done))) AS nth FROM w WHERE i = len(ps)) SELECT doc_id, nth, length(chunk)::BIGINT AS size, sha256(chunk) AS mark FROM u""")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    """documents' lines packed into chunks of 2000 characters."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(text.chunks(F.regexp_replace("text", "\n", "\n\n"), 2000)).alias("nth", "chunk"))
    return docs.select("doc_id", F.col("nth").cast("long").alias("nth"), F.length("chunk").cast("long").alias("size"), F.sha2("chunk", 256).alias("mark"))


@query("SELECT doc_id, source AS query, sha256(text) AS mem, quality::BIGINT AS grade FROM documents JOIN labels USING (doc_id)")
def exported_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labelled texts as an export, read back after its digests were checked."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("source").alias("query"), F.col("text").alias("mem"), F.col("quality").cast("long").alias("grade"))
    path = f"{jobs.work_folder(spark)}-export"
    exports.export_labels(rows, path, "query")
    return exports.import_labels(spark, path, rows.schema).withColumn("mem", F.sha2("mem", 256))


@query("""WITH d AS (SELECT doc_id, lang, text FROM documents), l AS (SELECT 1 AS t, doc_id, CASE WHEN doc_id % 4 = 0 THEN 'early ' || text ELSE text END AS text FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 2, doc_id, text FROM d UNION ALL SELECT 3, doc_id, text FROM d WHERE lang <> 'de')
    SELECT t::BIGINT AS t, count(*) AS n, bit_xor(('0x' || sha256(doc_id || text)[1:8])::BIGINT) AS x, 0::BIGINT AS rewritten FROM l GROUP BY 1
    UNION ALL SELECT 4, count(*), NULL, NULL FROM (SELECT doc_id FROM d UNION ALL SELECT doc_id FROM d WHERE doc_id % 4 = 0)""")
def table_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Three loads of documents by language, read as of each; the same load again rewrites nothing; and all versions."""
    docs, i = table(spark, d, "documents").select("doc_id", "lang", "text"), F.col("doc_id")
    early = docs.filter(i % 2 == 0).withColumn("text", F.when(i % 4 == 0, F.concat(F.lit("early "), "text")).otherwise(F.col("text")))
    past = versioned_table(docs, ("doc_id",), "lang")
    again = [[past.load(rows, t), past.load(rows, t)][1] for t, rows in ((1, early), (2, docs), (3, docs.filter("lang <> 'de'")))]
    x = F.conv(F.substring(F.sha2(F.concat(i.cast("string"), "text"), 256), 1, 8), 16, 10).cast("long")
    out = None
    for t, n in enumerate(again, 1):
        part = past.as_of(t).agg(F.lit(t).cast("long").alias("t"), F.count("*").alias("n"), F.bit_xor(x).alias("x"), F.lit(n).cast("long").alias("rewritten"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(past.rows().agg(F.lit(4).cast("long").alias("t"), F.count("*").alias("n"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("rewritten")))


@query("SELECT event_id AS seq, event_type AS kind, user_id FROM events")
def queue_drained(spark: SparkSession, d: str) -> DataFrame:
    """Events as the files of a queue, drained in their order into a table."""
    folder = jobs.work_folder(spark)
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.to_json(F.struct("user_id", "value")).alias("payload"))
    queue.enqueue_rows(rows, f"{folder}/queue")
    none = lambda x: x.filter("get_json_object(payload, '$.user_id') IS NULL").select("seq")
    done = queue.drain_stream(queue.queue_stream(spark, f"{folder}/queue"), none, folder)
    return done.handled.read().select("seq", "kind", F.get_json_object("payload", "$.user_id").cast("long").alias("user_id"))
