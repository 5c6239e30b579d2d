"""Queries over records, deliveries and vectors that apply the rules of upkeep, each with the SQL of its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates, scalars
from ..operators import curation, gates, merge, outcomes, records, retrieval
from ..params import Params
from .inputs import DELIVERIES, RECORDS, deliveries, table
from .inputs import records as record_rows

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def pick(i: Column, *values) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


DOCS = "docs AS (SELECT doc_id AS id, lang, source, text, n_chars FROM documents)"
#: Similarities of each hundredth vector with all others, from 0 to 1.
NEAR = """sims AS (SELECT a.vec_id AS query_id, b.vec_id AS id, (1 + list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2 AS similarity, b.label FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"""


def _near(spark: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    """Rows with a similarity of about `least` or more; others don't leave the search."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return retrieval.vector_top_k(v, q, None, 2 * least - 1 - 1e-6, carry=("label",)).filter("id <> query_id").select("query_id", "id", ((1 + F.col("similarity")) / 2).alias("similarity"), "label")


@query("""WITH r AS (SELECT doc_id AS id, source AS project, doc_id % 50 AS session, doc_id AS updated_at, unnest(list_distinct(['src/' || (doc_id % 20) || '/' || (doc_id % 7) || '.py', 'pkg/' || (doc_id % 30) || '/main.py'])) AS path FROM documents),
    q AS (SELECT page_id AS query_id, CASE WHEN page_id % 2 = 0 THEN 'src/' || (page_id % 20) || '/' || (page_id % 7) || '.py' ELSE 'pkg/' || (page_id % 30) || '/main.py' END AS path, 'src' || (page_id % 5) AS project, page_id % 50 AS session FROM pages),
    m AS (SELECT query_id, id, r.updated_at, CASE WHEN q.path = r.path THEN 2 WHEN string_split(q.path, '/')[-1] <> 'main.py' AND q.project = r.project AND string_split(q.path, '/')[-1] = string_split(r.path, '/')[-1] THEN 1 ELSE 0 END AS quality FROM q, r WHERE q.session <> r.session),
    b AS (SELECT query_id, id, max(quality) AS quality, any_value(updated_at) AS updated_at FROM m WHERE quality > 0 GROUP BY ALL) SELECT query_id, id, quality, row_number() OVER (PARTITION BY query_id ORDER BY quality DESC, updated_at DESC, id) - 1 AS rank FROM b""")
def file_associations(spark: SparkSession, d: str) -> DataFrame:
    """Records that name the file at hand, by path or by name in the same project."""
    i, p = F.col("doc_id"), F.col("page_id")
    src = lambda x: F.concat(F.lit("src/"), (x % 20).cast("string"), F.lit("/"), (x % 7).cast("string"), F.lit(".py"))
    pkg = lambda x: F.concat(F.lit("pkg/"), (x % 30).cast("string"), F.lit("/main.py"))
    rows = table(spark, d, "documents").select(i.alias("id"), F.col("source").alias("project"), (i % 50).alias("session"), i.alias("updated_at"), F.array(src(i), pkg(i)).alias("files"))
    asked = table(spark, d, "pages").select(p.alias("query_id"), F.when(p % 2 == 0, src(p)).otherwise(pkg(p)).alias("path"), F.concat(F.lit("src"), (p % 5).cast("string")).alias("project"), (p % 50).alias("session"))
    return records.file_matches(rows, asked)


@query("""SELECT doc_id AS id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 4 NOT IN (1, 2)""")
def meta_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows that speak of what is recorded are left out, corrections stay."""
    i = F.col("doc_id")
    said = F.when(i % 4 == 1, F.concat(F.col("text"), F.lit(" There is no prior memory of this."))).when(i % 4 == 2, F.concat(F.lit("Should be captured "), F.col("text"))).otherwise(F.col("text"))
    rows = table(spark, d, "documents").select(i.alias("id"), said.alias("content"), F.when(i % 5 == 0, "correction").otherwise("fact").alias("type"))
    return records.without_meta(rows, "memory").select("id")


STALE = """p AS (SELECT doc_id AS id, source AS project, CASE doc_id % 4 WHEN 0 THEN ['/data/' || (doc_id % 12) || '.csv', '/data/' || (doc_id % 9) || '.csv'] WHEN 1 THEN ['lib/m' || (doc_id % 9) || '.py'] WHEN 2 THEN ['/tmp/x' || doc_id || '.log'] ELSE [] END AS paths FROM documents),
    f AS (SELECT id, list_distinct(list_filter([CASE WHEN x LIKE '/%' THEN x WHEN project IN ('src0', 'src1', 'web') THEN '/repos/' || project || '/' || x END for x in paths], lambda x: x IS NOT NULL AND x NOT LIKE '/tmp/%')) AS full_paths FROM p),
    m AS (SELECT id, len(full_paths)::BIGINT AS named, len(list_filter(full_paths, lambda x: NOT (regexp_extract(x, '([0-9]+)[.]', 1)::INT % 3 = 0)))::BIGINT AS missing FROM f)"""


@query(f"WITH {STALE} SELECT id, CASE WHEN named = 0 THEN 'skip' WHEN missing = 0 THEN 'ok' WHEN missing = named THEN 'stale' ELSE 'skip' END AS verdict, named, missing FROM m")
def stale_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose files are all gone."""
    i = F.col("doc_id")
    say = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    plain = F.regexp_replace("text", r"[./]", " ")
    text = say(plain, F.when(i % 4 == 0, say(" see /data/", i % 12, ".csv and (/data/", i % 9, ".csv).")).when(i % 4 == 1, say(" in `lib/m", i % 9, ".py`")).when(i % 4 == 2, say(" /tmp/x", i, ".log")).otherwise(""))
    rows = table(spark, d, "documents").select(i.alias("id"), F.lit("fact").alias("type"), F.col("source").alias("project"), text.alias("content"))
    roots = rows.filter(F.col("project").isin("src0", "src1", "web")).select("project", F.concat(F.lit("/repos/"), F.col("project")).alias("root")).distinct()
    n = rows.select((F.col("id") % 12 * 3).alias("n")).distinct()
    existing = n.select(say("/data/", F.col("n"), ".csv").alias("path")).unionByName(n.crossJoin(F.broadcast(roots)).select(say(F.col("root"), "/lib/m", F.col("n"), ".py").alias("path")))
    return records.staleness(rows, existing, roots, ("fact",))


@query("""WITH c AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Edit' ELSE 'Grep' END AS tool, CASE WHEN event_id % 11 = 0 THEN '/tmp/' || event_id ELSE 'src/' || (event_id % 17) || '.py' END AS path FROM events),
    n AS (SELECT * FROM c QUALIFY nth > max(nth) OVER (PARTITION BY session_id) - 30), k AS (SELECT session_id, path, min(nth) AS f, min(nth) FILTER (tool = 'Edit') AS e FROM n WHERE path NOT LIKE '/tmp/%' GROUP BY ALL),
    a AS (SELECT *, count(e) OVER (PARTITION BY session_id) > 0 AS edits FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN edits THEN e ELSE f END, path) AS r FROM a WHERE NOT edits OR e IS NOT NULL)
    SELECT session_id, string_agg(path, ' ' ORDER BY r) AS files FROM o WHERE r <= 8 GROUP BY 1""")
def touched_files(spark: SparkSession, d: str) -> DataFrame:
    """C14: files of a session's last calls, edited ones where there are any."""
    e, i = table(spark, d, "events"), F.col("event_id")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").otherwise("Grep")
    path = F.when(i % 11 == 0, F.concat(F.lit("/tmp/"), i.cast("string"))).otherwise(F.concat(F.lit("src/"), (i % 17).cast("string"), F.lit(".py")))
    done = records.associated_files(e.select(F.col("user_id").alias("session_id"), nth.alias("nth"), tool.alias("tool"), path.alias("path")))
    return done.select("session_id", F.array_join("files", " ").alias("files"))


KINDS = ("fact", "correction", "person", "decision", "note", "skill", "project")


@query(f"WITH e AS (SELECT conv_id, turn, {list(KINDS)}[turn % 7 + 1] AS type FROM conversations) SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(list_position({list(records.TYPE_ORDER)}, type), 9), turn) AS r FROM e) WHERE r <= 5")
def write_throttle(spark: SparkSession, d: str) -> DataFrame:
    """K6: five entries of a message, by the rank of their type."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("nth"), pick(F.col("turn"), *KINDS).alias("type"))
    return records.throttled(rows, "conv_id").select("conv_id", "turn")


@query(f"""WITH {NEAR}, st AS (SELECT vec_id AS id, label::VARCHAR AS type, vec_id % 40 AS topic FROM embeddings WHERE vec_id % 100 <> 0), en AS (SELECT vec_id AS nth, label::VARCHAR AS type, vec_id // 100 % 40 AS topic FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT type, topic, min(id) AS same_id FROM st GROUP BY ALL), n AS (SELECT query_id AS nth, id, similarity FROM sims WHERE id % 100 <> 0), b AS (SELECT nth, arg_max(id, (similarity, -id)) AS near_id, max(similarity) AS near_sim FROM n GROUP BY 1),
    j AS (SELECT en.nth, same_id, coalesce(n.similarity, 0) AS same_sim, near_id, near_sim, same_id % 2 = 0 AS same_no, near_id % 2 = 0 AS near_no FROM en LEFT JOIN s USING (type, topic) LEFT JOIN n ON n.nth = en.nth AND n.id = same_id LEFT JOIN b ON b.nth = en.nth),
    a AS (SELECT *, CASE WHEN nth % 700 = 0 THEN 'dropped' WHEN same_id IS NOT NULL AND same_sim < 0.55 THEN 'variant' WHEN same_id IS NOT NULL THEN 'overwrite' WHEN near_sim >= 0.72 THEN 'duplicate' ELSE 'insert' END AS action FROM j)
    SELECT nth, action, CASE action WHEN 'variant' THEN same_id WHEN 'overwrite' THEN same_id WHEN 'duplicate' THEN near_id WHEN 'insert' THEN CASE WHEN near_sim >= 0.6 AND near_no THEN near_id END END AS target,
        CASE action WHEN 'variant' THEN same_no WHEN 'overwrite' THEN true WHEN 'insert' THEN coalesce(near_sim >= 0.6 AND near_no, false) ELSE false END AS annotates FROM a""")
def capture_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of new entries, by what is stored under their topic or near them."""
    v, i = table(spark, d, "embeddings"), F.col("vec_id")
    new = i % 100 == 0
    stored = v.filter(~new).select(i.alias("id"), F.col("label").cast("string").alias("type"), (i % 40).alias("topic"), F.when(i % 2 == 0, "we never keep this here").otherwise("we keep this here").alias("content"))
    text = F.when(i % 700 == 0, "short").otherwise("we keep this here now")
    entries = v.filter(new).select(i.alias("nth"), i.alias("message_id"), F.col("label").cast("string").alias("type"), (F.expr("vec_id div 100") % 40).alias("topic"), text.alias("content"))
    sim = lambda x: F.round((1 + x) / 2, 12).alias("similarity")  # noqa: E731  two ways to sum a product differ by less
    nearest = retrieval.vector_candidates(v.filter(~new).select(i.alias("id"), "embedding"), v.filter(new).select(i.alias("query_id"), "embedding"), 1, -2.0, weight=0.5).select(F.col("query_id").alias("nth"), "id", sim(F.col("similarity")))
    nearest = retrieval.top_k(nearest, ["nth"], [F.desc("similarity"), F.col("id")], 1).drop("rank")
    same = entries.join(stored.groupBy("type", "topic").agg(F.min("id").alias("id")), ["type", "topic"]).select("nth", "id")
    both = same.join(v.select(i.alias("nth"), F.col("embedding").alias("a")), "nth").join(v.select(i.alias("id"), F.col("embedding").alias("b")), "id").filter("size(a) = size(b)")
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)
    near = nearest.unionByName(both.select("nth", "id", sim(product))).groupBy("nth", "id").agg(F.max("similarity").alias("similarity"))
    return records.insert_entries(stored, entries, near, Params(variant=0.55, dedup=0.72, negation_floor=0.6))


@query("WITH s AS (SELECT user_id AS i, unnest([user_id % 50, event_id % 80]) AS id FROM events), c AS (SELECT id, count(*) AS n FROM s GROUP BY 1), r AS (SELECT doc_id AS id, coalesce(n, 0) AS served FROM documents LEFT JOIN c ON c.id = doc_id) SELECT id, served FROM r ORDER BY served DESC, id LIMIT 40 OFFSET 10")
def served_page(spark: SparkSession, d: str) -> DataFrame:
    """Records by how often they were served, from lists in JSON."""
    detail = F.to_json(F.struct(F.array(F.col("user_id") % 50, F.col("event_id") % 80).alias("ids")))
    served = table(spark, d, "events").select(F.from_json(F.get_json_object(detail, "$.ids"), "array<bigint>").alias("ids"))
    return records.served_most(table(spark, d, "documents").select(F.col("doc_id").alias("id")), served, 10, 40)


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'Cache,redis,' || source WHEN 1 THEN 'a,B,' || source || ',c' ELSE source END AS keywords FROM documents")
def keyword_union(spark: SparkSession, d: str) -> DataFrame:
    """Ordered union of comma lists whatever their case."""
    i, s = F.col("doc_id"), F.col("source")
    a = F.when(i % 3 == 0, "Cache, redis").when(i % 3 == 1, F.concat(F.lit("a,B, "), s))
    b = F.when(i % 3 == 0, F.concat(F.lit("CACHE,"), s, F.lit(", Redis"))).when(i % 3 == 1, "b,c,A").otherwise(s)
    return table(spark, d, "documents").select(i.alias("id"), records.csv_union(a, b).alias("keywords"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch(date_trunc('day', ts)) WHEN 1 THEN epoch(date_trunc('day', ts)) - 86400 WHEN 2 THEN floor(epoch(ts)) - 3 * 86400 WHEN 3 THEN floor(epoch(ts)) - 5 * 3600 WHEN 4 THEN floor(epoch(ts)) - 14 * 86400 ELSE epoch(TIMESTAMP '2024-01-05 06:00:00') END::BIGINT AS bound FROM events""")
def date_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds as people write them."""
    text = pick(F.col("event_id"), "today", "yesterday", "3d", "5 hours ago", "2w", "2024-01-05 06:00:00")
    return table(spark, d, "events").select("event_id", F.unix_timestamp(records.relative_bound(text, F.col("ts").cast("timestamp"))).alias("bound"))


@query("SELECT page_id, '\"' || array_to_string(list_filter(string_split_regex(regexp_replace(url, '[\"*():^]', ' ', 'g'), '\\s+'), lambda w: w <> ''), '\" \"') || '\"' AS terms FROM pages")
def quoted_terms(spark: SparkSession, d: str) -> DataFrame:
    """A search that is safe for a query language."""
    return table(spark, d, "pages").select("page_id", records.search_terms(F.col("url")).alias("terms"))


@query(f"""WITH {DELIVERIES}, r AS (SELECT doc_id AS id, ['explicit', 'correction', 'observation', 'meta-assessment', 'other'][doc_id % 5 + 1] AS src, ((doc_id * 37) % 100) / 100.0::DOUBLE AS c, doc_id % 200 AS age FROM documents),
    s AS (SELECT memory_id AS id, count(*) AS n, count(DISTINCT session_id) AS sessions, count(*) FILTER (engaged = 1) / count(*) AS rate FROM (SELECT * REPLACE (memory_id % 9 AS memory_id) FROM deliveries) GROUP BY 1),
    j AS (SELECT r.*, coalesce(n, 0) AS n, rate, CASE WHEN n IS NULL THEN 'decay' WHEN n >= 10 AND rate < 0.2 THEN 'archive' WHEN n >= 5 AND rate >= 0.8 AND sessions >= 3 THEN 'promote' WHEN rate BETWEEN 0.4 AND 0.6 THEN 'review' WHEN rate > 0.6 AND rate < 0.8 THEN 'near' ELSE 'keep' END AS move FROM r LEFT JOIN s USING (id))
    SELECT id, n, round(rate, 6) AS rate, move, round(CASE move WHEN 'promote' THEN 0.95 WHEN 'decay' THEN c * pow(0.5, age / CASE src WHEN 'explicit' THEN 120.0 WHEN 'correction' THEN 60.0 WHEN 'observation' THEN 30.0 WHEN 'meta-assessment' THEN 60.0 ELSE 1e18 END) ELSE c END, 6) AS confidence FROM j""")
def calibration_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Rules archived, pinned, put up for review or decayed."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("id"), pick(i, "explicit", "correction", "observation", "meta-assessment", "other").alias("source"), ((i * 37) % 100 / 100.0).alias("confidence"), F.timestamp_seconds(1704067200 - i % 200 * 86400).alias("updated_at"))
    sent = deliveries(spark, d).select((F.col("memory_id") % 9).alias("id"), "session_id", F.col("engaged").alias("followed"))
    done = records.calibration_moves(rows, sent, F.timestamp_seconds(F.lit(1704067200)))
    return done.select("id", "n", F.round("rate", 6).alias("rate"), "move", F.round("confidence", 6).alias("confidence"))


@query("WITH c AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1) SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE n END AS count, CASE WHEN id % 4 = 0 THEN 0 ELSE n END >= 10 AS retired FROM c")
def delivery_dampening(spark: SparkSession, d: str) -> DataFrame:
    """Counters of deliveries, and what is retired."""
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("count"))
    return records.dampened(counts, counts.filter("id % 4 = 0").select("id"))


#: Clusters of ids by hundreds of a column, as an assessment finds them.
CLUSTERS = "c AS (SELECT doc_id // 4 * 4 AS seed, doc_id AS id FROM documents)"


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select((F.expr("doc_id div 4") * 4).alias("seed"), F.col("doc_id").alias("id"))


PAIRS = f"{CLUSTERS}, p AS (SELECT x.seed, x.id AS a, y.id AS b FROM c x JOIN c y ON x.seed = y.seed AND x.id < y.id)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = _clusters(spark, d)
    return c.withColumnRenamed("id", "a").join(c.withColumnRenamed("id", "b"), "seed").filter("a < b")


@query(f"WITH {PAIRS} SELECT seed, id FROM c WHERE seed IN (SELECT seed FROM p WHERE seed % 12 <> 0 AND NOT (seed % 8 = 0 AND a % 2 = 0 AND b % 2 = 0))")
def open_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with a pair that no one assessed."""
    done = _pairs(spark, d).filter("seed % 12 = 0 OR (seed % 8 = 0 AND a % 2 = 0 AND b % 2 = 0)").select("a", "b")
    return curation.unassessed(_clusters(spark, d), done)


@query(f"WITH {PAIRS}, s AS (SELECT seed, a, b, ((a * a + b * 3) % 10) / 10.0::DOUBLE AS fwd, ((b * b + a * 3) % 10) / 10.0::DOUBLE AS rev FROM p), k AS (SELECT seed, unnest([a, b]) AS id FROM s WHERE fwd >= 0.5 AND rev >= 0.5) SELECT DISTINCT seed, id FROM k")
def entailed_members(spark: SparkSession, d: str) -> DataFrame:
    """Members that entail each other both ways."""
    p = _pairs(spark, d)
    score = lambda a, b: (F.col(a) * F.col(a) + F.col(b) * 3) % 10 / 10.0
    scores = p.select("a", "b", score("a", "b").alias("score")).unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), score("b", "a").alias("score")))
    return curation.entailed(_clusters(spark, d), scores, 0.5)


@query(f"""WITH {CLUSTERS}, n AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 + 1000000 AS new_id FROM (SELECT DISTINCT seed FROM c)), r AS (SELECT c.seed, doc_id AS id, text, row_number() OVER (PARTITION BY c.seed ORDER BY doc_id % 3 DESC, doc_id DESC) AS r FROM documents JOIN c ON c.id = doc_id)
    SELECT new_id AS id, sha256(text) AS mark, 0.5 AS confidence, NULL AS archived_reason FROM r JOIN n USING (seed) WHERE r = 1 UNION ALL SELECT id, sha256(text), 0.0, 'consolidated:' || new_id FROM r JOIN n USING (seed)""")
def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """C4: a new row of each cluster, from its newest one; the sources point to it."""
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(i.alias("id"), F.col("text").alias("content"), F.lit(0.5).alias("confidence"), (i % 3).alias("updated_at"), F.lit(None).cast("string").alias("archived_reason"))
    new, old = curation.merged_clusters(_clusters(spark, d), rows, 1_000_000)
    return new.unionByName(old).select("id", F.sha2("content", 256).alias("mark"), "confidence", "archived_reason")


@query(f"WITH {PAIRS}, n AS (SELECT a, b, CASE WHEN seed % 3 = 0 THEN 'consolidated' ELSE 'no_entailment' END AS verdict FROM p WHERE seed % 5 <> 0) SELECT * FROM n UNION ALL SELECT a, b, 'older' FROM p WHERE a % 2 = 0 AND seed % 5 = 0")
def assessment_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache of assessed pairs after a run."""
    c = _clusters(spark, d)
    seeds = c.select("seed").distinct()
    known = _pairs(spark, d).filter("a % 2 = 0").select("a", "b", F.lit("older").alias("verdict"))
    return curation.assessments(c, seeds.filter("seed % 3 = 0"), seeds.filter("seed % 5 = 0"), known)


@query(f"WITH {PAIRS} SELECT a, b FROM p WHERE greatest((a * 7 + b) % 21 - 15, (b * 7 + a) % 21 - 15) >= 0")
def contradiction_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that one direction at least contradicts."""
    rows = _pairs(spark, d).select("a", "b", ((F.col("a") * 7 + F.col("b")) % 21 - 15).alias("fwd"), ((F.col("b") * 7 + F.col("a")) % 21 - 15).alias("rev"))
    return curation.contradicted(rows).select("a", "b")


@query(f"WITH {PAIRS}, m AS (SELECT a AS id, max(b) AS n FROM p WHERE (a + b) % 3 = 0 GROUP BY 1) SELECT doc_id AS id, CASE WHEN n IS NOT NULL THEN 'superseded by #' || n WHEN doc_id % 13 = 0 THEN 'old' END AS archived_reason FROM documents LEFT JOIN m ON m.id = doc_id")
def superseding(spark: SparkSession, d: str) -> DataFrame:
    """Replaced records name the newest one that replaced them."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 == 0, "old").alias("archived_reason"))
    return curation.superseded(rows, _pairs(spark, d).filter("(a + b) % 3 = 0").select(F.col("a").alias("old"), F.col("b").alias("new")))


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), j AS (SELECT m.id, list_inner_product(r.e, m.e) AS near, list_inner_product(c.e, m.e) AS before, CASE WHEN m.id % 3 = 0 THEN 1 WHEN m.id % 3 = 1 THEN 0 END AS engaged, m.id % 4 AS k FROM v m JOIN v r ON r.id = (m.id + 1) % (SELECT count(*) FROM v) JOIN v c ON c.id = (m.id + 2) % (SELECT count(*) FROM v))
    SELECT id, CASE WHEN ok THEN 1 ELSE engaged END AS engaged, CASE WHEN ok THEN round_even(near, 4) ELSE 0.25 END AS engaged_score, CASE WHEN ok THEN 'semantic' ELSE 'lexical' END AS method, CASE WHEN k = 0 THEN 'corrected' ELSE 'used' END AS polarity
    FROM (SELECT *, coalesce(engaged, 0) <> 1 AND near >= 0.1 AND near - before >= 0.05 AS ok FROM j)""")
def engagement_rescue(spark: SparkSession, d: str) -> DataFrame:
    """A second chance by vectors, and whether a response disputes what it took up."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    n = v.count()
    at = lambda k, name: v.select(((F.col("id") - k + n) % n).alias("id"), F.col("embedding").alias(name))
    said = F.when(F.col("id") % 4 == 0, "fine then. the granite plan is outdated.").otherwise("the granite plan is good. that is outdated.")
    rows = v.withColumnRenamed("embedding", "v_memory").join(at(1, "v_response"), "id").join(at(2, "v_prompt"), "id").select("*", F.lit("granite velvet").alias("memory"), F.lit("velvet cloth").alias("prompt"), said.alias("response"))
    lexical = v.select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 0).alias("engaged"), F.lit(0.25).alias("engaged_score"))
    return outcomes.apply_engagement(rows, lexical, Params(semantic_threshold=0.1))


@query("WITH s AS (SELECT conv_id, max(turn) + 1 AS t FROM conversations GROUP BY 1) SELECT d.doc_id % 150 AS session_id, coalesce(t, 0) AS turn_index, d.doc_id AS id, d.doc_id % 4 AS served_rank, CASE WHEN 'src' || (d.doc_id % 3) = d.source THEN 'project' ELSE 'global' END AS scope FROM documents d LEFT JOIN s ON s.conv_id = d.doc_id % 150")
def delivery_rows(spark: SparkSession, d: str) -> DataFrame:
    """The log of what was served, at the session's next turn."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    served = docs.select((i % 150).alias("session_id"), F.concat(F.lit("src"), (i % 3).cast("string")).alias("project"), i.alias("id"), (i % 4).alias("rank"))
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_index"))
    return outcomes.delivery_log(served, turns, docs.select(i.alias("id"), F.col("source").alias("project")))


@query(f"""WITH {DELIVERIES}, f AS (SELECT unnest(range(0, 201)) / 200.0::DOUBLE AS floor), c AS (SELECT floor, count(*) FILTER (grade = 3 AND score >= floor) / count(*) FILTER (grade = 3) AS kept, 1 - count(*) FILTER (grade = 0 AND score >= floor) / count(*) FILTER (grade = 0) AS dropped FROM deliveries, f GROUP BY 1)
    SELECT (SELECT floor FROM c WHERE kept >= 0.95 ORDER BY round(dropped, 9) DESC, floor LIMIT 1) AS floor, (SELECT floor FROM c ORDER BY round(kept + dropped - 1, 9) DESC, floor LIMIT 1) AS youden_floor""")
def chosen_floor(spark: SparkSession, d: str) -> DataFrame:
    """The floor that drops most noise and keeps what is good."""
    return outcomes.best_floor(outcomes.floor_sweep(deliveries(spark, d).select("grade", "score"), [i / 200 for i in range(201)]))


@query(f"""WITH {DELIVERIES}, s AS (SELECT method FROM deliveries GROUP BY 1 HAVING count(*) FILTER (engaged = 1) > 0 AND count(*) FILTER (engaged = 0) > 0), n AS (SELECT d.* REPLACE (CASE WHEN s.method IS NOT NULL THEN engaged END AS engaged), CASE WHEN version < 'src3' THEN 'a' ELSE 'b' END AS arm FROM deliveries d LEFT JOIN s ON s.method = d.method)
    SELECT count(engaged) FILTER (arm = 'a') AS n_a, round(100.0 * count(*) FILTER (arm = 'a' AND engaged = 1) / count(engaged) FILTER (arm = 'a'), 6) AS engaged_pct_a, count(grade) FILTER (arm = 'a') AS graded_a, round(avg(grade) FILTER (arm = 'a'), 6) AS grade_a,
        count(engaged) FILTER (arm = 'b') AS n_b, round(100.0 * count(*) FILTER (arm = 'b' AND engaged = 1) / nullif(count(engaged) FILTER (arm = 'b'), 0), 6) AS engaged_pct_b, count(grade) FILTER (arm = 'b') AS graded_b, round(avg(grade) FILTER (arm = 'b'), 6) AS grade_b FROM n""")
def arm_readout(spark: SparkSession, d: str) -> DataFrame:
    """What each arm, by the version that served, came to."""
    rows = deliveries(spark, d).withColumn("arm", F.when(F.col("version") < "src3", "a").otherwise("b"))
    done = outcomes.arm_stats(rows)
    return done.select(*[F.round(c, 6).alias(c) if "pct" in c or c.startswith("grade_") else c for c in done.columns])


@query(f"""WITH {DELIVERIES}, s AS (SELECT version AS experiment, id AS pos, id % 2 = 0 AND id >= 100 AS candidate, toxic = 1 OR id % 9 = 0 AS flagged FROM deliveries), w AS (SELECT *, min(CASE WHEN candidate THEN pos END) OVER (PARTITION BY experiment) AS since FROM s)
    SELECT experiment, count(*) FILTER (NOT candidate) AS n_old, count(*) FILTER (candidate) AS n_new, round(count(*) FILTER (NOT candidate AND flagged) / nullif(count(*) FILTER (NOT candidate), 0), 6) AS rate_old, round(count(*) FILTER (candidate AND flagged) / nullif(count(*) FILTER (candidate), 0), 6) AS rate_new FROM w WHERE pos >= since GROUP BY 1""")
def compliance_window(spark: SparkSession, d: str) -> DataFrame:
    """Flags before and since a candidate began."""
    i = F.col("id")
    rows = deliveries(spark, d).select(F.col("version").alias("experiment"), i.alias("at"), ((i % 2 == 0) & (i >= 100)).alias("candidate"), ((F.col("toxic") == 1) | (i % 9 == 0)).alias("flagged"))
    done = outcomes.compliance_gate(rows)
    return done.select("experiment", "n_old", "n_new", F.round("rate_old", 6).alias("rate_old"), F.round("rate_new", 6).alias("rate_new"))


@query(f"WITH {DELIVERIES}, g AS (SELECT session_id, turn_index, id, CASE WHEN engaged = 1 THEN 3 WHEN engaged = 0 THEN 0 END AS label FROM deliveries WHERE engaged IS NOT NULL) SELECT session_id, turn_index, id, label FROM g WINDOW w AS (PARTITION BY session_id, turn_index) QUALIFY min(label) OVER w < max(label) OVER w")
def training_groups(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows of turns that have both kinds."""
    return outcomes.training_groups(deliveries(spark, d)).select("session_id", "turn_index", "id", "label")


@query("""WITH e AS (SELECT event_id AS id, user_id, ts, event_type AS layer, ['w' || (event_id % 5), 'w' || (event_id % 3 + 1)] AS ws FROM events WHERE event_type IN ('purchase', 'signup')), r AS (SELECT user_id, ts, ['w' || (event_id % 4), 'w' || (event_id % 3), 'w' || (event_id % 5)] AS ws, event_id FROM events WHERE event_type = 'view'),
    n AS (SELECT e.id, e.layer, row_number() OVER (PARTITION BY e.id ORDER BY r.ts, r.ws) AS nth, len(list_intersect(list_distinct(e.ws), list_distinct(r.ws))) >= 2 AS hit FROM e JOIN r ON r.user_id = e.user_id AND r.ts >= e.ts QUALIFY nth <= 10), f AS (SELECT id, min(nth) AS first FROM n WHERE hit GROUP BY 1)
    SELECT layer, w, count(*) AS n, count(*) FILTER (first <= w) AS engaged FROM (SELECT e.layer, first, unnest([1, 3, 5, 10]) AS w FROM e LEFT JOIN f USING (id)) GROUP BY ALL""")
def engagement_windows(spark: SparkSession, d: str) -> DataFrame:
    """How soon what was served is taken up, by layer."""
    e, i = table(spark, d, "events"), F.col("event_id")
    w = lambda *x: F.array(*[F.concat(F.lit("w"), y.cast("string")) for y in x])
    sent = e.filter("event_type IN ('purchase', 'signup')").select(i.alias("id"), F.col("user_id").alias("session_id"), F.col("ts").alias("at"), F.col("event_type").alias("layer"), w(i % 5, i % 3 + 1).alias("words"))
    said = e.filter("event_type = 'view'").select(F.col("user_id").alias("session_id"), F.col("ts").alias("at"), w(i % 4, i % 3, i % 5).alias("text_words"))
    return outcomes.windows_engaged(sent, said)


@query(f"WITH {NEAR}, q AS (SELECT query_id, id, similarity, CASE WHEN id % 4 = 0 THEN 0.9 ELSE similarity END AS x, id % 10 = 0 AS pinned, id % 3 AS priority, ((id * 7) % 10) / 10.0::DOUBLE AS shared FROM sims), s AS (SELECT *, 0.55 * x + 0.20 * shared + 0.15 * 0.7 + 0.10 * pinned::INT AS score FROM q) SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, round(score, 9) DESC, priority DESC, id) - 1 AS rank FROM s WHERE score >= 0.6 OR pinned QUALIFY rank < 5")
def calibration_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Rules for a prompt; question forms' vectors count before the row's, pinned rows come first."""
    i = F.col("id")
    best = _near(spark, d).withColumn("similarity", F.when(i % 4 == 0, 0.9).otherwise(F.col("similarity"))).select("query_id", "id", "similarity", ((i * 7) % 10 / 10.0).alias("shared"), F.lit(0.7).alias("confidence"), (i % 10 == 0).alias("pinned"), (i % 3).alias("priority"))
    return gates.calibration(best, floor=0.6).withColumn("score", F.round("score", 6))


@query(f"WITH {NEAR}, b AS (SELECT query_id, arg_max(id, (round(similarity, 9), -id)) AS id, max(round(similarity, 9)) AS s FROM sims WHERE label = 3 GROUP BY 1) SELECT query_id, id, round(s, 6) AS similarity, s >= 0.62 AS fires FROM b WHERE s > 0.55")
def trigger_match(spark: SparkSession, d: str) -> DataFrame:
    """The trigger that is nearest to a query, if it is near enough."""
    return gates.best_trigger(_near(spark, d, 0.55).filter("label = 3"), 0.62, 0.55).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {NEAR} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) - 1 AS rank FROM sims WHERE label = 2 AND id % 7 <> 0 AND similarity >= 0.52 QUALIFY rank < 5")
def correction_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The corrections nearest to a first prompt, suppressed ones left out."""
    found = _near(spark, d, 0.52).filter("label = 2 AND id % 7 <> 0 AND similarity >= 0.52")
    return retrieval.top_k(found, ["query_id"], [F.round("similarity", 9).desc(), F.col("id")], 5).select("query_id", "id", "rank")


@query(f"WITH {NEAR} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) - 1 AS rank FROM sims WHERE similarity >= 0.60 AND id % 2 = 0")
def topic_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All rows whose topic vector is near; rows without one are left out."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, F.col("embedding")).alias("embedding"))
    q = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.vector_top_k(v, q, None, 2 * 0.6 - 1 - 1e-6).filter("id <> query_id").withColumn("similarity", (1 + F.col("similarity")) / 2).filter("similarity >= 0.6")
    return retrieval.top_k(found, ["query_id"], [F.round("similarity", 9).desc(), F.col("id")], 1 << 30).select("query_id", "id", "rank")


@query(f"WITH {NEAR}, e AS (SELECT query_id, id, similarity FROM sims WHERE id < query_id AND id // 500 = query_id // 500) SELECT query_id, arg_max(id, (round(similarity, 9), -id)) AS id FROM e WHERE similarity >= 0.6 GROUP BY 1")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """The earlier need of the same session that is near enough to answer a new one."""
    earlier = _near(spark, d, 0.6).filter("id < query_id AND id div 500 = query_id div 500 AND similarity >= 0.6")
    return retrieval.top_k(earlier, ["query_id"], [F.round("similarity", 9).desc(), F.col("id")], 1).select("query_id", "id")


@query(f"WITH {NEAR}, k AS (SELECT query_id, id, 0 AS source, row_number() OVER (PARTITION BY query_id ORDER BY id) - 1 AS r FROM sims WHERE (id + query_id) % 97 = 0), h AS (SELECT query_id, id, 1 AS source, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) - 1 AS r FROM sims WHERE label <> 1 AND similarity >= 0.6), u AS (SELECT query_id, id, min((source, r)) AS x FROM (SELECT * FROM k UNION ALL SELECT * FROM h) GROUP BY ALL) SELECT query_id, id, x[1] AS source, row_number() OVER (PARTITION BY query_id ORDER BY x, id) - 1 AS rank FROM u QUALIFY rank < 3".replace("min((source, r)) AS x", "min({'s': source, 'r': r}) AS x").replace("x[1]", "x.s"))
def cross_project(spark: SparkSession, d: str) -> DataFrame:
    """What other projects know: keyword hits first, then near rows, three in all, so three of each list suffice."""
    most = 3
    v = table(spark, d, "embeddings").filter("embedding IS NOT NULL").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = v.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    key = lambda x: F.pmod(x, F.lit(97)).alias("key")  # noqa: E731  a keyword hit: (id + query_id) % 97 = 0
    hits = retrieval.top_k(v.select("id", key(-F.col("id"))), ["key"], [F.col("id")], most + 1).drop("rank")  # one more: the query's own
    hits = q.select("query_id", key(F.col("query_id"))).join(hits, "key").filter("id <> query_id").select("query_id", "id")
    by_words = retrieval.top_k(hits, ["query_id"], [F.col("id")], most)
    near = retrieval.vector_candidates(v.filter("label <> 1"), q, most + 1, 2 * 0.6 - 1 - 1e-6, weight=0.5).filter("id <> query_id").withColumn("similarity", (1 + F.col("similarity")) / 2)
    hybrid = retrieval.top_k(near.filter("similarity >= 0.6"), ["query_id"], [F.round("similarity", 9).desc(), F.col("id")], most)
    return gates.first_source([by_words, hybrid], most)


@query(f"WITH {NEAR}, f AS (SELECT query_id, count(*) AS n, max(similarity) AS top FROM sims WHERE similarity >= 0.63 GROUP BY 1), q AS (SELECT DISTINCT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, coalesce(n, 0) < 3 OR coalesce(top, 0) < 0.45 AS thin FROM q LEFT JOIN f USING (query_id)")
def thin_results(spark: SparkSession, d: str) -> DataFrame:
    """Queries that found too little."""
    q = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    return retrieval.thin(_near(spark, d, 0.63).filter("similarity >= 0.63"), q)


@query("SELECT item_id, CASE WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) < 10 THEN 'before ' || q ELSE q END AS query FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'what of ' || item_id ELSE text END AS q FROM benchmark)")
def enriched_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Short prompts get what came before them."""
    q = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("what of "), F.col("item_id").cast("string"))).otherwise(F.col("text"))
    return gates.enriched(table(spark, d, "benchmark").select("item_id", q.alias("query"), F.lit("before").alias("context"))).select("item_id", "query")


@query(f"""WITH {RECORDS} SELECT id, CASE WHEN confidence >= 0.6 THEN 'strong' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'weak' END AS band, length(trim(content)) >= 10 AND NOT regexp_matches(lower(content), 'no context available|no relevant context|unclear what this refers to') AS content,
    type IN ('fact', 'decision') AND list_has_any(string_split_regex(lower(content), '\\s+'), ['plan']) AS planned FROM (SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN 'No context available ' || content WHEN id % 9 = 1 THEN 'a plan ' || content WHEN id % 9 = 2 THEN 'tiny' ELSE regexp_replace(content, '[A-Za-z]', 'x', 'g') END AS content, CASE WHEN id % 2 = 0 THEN 'fact' ELSE 'person' END AS type) FROM records)""")
def record_gates(spark: SparkSession, d: str) -> DataFrame:
    """Bands, empty contents and plans."""
    i = F.col("id")
    rows = record_rows(spark, d).withColumn("content", F.when(i % 9 == 0, F.concat(F.lit("No context available "), F.col("content"))).when(i % 9 == 1, F.concat(F.lit("a plan "), F.col("content"))).when(i % 9 == 2, "tiny").otherwise(F.regexp_replace("content", "[A-Za-z]", "x"))).withColumn("type", F.when(i % 2 == 0, "fact").otherwise("person"))
    return rows.select("id", predicates.reliability_band(F.col("confidence")).alias("band"), predicates.has_content(F.col("content")).alias("content"), predicates.plan_like(F.col("content"), F.col("type")).alias("planned"))


@query("SELECT event_id, event_id % 3 = 1 OR event_id % 7 = 0 OR event_id % 5 = 0 OR event_id % 11 = 0 AS high FROM events")
def tool_signals(spark: SparkSession, d: str) -> DataFrame:
    """Results of tools that tell something."""
    i = F.col("event_id")
    out = F.when(i % 7 == 0, F.concat(F.col("props"), F.lit(" fatal: no"))).when(i % 5 == 0, F.repeat(F.lit("line\n"), 60)).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", predicates.high_signal(F.when(i % 3 == 1, 1).otherwise(0), out, i % 11 == 0).alias("high"))


@query("SELECT event_type, sum(value) IS NOT NULL AS live, count(*) AS n FROM (SELECT event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type, value FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def live_and_frozen(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of two stores, one after the other."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    both = e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 3 = 0"))
    return both.groupBy("event_type").agg(F.sum("value").isNotNull().alias("live"), F.count("*").alias("n"))


@query("SELECT v.vec_id AS id, d.lang, round(list_sum(list_transform(v.embedding::DOUBLE[], lambda x: x * x)), 4) AS norm FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id")
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as stored bytes and back, beside their records."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), scalars.vector_bytes(F.col("embedding")).alias("blob"))
    back = v.select("id", scalars.bytes_vector(F.col("blob")).alias("e")).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return back.select("id", "lang", F.round(scalars.dot(F.col("e"), F.col("e")), 4).alias("norm"))


@query(f"WITH {RECORDS}, s AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0), k AS (SELECT session_id, count(*) AS n FROM records GROUP BY 1) SELECT r.id, r.session_id, s.conv_id IS NOT NULL AS known, k.n AS siblings FROM records r LEFT JOIN s ON s.conv_id = r.session_id JOIN k USING (session_id)")
def records_with_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Records beside their sessions, which may be gone, and how many the session has."""
    r = record_rows(spark, d).select("id", "session_id")
    s = table(spark, d, "conversations").filter("conv_id % 3 <> 0").select(F.col("conv_id").alias("session_id"), F.lit(True).alias("known")).distinct()
    return r.join(s, "session_id", "left").join(r.groupBy("session_id").agg(F.count("*").alias("siblings")), "session_id").select("id", "session_id", F.coalesce("known", F.lit(False)).alias("known"), "siblings")


@query(f"WITH {PAIRS}, n AS (SELECT doc_id AS id, sha256(doc_id::VARCHAR) AS uuid FROM documents WHERE doc_id % 5 <> 0) SELECT x.uuid AS a, y.uuid AS b FROM p JOIN n x ON x.id = p.a JOIN n y ON y.id = p.b")
def rekeyed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Assessed pairs under the keys that travel; pairs of unknown records stay behind."""
    names = table(spark, d, "documents").filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.col("doc_id").cast("string"), 256).alias("uuid"))
    return merge.rekeyed(_pairs(spark, d).select("a", "b"), names, ["a", "b"])


@query(f"WITH {DELIVERIES} SELECT version, CASE WHEN version IS NULL THEN 'unversioned' WHEN version LIKE '{{%' THEN 'ingest' ELSE version END AS label, count(*) AS n FROM (SELECT CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{{\"chunk\":1}}' ELSE version END AS version FROM deliveries) GROUP BY ALL")
def version_labels(spark: SparkSession, d: str) -> DataFrame:
    """What wrote a record, in words."""
    v = F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 4 == 1, '{"chunk":1}').otherwise(F.col("version"))
    rows = deliveries(spark, d).select(v.alias("version"))
    return rows.groupBy("version", outcomes.version_label(F.col("version")).alias("label")).agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT conv_id, CASE (conv_id + turn) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS vote FROM conversations) SELECT count(*) FILTER (vote = 'A') AS a, count(*) FILTER (vote = 'B') AS b, count(*) FILTER (vote = 'tie') AS tie, count(*) AS n FROM v")
def cohort_tally(spark: SparkSession, d: str) -> DataFrame:
    """Votes for one cohort, the other, or none."""
    k = (F.col("conv_id") + F.col("turn")) % 3
    return table(spark, d, "conversations").agg(F.count_if(k == 0).alias("a"), F.count_if(k == 1).alias("b"), F.count_if(k == 2).alias("tie"), F.count("*").alias("n"))


@query("WITH h AS (SELECT conv_id, turn, turn AS est, text FROM conversations), k AS (SELECT a.conv_id, a.turn, min(b.turn) AS first, max(b.turn) AS last, count(*) AS hits FROM h a JOIN h b ON a.conv_id = b.conv_id AND contains(lower(b.text), ' an') GROUP BY ALL) SELECT conv_id, turn, first, last, hits, turn < first OR turn > last AS drifted FROM k")
def source_drift(spark: SparkSession, d: str) -> DataFrame:
    """Where a record's words stand in its session, and whether that is where it was thought to be."""
    t = table(spark, d, "conversations")
    hits = t.filter(F.contains(F.lower("text"), F.lit(" an"))).groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("hits"))
    return t.select("conv_id", "turn").join(hits, "conv_id").withColumn("drifted", (F.col("turn") < F.col("first")) | (F.col("turn") > F.col("last")))
