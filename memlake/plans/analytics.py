"""Outcome analytics, merging and graph queries, each with the SQL that an oracle runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hash_bucket, pseudo_random, saturated_confidence
from ..operators import graph, merge, outcomes
from ..operators.exchange import Changeset, Replica, exchange
from ..operators.sessions import around, as_of_backward, next_rows, turn_context
from ..params import Params
from .inputs import DELIVERIES, EDGES, deliveries, edges, records, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


PCT = "CASE WHEN {b} > 0 THEN round_even(100.0 * {a} / {b}, 1) END"
OUTCOME = f"""count(*)::BIGINT AS n, count(engaged)::BIGINT AS decided, {PCT.format(a="count(engaged)", b="count(*)")} AS coverage_pct,
    {PCT.format(a="count(*) FILTER (engaged = 1)", b="count(engaged)")} AS engaged_pct, round_even(avg(engaged_score) FILTER (engaged_score >= 0), 4) AS avg_score,
    count(grade)::BIGINT AS graded, round_even(avg(grade), 4) AS avg_grade"""
NEUTRAL = """s AS (SELECT method FROM deliveries GROUP BY 1 HAVING count(*) FILTER (engaged = 1) > 0 AND count(*) FILTER (engaged = 0) > 0),
    neutral AS (SELECT d.* REPLACE (CASE WHEN s.method IS NOT NULL THEN engaged END AS engaged, CASE WHEN s.method IS NOT NULL THEN engaged_score END AS engaged_score) FROM deliveries d LEFT JOIN s ON s.method = d.method)"""


@query(f"WITH {DELIVERIES}, {NEUTRAL} SELECT layer, {OUTCOME} FROM neutral GROUP BY 1")
def outcome_by_layer(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes by layer, with methods that see one class only made undecided."""
    rows = deliveries(spark, d)
    return outcomes.outcomes(outcomes.neutralise(rows, outcomes.qualifying_strata(rows)), "layer")


@query(f"WITH {DELIVERIES} SELECT method, count(*) FILTER (engaged = 1)::BIGINT AS yes, count(*) FILTER (engaged = 0)::BIGINT AS no FROM deliveries GROUP BY 1 HAVING yes > 0 AND no > 0")
def qualifying_strata(spark: SparkSession, d: str) -> DataFrame:
    """A10."""
    return outcomes.qualifying_strata(deliveries(spark, d))


@query(f"""WITH {DELIVERIES}, k AS (SELECT 'method' AS axis, method AS key, engaged FROM deliveries UNION ALL SELECT 'version', version, engaged FROM deliveries UNION ALL SELECT 'layer', layer, engaged FROM deliveries)
    SELECT axis, key, count(*)::BIGINT AS n, count(engaged)::BIGINT AS decided, {PCT.format(a="count(*) FILTER (engaged = 1)", b="count(engaged)")} AS engaged_pct FROM k GROUP BY ALL""")
def outcome_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return outcomes.readout(deliveries(spark, d), ["method", "version", "layer"])


@query(f"""WITH {DELIVERIES}, t AS (SELECT *, count(*) OVER (PARTITION BY session_id, turn_index) AS turn_size FROM deliveries)
    SELECT turn_size, served_rank, count(engaged)::BIGINT AS decided, count(*) FILTER (engaged = 1)::BIGINT AS engaged, {PCT.format(a="count(*) FILTER (engaged = 1)", b="count(engaged)")} AS engaged_pct FROM t GROUP BY ALL HAVING decided >= 5""")
def marginal_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """A14, W6."""
    return outcomes.marginal_by_rank(deliveries(spark, d).select("session_id", "turn_index", "served_rank", "engaged"))


@query(f"""WITH {DELIVERIES}, c AS (SELECT memory_id, kind, count(*)::BIGINT AS delivered, count(engaged)::BIGINT AS scored, coalesce(sum(engaged), 0)::BIGINT AS engaged, max(grade)::INTEGER AS max_grade FROM deliveries GROUP BY ALL)
    SELECT * FROM c WHERE delivered >= CASE WHEN kind = 'correction' THEN 2 ELSE 1 END AND scored >= 1 AND engaged = 0 AND coalesce(max_grade, 0) <= 0 AND kind NOT IN ('person', 'preference')""")
def suppress_dead_weight(spark: SparkSession, d: str) -> DataFrame:
    """O19, A18."""
    return outcomes.dead_weight(deliveries(spark, d), Params(suppress_delivered=1, suppress_corrections=2, suppress_scored=1))


@query(f"""WITH {DELIVERIES}, f AS (SELECT unnest(range(0, 201)) / 200.0::DOUBLE AS floor), c AS (SELECT floor, count(*) FILTER (grade = 3 AND score >= floor) AS good, count(*) FILTER (grade = 0 AND score >= floor) AS noise,
    count(*) FILTER (grade = 3) AS all_good, count(*) FILTER (grade = 0) AS all_noise FROM deliveries, f GROUP BY 1)
    SELECT floor, round(good / all_good, 9) AS kept, round(1 - noise / all_noise, 9) AS dropped, round(good / all_good - noise / all_noise, 9) AS youden, good / all_good >= 0.95 AS allowed FROM c""")
def floor_sweep(spark: SparkSession, d: str) -> DataFrame:
    """O13."""
    rows = outcomes.floor_sweep(deliveries(spark, d).select("grade", "score"), [i / 200 for i in range(201)])
    return rows.select("floor", *[F.round(c, 9).alias(c) for c in ("kept", "dropped", "youden")], "allowed")


@query(f"WITH {DELIVERIES}, g AS (SELECT *, CASE WHEN engaged = 1 THEN 3 WHEN engaged = 0 THEN 0 END AS pg FROM deliveries) SELECT a.session_id, a.id AS winner, b.id AS loser FROM g a JOIN g b ON a.session_id = b.session_id AND a.turn_index = b.turn_index AND a.pg >= b.pg + 2")
def pair_labels(spark: SparkSession, d: str) -> DataFrame:
    """O9, O10, O11."""
    rows = deliveries(spark, d).select("id", "session_id", "turn_index", outcomes.pseudo_grade(F.col("engaged")).alias("grade"))
    return outcomes.label_pairs(rows, ["session_id", "turn_index"]).select("session_id", "winner", "loser")


@query(f"WITH {DELIVERIES} SELECT count(*) FILTER (quality = 1 AND toxic = 1)::BIGINT AS tp, count(*) FILTER (quality <> 1 AND toxic = 1)::BIGINT AS fp, count(*) FILTER (quality = 1 AND toxic <> 1)::BIGINT AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1)::BIGINT AS tn, round_even((tp + tn) / (tp + tn + fp + fn), 4) AS agreement, agreement >= 0.75 AS passes FROM deliveries")
def confusion_gate(spark: SparkSession, d: str) -> DataFrame:
    """A30."""
    return outcomes.confusion(deliveries(spark, d), "quality", "toxic")


@query(f"""WITH {DELIVERIES}, a AS (SELECT count(engaged) FILTER (id % 2 = 0) AS n_a, count(engaged) FILTER (id % 2 = 1) AS n_b,
    100.0 * count(*) FILTER (id % 2 = 0 AND engaged = 1) / count(engaged) FILTER (id % 2 = 0) AS ea, 100.0 * count(*) FILTER (id % 2 = 1 AND engaged = 1) / count(engaged) FILTER (id % 2 = 1) AS eb FROM deliveries)
    SELECT n_a::BIGINT AS n_a, n_b::BIGINT AS n_b, CASE WHEN n_a < 30 OR n_b < 30 THEN 'running' WHEN eb - ea >= 15 THEN 'promote' WHEN eb - ea <= -15 THEN 'rollback' ELSE 'inconclusive' END AS decision FROM a""")
def ab_decision(spark: SparkSession, d: str) -> DataFrame:
    """O15, O16."""
    rows = deliveries(spark, d)
    one = lambda k: F.col("id") % 2 == k
    pct = lambda k: 100.0 * F.count_if(one(k) & (F.col("engaged") == 1)) / F.count(F.when(one(k), F.col("engaged")))
    arms = rows.agg(F.count(F.when(one(0), F.col("engaged"))).alias("n_a"), F.count(F.when(one(1), F.col("engaged"))).alias("n_b"), pct(0).alias("engaged_pct_a"), pct(1).alias("engaged_pct_b"), F.lit(0).alias("graded_a"), F.lit(0).alias("graded_b"), F.lit(0.0).alias("grade_a"), F.lit(0.0).alias("grade_b"))
    return outcomes.ab_decision(arms).select("n_a", "n_b", "decision")


@query(f"""WITH RECURSIVE {DELIVERIES}, t AS (SELECT version, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (quality <> 1 AND toxic = 1) AS c, count(*) FILTER (quality <> 1 AND toxic <> 1) AS d FROM deliveries GROUP BY 1),
    w AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS x FROM t), l AS (SELECT *, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) AS p FROM w),
    h AS (SELECT version, p AS here FROM l WHERE x = a) SELECT version, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(least(1, sum(exp(p)) FILTER (p <= here + 1e-9)), 9) AS p FROM l JOIN h USING (version) GROUP BY ALL""")
def fisher_gate(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity against quality in each source, exact test."""
    rows = deliveries(spark, d)
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    tables = rows.groupBy("version").agg(F.count_if(q & t).alias("a"), F.count_if(q & ~t).alias("b"), F.count_if(~q & t).alias("c"), F.count_if(~q & ~t).alias("d"))
    return outcomes.fisher_exact(tables).withColumn("p", F.round("p", 9))


@query("WITH p AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS h FROM documents), x AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [CAST('0x' || h[i:i+3] AS BIGINT) for i in range(1, 41, 4)]), lambda a, b: (a * 65536 + b) % 1000) AS bucket FROM p) SELECT doc_id, bucket, doc_id * 2654435761 % 1000 AS random_place FROM x")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Stable buckets and a pseudo-random order."""
    return table(spark, d, "documents").select("doc_id", hash_bucket(F.col("doc_id").cast("string")).alias("bucket"), pseudo_random(F.col("doc_id"), 1000).alias("random_place"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((F.col("o_orderkey") % 3000).alias("id"), (F.col("o_custkey") % 50).alias("lamport"), F.concat(F.lit("n"), (F.col("o_orderkey") % 7).cast("string")).alias("node"), F.col("o_orderkey").alias("content"), F.when(F.col("o_orderkey") % 9 == 0, "private").otherwise("team").alias("visibility"))


VERSIONS = "versions AS (SELECT o_orderkey % 3000 AS id, o_custkey % 50 AS lamport, 'n' || CAST(o_orderkey % 7 AS VARCHAR) AS node, o_orderkey AS content, CASE WHEN o_orderkey % 9 = 0 THEN 'private' ELSE 'team' END AS visibility FROM orders)"


@query(f"WITH {VERSIONS}, w AS (SELECT id, lamport, node, max(content) AS content FROM versions GROUP BY ALL) SELECT id, lamport, node, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lamport DESC, node DESC) AS r FROM w) WHERE r = 1")
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    """Last writer wins by (lamport, node)."""
    one = _versions(spark, d).groupBy("id", "lamport", "node").agg(F.max("content").alias("content"))
    return merge.last_writer_wins(one, "id")


@query(f"WITH {VERSIONS} SELECT id, round(1 - 0.3 * pow(0.9, count(*) FILTER (content % 3 = 0)), 9) AS confidence, max_by('r' || CAST(content AS VARCHAR), lamport * 10000000 + content) FILTER (content % 5 = 0 AND content % 3 <> 0) AS annotation FROM versions GROUP BY 1")
def crdt_confidence(spark: SparkSession, d: str) -> DataFrame:
    """M4."""
    c = F.col("content")
    log = _versions(spark, d).select("id", F.when(c % 3 == 0, "+").when(c % 5 == 0, "-!").otherwise("-").alias("direction"), F.concat(F.lit("r"), c.cast("string")).alias("reason"), "lamport", F.lpad(c.cast("string"), 9, "0").alias("log_uuid"))
    return merge.convergent_confidence(log)


@query(f"WITH {VERSIONS} SELECT id, min(lamport) AS deleted_at FROM versions WHERE content % 4 = 0 GROUP BY 1")
def tombstone_min(spark: SparkSession, d: str) -> DataFrame:
    """M5."""
    return merge.tombstones(_versions(spark, d).filter("content % 4 = 0").withColumnRenamed("lamport", "deleted_at"), "id")


@query(f"WITH {VERSIONS}, m AS (SELECT node, max(lamport) - 5 AS mark FROM versions GROUP BY 1) SELECT v.id, v.lamport, v.content FROM versions v LEFT JOIN m USING (node) WHERE node = 'n3' AND visibility <> 'private' AND lamport > mark ORDER BY lamport, id, content LIMIT 5000")
def watermark_delta(spark: SparkSession, d: str) -> DataFrame:
    """M1, M6."""
    rows = _versions(spark, d)
    marks = merge.watermarks(rows).withColumn("lamport", F.col("lamport") - 5)
    return merge.changeset(rows, marks, "n3", 5000).select("id", "lamport", "content")


@query("""WITH f AS (SELECT doc_id, sha256(coalesce(CAST(length(lang) AS VARCHAR) || ':' || lang, '-') || coalesce(CAST(length(text) AS VARCHAR) || ':' || text, '-')) AS m FROM documents),
    o AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE m END AS old FROM f WHERE doc_id % 10 <> 0), n AS (SELECT * FROM f WHERE doc_id % 15 <> 1)
    SELECT doc_id, CASE WHEN old IS NULL THEN 'new' WHEN m IS NULL THEN 'gone' WHEN old <> m THEN 'changed' ELSE 'same' END AS state FROM n FULL JOIN o USING (doc_id)""")
def fingerprint_diff(spark: SparkSession, d: str) -> DataFrame:
    """M9."""
    f = table(spark, d, "documents").select("doc_id", merge.fingerprint(F.col("lang"), F.col("text")).alias("fingerprint"))
    old = f.filter("doc_id % 10 <> 0").withColumn("fingerprint", F.when(F.col("doc_id") % 6 == 0, "x").otherwise(F.col("fingerprint")))
    return merge.changed_units(f.filter("doc_id % 15 <> 1"), old, ["doc_id"])


@query(f"WITH {EDGES} SELECT target, count(DISTINCT source)::BIGINT AS sources, count(*)::BIGINT AS edges FROM edges GROUP BY 1 ORDER BY sources DESC, target LIMIT 10")
def fan_in_topk(spark: SparkSession, d: str) -> DataFrame:
    """A35, J12."""
    return graph.fan_in(edges(spark, d), 10)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    names = e.select(F.col("source").alias("name")).union(e.select("target")).distinct()
    n = F.substring("name", 2, 9).cast("long")
    return names.select("name", (n % 5 == 0).alias("is_test"), F.concat(F.lit("f"), (n % 11).cast("string")).alias("file"))


NODES = "nodes AS (SELECT name, n % 5 = 0 AS is_test, 'f' || CAST(n % 11 AS VARCHAR) AS file FROM (SELECT DISTINCT name, CAST(name[2:] AS BIGINT) AS n FROM (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges)))"


@query(f"WITH {EDGES}, {NODES} SELECT name, is_test, file FROM nodes WHERE name NOT IN (SELECT target FROM edges)")
def entry_points_anti(spark: SparkSession, d: str) -> DataFrame:
    """J10."""
    return graph.entry_points(_nodes(spark, d), edges(spark, d))


@query(f"""WITH {EDGES}, {NODES}, c AS (SELECT target AS name, count(DISTINCT source) AS callers, count(DISTINCT source) FILTER (is_test) AS tests, count(DISTINCT file) AS files FROM edges JOIN nodes n ON n.name = source GROUP BY 1)
    SELECT name, coalesce(callers, 0)::BIGINT AS callers, coalesce(tests, 0)::BIGINT AS tests, coalesce(files, 0)::BIGINT AS files FROM nodes LEFT JOIN c USING (name)""")
def impact(spark: SparkSession, d: str) -> DataFrame:
    """A36."""
    return graph.impact(_nodes(spark, d), edges(spark, d))


@query("""WITH RECURSIVE s AS (SELECT o_orderkey AS session_id, CASE WHEN o_orderkey // 3 > 0 THEN o_orderkey // 3 END AS parent FROM orders),
    w AS (SELECT session_id AS start, session_id, 0::BIGINT AS depth FROM s WHERE session_id % 100 = 0 UNION ALL SELECT w.start, s.parent, w.depth + 1 FROM w JOIN s ON s.session_id = w.session_id WHERE s.parent IS NOT NULL)
    SELECT start, session_id, depth FROM w""")
def recursive_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of one session in a hundred, the asked ones."""
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.expr("CASE WHEN o_orderkey div 3 > 0 THEN o_orderkey div 3 END").alias("parent_session_id"))
    return graph.chain(s, s.filter("session_id % 100 = 0"))


@query("SELECT a.event_id, (SELECT max(struct_pack(t := b.ts, e := b.event_id)).e FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts) AS view_id FROM events a WHERE a.event_type = 'purchase'")
def asof_prev_view(spark: SparkSession, d: str) -> DataFrame:
    """The last view at or before each purchase of a user."""
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of_backward(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", ["view_id"]).select("event_id", "view_id")


@query("""WITH c AS (SELECT a.event_id, b.event_id AS next_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) AS nth FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.event_type = 'view' WHERE a.event_type = 'purchase') SELECT event_id, nth, next_id FROM c WHERE nth <= 3""")
def asof_next_w(spark: SparkSession, d: str) -> DataFrame:
    """The first three views at or after each purchase."""
    e = table(spark, d, "events")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("next_id"))
    return next_rows(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "event_id", ["next_id"], 3).select("event_id", "nth", "next_id")


@query("WITH a AS (SELECT *, max(CASE WHEN length(text) % 10 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM conversations) SELECT conv_id, turn, role FROM a WHERE near = 1")
def anchor_window(spark: SparkSession, d: str) -> DataFrame:
    """Two turns before and one after each anchor."""
    return around(table(spark, d, "conversations"), "conv_id", "turn", F.length("text") % 10 == 3, 2, 1).select("conv_id", "turn", "role")


@query("""WITH w AS (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER p AS u, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER p AS a FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, sha256(concat_ws(chr(10), text, '[prev user] ' || u, '[prev assistant] ' || a[1:300])) AS mark FROM w""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """A turn with the texts that came before."""
    return turn_context(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.sha2("context", 256).alias("mark"))


@query("SELECT project, round(1 - 0.3 * pow(0.9, least(n, 20)), 9) AS confidence FROM (SELECT source AS project, count(*) AS n FROM documents GROUP BY 1)")
def saturating_confidence(spark: SparkSession, d: str) -> DataFrame:
    """O23."""
    n = records(spark, d).groupBy("project").agg(F.count("*").alias("n"))
    return n.select("project", F.round(saturated_confidence(F.least("n", F.lit(20))), 9).alias("confidence"))


LIVE = """x AS (SELECT event_type AS signal, CASE WHEN event_type <> 'signup' AND NOT (event_type = 'error' AND ts > TIMESTAMP '2024-01-20') THEN ts END AS ts FROM events),
    s AS (SELECT signal, max(ts) AS last, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR) AS n FROM x GROUP BY 1), k(signal, silence) AS (VALUES ('click', 24), ('view', 1000), ('purchase', NULL), ('signup', 5), ('error', 72), ('absent', 24))"""


@query(f"""WITH {LIVE} SELECT k.signal, coalesce(n, 0)::BIGINT AS n, CASE WHEN s.signal IS NULL THEN 'NEVER' WHEN silence IS NULL THEN 'RARE' WHEN last IS NULL THEN 'UNKNOWN' WHEN epoch(TIMESTAMP '2024-01-31') - epoch(last) <= silence * 3600 THEN 'OK'
    WHEN (SELECT n FROM s WHERE signal = 'click') > 0 THEN 'STALE' ELSE 'IDLE' END AS status FROM k LEFT JOIN s ON s.signal = k.signal""")
def liveness_status(spark: SparkSession, d: str) -> DataFrame:
    """What the silence of each expected signal means."""
    signals = spark.createDataFrame([("click", 24), ("view", 1000), ("purchase", None), ("signup", 5), ("error", 72), ("absent", 24)], "signal string, max_silence_h int")
    kind = F.col("event_type")
    ts = F.when((kind != "signup") & ~((kind == "error") & (F.col("ts") > F.lit("2024-01-20").cast("timestamp"))), F.col("ts"))
    e = table(spark, d, "events").select(kind.alias("signal"), ts.alias("ts"))
    return outcomes.liveness(e, signals, F.lit("2024-01-31").cast("timestamp"), 48, "click").select("signal", "n", "status")


@query("""WITH e AS (SELECT *, (event_id % 3)::VARCHAR AS node FROM events), l AS (SELECT user_id AS id, event_type AS v FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    g AS (SELECT user_id AS id, min(event_id) AS deleted_at FROM e WHERE event_type = 'error' GROUP BY 1), c AS (SELECT user_id AS id, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY 1)
    SELECT node, l.id, v, deleted_at, round(1 - 0.3 * pow(0.9, n), 9) AS confidence FROM l LEFT JOIN g USING (id) LEFT JOIN c USING (id), (VALUES ('0'), ('1'), ('2')) AS k(node)""")
def exchanged_state(spark: SparkSession, d: str) -> DataFrame:
    """Events written by three nodes; after exchanges in a ring all have one state."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("id"), F.col("event_type").alias("v"), F.col("event_id").alias("lamport"), (F.col("event_id") % 3).cast("string").alias("node"))
    replicas = []
    for n in "012":
        own = e.filter(F.col("node") == n)
        none = Replica(n, own.select("id", "v", "lamport", "node").limit(0), own.select("id", F.col("lamport").alias("deleted_at"), "lamport", "node").limit(0), own.select(F.col("event_id").alias("log_uuid"), "id", F.lit("+").alias("direction"), F.lit(None).cast("string").alias("reason"), "lamport", "node").limit(0), own.select("node", "lamport").limit(0))
        gone = own.filter("v = 'error'").select("id", F.col("lamport").alias("deleted_at"), "lamport", "node")
        votes = own.filter("v = 'purchase'").select(F.col("event_id").alias("log_uuid"), "id", F.lit("+").alias("direction"), F.lit(None).cast("string").alias("reason"), "lamport", "node")
        replicas.append(none.apply(Changeset(own.select("id", "v", "lamport", "node"), gone, votes, own.groupBy("node").agg(F.max("lamport").alias("lamport")))))
    for a, b in ((0, 1), (1, 2), (2, 0), (0, 1)):
        replicas[a], replicas[b] = exchange(replicas[a], replicas[b])
    out = None
    for r in replicas:
        part = r.state().select(F.lit(r.name).alias("node"), "id", "v", "deleted_at", F.round("confidence", 9).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out
