"""Rules over records, deliveries and imports as Spark SQL; the same text, or a dialect of it, is the oracle's."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .inputs import DELIVERIES, RECORDS, deliveries, records, table

QUERIES, ORACLE = {}, {}
_VIEWS = {"records": records, "deliveries": deliveries}


def rule(name: str, doc: str, sql: str, **dialect: str) -> None:
    """Registers sql, in which {t} is a table or view; dialect maps words of it to DuckDB's."""
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: _VIEWS[t](spark, sf_dir) if t in _VIEWS else table(spark, sf_dir, t) for t in used})

    run.__name__, run.__doc__ = name, doc
    duck = sql.format(**{t: t for t in used})
    duck = re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"count(CASE WHEN \1 THEN 1 END)", duck)
    for a, b in dialect.items():
        duck = duck.replace(a, b)
    shared = [s for t, s in (("records", RECORDS), ("deliveries", DELIVERIES)) if t in used]
    if shared:
        duck = f"WITH {', '.join(shared)}, {duck[5:]}" if duck.startswith("WITH ") else f"WITH {', '.join(shared)} {duck}"
    QUERIES[name], ORACLE[name] = run, duck


LIVE = "NOT coalesce(id % 17 = 0, false)"
ACTIVE = f"{LIVE} AND coalesce(archived_reason, '') = ''"

rule("standing_context", "P7: active records of some types, the most certain per project.",
     f"SELECT project, id, type FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY confidence DESC, id) AS r FROM {{records}} WHERE {ACTIVE} AND type IN ('en', 'fr')) x WHERE r <= 10")
rule("compact_dump", "P10: by type, newest first.",
     f"SELECT type, id, project FROM {{records}} WHERE {LIVE} ORDER BY type, id DESC LIMIT 100")
rule("session_prefix", "P5: sessions whose number starts with a digit.",
     "SELECT session_id, count(*) AS n, count(DISTINCT type) AS types FROM {records} WHERE CAST(session_id AS STRING) LIKE '1%' GROUP BY session_id")
rule("not_yet_served", "P18, P19: active records that were neither delivered nor suppressed.",
     f"SELECT r.id, r.project FROM {{records}} r WHERE {ACTIVE.replace('id %', 'r.id %')} AND NOT EXISTS (SELECT 1 FROM {{deliveries}} d WHERE d.id = r.id) AND r.id % 23 <> 0")
rule("duplicate_fanout", "J7: pairs of winner and loser joined to all deliveries of both, many to many.",
     "WITH p AS (SELECT session_id, turn_index, max(id) AS winner, min(id) AS loser FROM {deliveries} GROUP BY session_id, turn_index) SELECT p.session_id, p.winner, p.loser, a.layer, count(*) AS n FROM p JOIN {deliveries} a ON a.session_id = p.session_id AND a.id >= p.winner JOIN {deliveries} b ON b.session_id = p.session_id AND b.id <= p.loser WHERE p.winner > p.loser GROUP BY p.session_id, p.winner, p.loser, a.layer")
rule("agreement_by_layer", "A28, A31: how often an engaged delivery scores above an unengaged one of its session.",
     "SELECT a.layer, count_if(a.score > b.score) AS win, count_if(a.score = b.score) AS tie, count_if(a.score < b.score) AS lose, count(*) AS n FROM {deliveries} a JOIN {deliveries} b ON a.session_id = b.session_id AND a.engaged = 1 AND b.engaged = 0 GROUP BY a.layer")
rule("usage_funnel", "A20: records, delivered ones, engaged ones, by project.",
     "SELECT r.project, count(*) AS records, count(d.id) AS delivered, count_if(d.engaged = 1) AS engaged FROM {records} r LEFT JOIN {deliveries} d ON d.id = r.id GROUP BY r.project")
rule("session_triage", "A22: sessions with few graded deliveries.",
     "SELECT session_id, count(*) AS n, count(grade) AS graded FROM {deliveries} GROUP BY session_id HAVING count(grade) * 2 <= count(*)")
rule("follow_rates", "A24, K8: rates of records delivered often enough, lowest first.",
     "SELECT memory_id, count(*) AS delivered, count_if(engaged = 1) AS followed, round(count_if(engaged = 1) / CAST(count(*) AS DOUBLE), 6) AS rate FROM {deliveries} GROUP BY memory_id HAVING count(*) >= 1")
rule("vector_coverage", "A25, A26: documents with and without a vector or a label.",
     "SELECT d.lang, count(*) AS n, count(e.vec_id) AS with_vector, count(l.doc_id) AS with_label, count_if(e.vec_id IS NULL AND l.doc_id IS NULL) AS with_neither FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.lang")
rule("savings_totals", "A33: sums and extremes.",
     "SELECT event_type, round(sum(value), 2) AS total, round(max(value), 6) AS largest, count(*) AS n, count_if(value > 90) AS large FROM {events} GROUP BY event_type")
rule("branch_stats", "A34, X9, K9: orders by priority and state, oldest open ones.",
     "SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'O') AS open_orders, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS first_open FROM {orders} GROUP BY o_orderpriority")
rule("symbol_hotspots", "A37: parts that many suppliers define.",
     "SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM {lineitem} GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1 ORDER BY suppliers DESC, n DESC, l_partkey LIMIT 30")
rule("majority_vote", "A39: the usual grade of each layer, the lower of equal ones, and its share.",
     "WITH c AS (SELECT layer, grade, count(*) AS n FROM {deliveries} WHERE grade IS NOT NULL GROUP BY layer, grade) SELECT layer, grade, n FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, grade) AS r FROM c) x WHERE r = 1")
rule("relabel_drift", "A40: how a second label differs from the first.",
     "SELECT layer, count(*) AS n, count_if(grade = quality * 3) AS same, count_if(abs(grade - quality * 3) = 1) AS near, round(avg(CAST(grade - quality * 3 AS DOUBLE)), 6) AS mean_shift, count_if(grade > quality * 3) AS up, count_if(grade < quality * 3) AS down FROM {deliveries} WHERE grade IS NOT NULL GROUP BY layer")
rule("export_accounting", "A41, O10: labels a query, lone ones and pairable ones.",
     "WITH g AS (SELECT session_id, turn_index, count(engaged) AS labelled, count_if(engaged = 1) AS yes, count_if(engaged = 0) AS no FROM {deliveries} GROUP BY session_id, turn_index) SELECT labelled, count(*) AS groups, count_if(yes > 0 AND no > 0) AS pairable FROM g GROUP BY labelled")
rule("grading_compliance", "A44, W4: whether the last turn of a session was graded.",
     "WITH t AS (SELECT *, max(turn_index) OVER (PARTITION BY session_id) AS last_turn FROM {deliveries}) SELECT session_id, last_turn, count(*) AS delivered, count(grade) AS graded FROM t WHERE turn_index = last_turn GROUP BY session_id, last_turn")
rule("grade_latest", "O5, J20: a grade lands on the latest delivery of its session and record.",
     "SELECT session_id, memory_id, id, grade FROM (SELECT *, row_number() OVER (PARTITION BY session_id, memory_id ORDER BY id DESC) AS r FROM {deliveries}) x WHERE r = 1 AND grade IS NOT NULL")
rule("valid_fit_labels", "O6, O7: labels whose record was delivered in the session, elsewhere, or nowhere.",
     "WITH l AS (SELECT id AS label_id, session_id + id % 2 AS session_id, memory_id FROM {deliveries}) SELECT l.label_id, CASE WHEN EXISTS (SELECT 1 FROM {deliveries} d WHERE d.session_id = l.session_id AND d.memory_id = l.memory_id) THEN 'here' WHEN EXISTS (SELECT 1 FROM {deliveries} d WHERE d.memory_id = l.memory_id AND d.session_id <> l.session_id) THEN 'elsewhere' ELSE 'nowhere' END AS place FROM l")
rule("label_sample", "O8, O25: the first three of each layer by a hash, the same at every run.",
     "SELECT layer, id FROM (SELECT layer, id, row_number() OVER (PARTITION BY layer ORDER BY sha2(concat('seed', CAST(id AS STRING)), 256), id) AS r FROM {deliveries}) x WHERE r <= 3", sha2="sha256", **{", 256), id)": "), id)"})
rule("pairwise_agreement", "O14: how often the better grade has the higher score.",
     "SELECT a.layer, count(*) AS pairs, count_if(a.score > b.score) AS agreed FROM {deliveries} a JOIN {deliveries} b ON a.session_id = b.session_id AND a.turn_index = b.turn_index AND a.grade >= b.grade + 2 GROUP BY a.layer")
rule("reactivate", "O20: archived records with an engaged or well graded delivery.",
     "SELECT r.id FROM {records} r WHERE coalesce(r.archived_reason, '') <> '' AND EXISTS (SELECT 1 FROM {deliveries} d WHERE d.id = r.id AND (d.engaged = 1 OR d.grade >= 2))")
rule("calibration_moves", "O21: archive, promote, decay or keep, by deliveries, rate and sessions.",
     "WITH s AS (SELECT version, count(*) AS n, count_if(engaged = 1) / CAST(count(*) AS DOUBLE) AS rate, count(DISTINCT session_id) AS sessions FROM {deliveries} GROUP BY version) SELECT version, n, CASE WHEN n >= 10 AND rate < 0.2 THEN 'archive' WHEN n >= 5 AND rate >= 0.8 AND sessions >= 3 THEN 'promote' WHEN rate >= 0.4 AND rate <= 0.6 THEN 'review' ELSE 'keep' END AS move, round(0.7 * power(0.5, n / CAST(61 AS DOUBLE)), 6) AS decayed FROM s")
rule("counter_merge", "O22, O26: counters that grow by a batch's counts.",
     "WITH old AS (SELECT version, count(*) AS n FROM {deliveries} WHERE id % 2 = 0 GROUP BY version), new AS (SELECT version, count(*) AS n FROM {deliveries} WHERE id % 2 = 1 GROUP BY version) SELECT coalesce(old.version, new.version) AS version, coalesce(old.n, 0) + coalesce(new.n, 0) AS n FROM old FULL JOIN new ON old.version = new.version")
rule("incremental_archive", "M10: records of changed sections, which a new run replaces.",
     "WITH changed AS (SELECT DISTINCT source AS project FROM {documents} WHERE doc_id % 37 = 0) SELECT r.id, CASE WHEN c.project IS NOT NULL THEN 'archive' ELSE 'keep' END AS action FROM {records} r LEFT JOIN changed c ON c.project = r.project")
rule("audit_delta", "M15: records above a session's watermark.",
     "WITH m AS (SELECT session_id, max(id) - 200 AS mark FROM {records} GROUP BY session_id) SELECT r.session_id, count(*) AS fresh, min(r.id) AS first_id FROM {records} r JOIN m ON m.session_id = r.session_id WHERE r.id > m.mark GROUP BY r.session_id")
rule("interface_consumers", "X8, A2, A4: hosts that several sites link to.",
     "WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM {pages}), l AS (SELECT p.host AS consumer, q.host AS target FROM p JOIN p q ON q.page_id = p.page_id + 1) SELECT target, count(DISTINCT consumer) AS consumers, count(*) AS uses FROM l GROUP BY target HAVING count(DISTINCT consumer) >= 2")
rule("set_difference", "Set operations: documents of a source that no other language has.",
     "SELECT source FROM {documents} WHERE lang = 'en' EXCEPT SELECT source FROM {documents} WHERE lang = 'es' AND doc_id % 3 = 0")
rule("best_of_subqueries", "R20: the best score of a record over several queries.",
     "WITH q AS (SELECT id, score FROM {deliveries} WHERE id % 2 = 0 UNION ALL SELECT id, engaged_score FROM {deliveries}) SELECT id, round(max(score), 6) AS score FROM q GROUP BY id")
rule("first_source_wins", "Union by id where the first source counts, as for keyword hits before others.",
     "WITH u AS (SELECT id, 'keyword' AS source, 0 AS p FROM {records} WHERE id % 6 = 0 UNION ALL SELECT id, 'hybrid', 1 FROM {records} WHERE id % 4 = 0) SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS r FROM u) x WHERE r = 1")
rule("version_history", "P11, M8: earlier versions of an order's row, newest first.",
     "SELECT key_id, CAST(version AS BIGINT) AS version, content FROM (SELECT o_custkey AS key_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, o_orderkey AS content, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) x WHERE version < n")
rule("retract_by_source", "P13, M14: rows that a retraction by source would archive, with what they were.",
     f"SELECT project, count(*) AS n, count(CASE WHEN {ACTIVE} THEN 1 END) AS active, count(CASE WHEN NOT ({ACTIVE}) THEN 1 END) AS gone FROM {{records}} WHERE project LIKE 'src1%' GROUP BY project")
rule("location_status", "P25: a stated place against an index of what is there.",
     "WITH stated AS (SELECT page_id, split_part(url, '/', 4) AS place, page_id % 7 AS size FROM {pages}), idx AS (SELECT split_part(url, '/', 4) AS place, max(page_id % 7) AS size FROM {pages} WHERE page_id % 3 <> 0 GROUP BY split_part(url, '/', 4)) SELECT s.page_id, CASE WHEN s.place = '' THEN 'UNKNOWN' WHEN i.place IS NULL THEN 'MISSING' WHEN i.size <> s.size THEN 'DRIFT' ELSE 'OK' END AS status FROM stated s LEFT JOIN idx i ON i.place = s.place")
rule("assessed_pairs", "C2, C3: pairs of a session that no one assessed, where both scores pass.",
     "WITH p AS (SELECT a.id AS a, b.id AS b, a.score AS sa, b.score AS sb FROM {deliveries} a JOIN {deliveries} b ON a.session_id = b.session_id AND a.id < b.id) SELECT p.a, p.b FROM p WHERE least(sa, sb) >= 0.3 AND NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = p.a AND l.toxic = 1)")
rule("semantic_rescue", "O3: undecided or unengaged rows that a second score with a margin makes engaged.",
     "SELECT id, CASE WHEN engaged = 1 THEN 'lexical' WHEN score >= 0.55 AND score - greatest(engaged_score, 0) >= 0.05 THEN 'semantic' END AS method, CASE WHEN engaged = 1 OR (score >= 0.55 AND score - greatest(engaged_score, 0) >= 0.05) THEN 1 ELSE engaged END AS engaged FROM {deliveries}")
rule("replace_edges", "M11: edges of rescanned files replaced, others kept.",
     "WITH old AS (SELECT page_id % 40 AS file, page_id AS target FROM {pages} WHERE page_id % 2 = 0), new AS (SELECT page_id % 40 AS file, page_id AS target FROM {pages} WHERE page_id % 40 < 10) SELECT file, target FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.file = old.file) UNION ALL SELECT file, target FROM new")
rule("watchdog", "T10, A43: queue depth, oldest item and failures by kind.",
     "SELECT event_type, count(*) AS depth, min(event_id) AS oldest, count_if(value < 1) AS failed, count_if(value < 1) * 5 > count(*) AS stuck FROM {events} GROUP BY event_type")
rule("best_trigger", "R14, R16: the best record for each session, and whether it reaches the threshold.",
     "SELECT session_id, id, round(score, 6) AS score, score >= 0.45 AS fires FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) AS r FROM {deliveries} WHERE kind <> 'person') x WHERE r = 1 AND score > 0.3")
rule("superseding_merge", "C4, C8: each copy group's newest row stays and names what it replaces.",
     "WITH g AS (SELECT lang, n_chars, max(doc_id) AS newest, count(*) AS n FROM {documents} GROUP BY lang, n_chars HAVING count(*) > 1) SELECT d.doc_id, CASE WHEN d.doc_id = g.newest THEN 'stays' ELSE concat('consolidated:', CAST(g.newest AS STRING)) END AS state FROM {documents} d JOIN g ON g.lang = d.lang AND g.n_chars = d.n_chars")
rule("coalesced_backfill", "C15: a missing value taken from another table, known ones left alone.",
     "SELECT r.id, coalesce(CASE WHEN r.id % 3 <> 0 THEN r.confidence END, CAST(l.quality AS DOUBLE)) AS confidence FROM {records} r LEFT JOIN {labels} l ON l.doc_id = r.id")
