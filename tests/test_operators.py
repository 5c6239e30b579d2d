"""Operators with hand-made inputs."""

from __future__ import annotations

import itertools
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.functions import predicates as P
from memlake.functions import scalars as S
from memlake.operators import curation, graph, merge, outcomes, retrieval, sessions
from memlake.params import Params


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_predicates(spark):
    assert one(spark, P.direction_mismatch(F.col("a"), F.col("b")), a="Use tabs", b="avoid tabs")
    assert one(spark, P.direction_mismatch(F.col("a"), F.col("b")), a="it does not work", b="it works")
    assert not one(spark, P.direction_mismatch(F.col("a"), F.col("b")), a="no longer used here", b="used here")
    assert not one(spark, P.direction_mismatch(F.col("a"), F.col("b")), a="never do it", b="Never do that")
    assert one(spark, P.question_form(F.col("a")), a="do\u00edas a b") and not one(spark, P.question_form(F.col("a")), a="dois a b") and not one(spark, P.question_form(F.col("a")), a="how a\x0bb")
    assert one(spark, P.question_form(F.col("a")), a="how do I x") and not one(spark, P.question_form(F.col("a")), a="what sets")
    assert not one(spark, P.has_content(F.col("a")), a="short") and not one(spark, P.has_content(F.col("a")), a="There is no prior context to use")
    assert one(spark, P.has_content(F.col("a")), a="long enough text")
    assert one(spark, P.plan_like(F.col("a"), F.col("k")), a="(plan): go", k="fact") and not one(spark, P.plan_like(F.col("a"), F.col("k")), a="plan", k="person")
    assert one(spark, P.superseder(F.col("a")), a="superseded by #42") == 42 and one(spark, P.superseder(F.col("a")), a="old") is None
    assert one(spark, P.correcting(F.col("a")), a="  Actually, no") and not one(spark, P.correcting(F.col("a")), a="fine")
    active = spark.createDataFrame([(None, ""), (None, "x"), ("d", None), (None, None)], "d string, r string").select(P.is_active(F.col("d"), F.col("r")).alias("x"))
    assert [r.x for r in active.collect()] == [True, False, False, True]


def test_scalars(spark):
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[3.0, 4.0], b=[4.0, 3.0]) == pytest.approx(0.96)
    assert one(spark, S.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[4.0, 3.0]) == 0.0
    assert one(spark, S.composite(F.lit(0.8), F.lit(0.9), F.lit(0.5), F.lit(1.0), F.lit(0.3))) == pytest.approx(0.5 * 0.8 + 0.15 * 0.5 + 0.05 * 0.3)
    assert set(one(spark, S.terms(F.col("a")), a="The cache_key for Redis")) == {"cache_key", "redis", "cache_key redis"}
    assert one(spark, S.saturated_confidence(F.lit(2))) == pytest.approx(0.757)
    assert one(spark, S.keyword_overlap(F.array(F.lit("caching")), F.array(F.lit("cache"), F.lit("caching layer")))) == 0.5
    assert [one(spark, S.import_target(F.col("a")), a=x) for x in ("msgs.srv.Foo", "@org/tel", "foo/bar.py", "numpy", "./here/x")] == ["msgs", "@org/tel", "foo", "numpy", "./here/x"]
    assert one(spark, S.polarity(F.col("a"), F.array(F.lit("redis"))), a="We use it. Redis is obsolete.") and not one(spark, S.polarity(F.col("a"), F.array(F.lit("redis"))), a="Redis is good. That is obsolete.")


def test_bm25_equals_sqlite(spark):
    texts = ["redis cache layer", "cache cache cache", "a token store", "tokens are here", "the layer of the cache is redis", "nothing", "store of stores and redis"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t)")
    db.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(texts, 1)))
    queries = {1: ["redis", "cache"], 2: ["token"], 3: ["store", "layer", "nothing"]}
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    asked = spark.createDataFrame([(k, " ".join(v)) for k, v in queries.items()], "query_id long, query string")
    got = retrieval.bm25_top_k(docs, asked, 10).collect()
    for k, terms in queries.items():
        want = {i: -s for i, s in db.execute("select rowid, rank from f where f match ?", (" OR ".join(terms),))}
        assert {r.id: pytest.approx(r.score, abs=1e-9) for r in got if r.query_id == k} == want


def test_vector_top_k_and_join(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [1.0])], "id long, embedding array<double>").repartition(5)
    asked = rows.filter("id < 3").withColumnRenamed("id", "query_id")
    got = retrieval.vector_top_k(rows, asked, 4, query_block=2).orderBy("query_id", "rank").collect()
    for q in range(3):
        assert [r.id for r in got if r.query_id == q] == np.argsort(-(v @ v[q]))[:4].tolist()
    pairs = retrieval.similarity_join(rows.filter("id < 60"), 0.4, tile=16).collect()
    assert {(r.a, r.b) for r in pairs} == {(i, j) for i in range(60) for j in range(i + 1, 60) if v[i] @ v[j] >= 0.4} and len(pairs) == len({(r.a, r.b) for r in pairs})


def test_variants_take_the_best_z(spark):
    rows = [(1, 0, 1, 0.9), (1, 0, 2, 0.8), (1, 0, 3, 0.7), (1, 1, 1, 0.1), (1, 1, 2, 0.1), (1, 1, 3, 0.4)]
    got = {r.id: r.similarity for r in retrieval.variant_similarity(spark.createDataFrame(rows, "query_id long, variant int, id long, similarity double")).collect()}
    assert got == {1: 0.9, 2: 0.8, 3: 0.4}


def test_fusion_and_gates(spark):
    sem = spark.createDataFrame([(1, 10, 0, 0.8), (1, 11, 1, 0.7)], "query_id long, id long, rank long, similarity double")
    lex = spark.createDataFrame([(1, 10, 0), (1, 12, 1)], "query_id long, id long, rank long")
    got = {r.id: (round(r.boost, 6), r.source, r.similarity) for r in retrieval.fuse(sem, lex).collect()}
    unit = 0.2 / (2 / 61)
    assert got == {10: (round(2 / 60 * unit, 6), "both", 0.8), 11: (round(unit / 61, 6), "semantic", 0.7), 12: (round(unit / 61, 6), "fts", 0.35)}
    rows = spark.createDataFrame([(1, 1, 0.5, 0.6), (1, 2, 0.4, 0.9), (1, 3, 0.3, 0.41), (2, 4, 0.9, 0.44)], "query_id long, id long, score double, similarity double")
    assert {r.id for r in retrieval.gates(rows).collect()} == {1, 2}
    near = spark.createDataFrame([(1, 1, 0.50), (1, 2, 0.48), (1, 3, 0.1), (2, 4, 0.9), (2, 5, 0.1)], "query_id long, id long, score double")
    assert {r.id for r in retrieval.limited(near, 1).collect()} == {1, 2, 4}


def test_diversity(spark):
    rows = [(1, 0, 1, "a", "t", ["x", "y"]), (1, 1, 2, "a", "t", ["q"]), (1, 2, 3, "b", "t", ["x", "y"]), (1, 3, 4, "b", "u", ["z"])]
    df = spark.createDataFrame(rows, "query_id long, rank long, id long, kind string, topic string, words array<string>")
    assert [r.id for r in retrieval.diverse(df, "kind", "topic", "words", 5).orderBy("rank").collect()] == [1, 4]


def test_outcomes_keep_undecided_apart(spark):
    rows = [("a", 1, 0.5, 3, "m"), ("a", 0, -1.0, None, "m"), ("a", None, 0.7, 1, "m"), ("b", None, -1.0, None, "p"), ("b", 1, 0.2, None, "p")]
    df = spark.createDataFrame(rows, "layer string, engaged int, engaged_score double, grade int, method string")
    got = {r.layer: r for r in outcomes.outcomes(df, "layer").collect()}
    assert (got["a"].n, got["a"].decided, got["a"].engaged_pct, got["a"].coverage_pct, got["a"].avg_score, got["a"].graded, got["a"].avg_grade) == (3, 2, 50.0, 66.7, 0.6, 2, 2.0)
    strata = outcomes.qualifying_strata(df)
    assert [r.method for r in strata.collect()] == ["m"]
    assert [r.engaged for r in outcomes.neutralise(df, strata).filter("layer = 'b'").collect()] == [None, None]
    empty = outcomes.outcomes(df.filter("engaged IS NULL AND layer = 'b'"), "layer").first()
    assert empty.decided == 0 and empty.engaged_pct is None


def test_engagement(spark):
    df = spark.createDataFrame([("redis", 1), ("cache", 1), ("common", 99)], "term string, df long")
    rows = spark.createDataFrame([(1, "redis cache common", "what now", "we use redis and cache"), (2, "redis cache", "redis cache", "redis cache"), (3, "redis cache", "hm", "redis")], "id long, memory string, prompt string, response string")
    got = {r.id: (r.engaged, r.engaged_score) for r in outcomes.engagement(rows, df, 100).collect()}
    assert got[1][0] == 1 and got[2] == (None, -1.0) and got[3][0] == 0 and 0 < got[3][1] < got[1][1]


def test_decisions(spark):
    cols = "n_a long, n_b long, engaged_pct_a double, engaged_pct_b double, graded_a long, graded_b long, grade_a double, grade_b double"
    rows = [(29, 50, 10.0, 90.0, 0, 0, 0.0, 0.0), (30, 30, 10.0, 25.0, 0, 0, 0.0, 0.0), (30, 30, 30.0, 15.0, 0, 0, 0.0, 0.0), (50, 50, 30.0, 31.0, 40, 40, 1.0, 1.05), (50, 50, 30.0, 31.0, 40, 40, 1.0, 0.75), (50, 50, 30.0, 31.0, 39, 40, 1.0, 2.0), (50, 50, None, 31.0, 40, 40, 1.0, 2.0)]
    got = [r.decision for r in outcomes.ab_decision(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["running", "promote", "rollback", "promote", "rollback", "inconclusive", "running"]
    p = outcomes.fisher_exact(spark.createDataFrame([(3, 1, 1, 3), (8, 2, 1, 5)], "a long, b long, c long, d long")).collect()
    assert [round(r.p, 6) for r in p] == [0.485714, 0.034965]


def test_star_clusters_are_not_transitive(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (11, 12)]
    got = {(r.seed, r.id) for r in curation.star_clusters(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(1, 1), (1, 2), (3, 3), (3, 4), (10, 10), (10, 11), (10, 12)}


def test_batches_and_upserts(spark):
    rows = [("g", i, s) for i, s in enumerate([2000, 2000, 2000, 100, 5900, 10])]
    got = curation.batches_by_size(spark.createDataFrame(rows, "g string, i long, s long"), "g", "i", "s").orderBy("i").collect()
    assert [r.batch for r in got] == [0, 0, 1, 1, 2, 3]
    cases = spark.createDataFrame([(0.7, True, False), (0.9, True, False), (0.96, False, False), (0.7, False, True), (0.7, False, False)], "s double, k boolean, n boolean")
    assert [r.x for r in cases.select(curation.upsert_decision(F.col("s"), F.col("k"), F.col("n")).alias("x")).collect()] == ["variant", "supersede", "duplicate", "annotate", "insert"]


def test_merging_does_not_depend_on_order(spark):
    rows = [(1, 3, "a", "x"), (1, 3, "b", "y"), (1, 2, "z", "old"), (2, 1, "a", "q"), (1, 3, "b", "y")]
    cols = "id long, lamport long, node string, content string"
    want = {1: "y", 2: "q"}
    for order in itertools.islice(itertools.permutations(rows), 0, 120, 37):
        first, rest = spark.createDataFrame(list(order[:2]), cols), spark.createDataFrame(list(order[2:]), cols)
        got = merge.apply_changes(merge.last_writer_wins(first, "id"), rest, "id")
        assert {r.id: r.content for r in got.collect()} == want
        assert {r.id: r.content for r in merge.apply_changes(got, rest, "id").collect()} == want
    log = spark.createDataFrame([(1, "+", None, 1, "a"), (1, "-!", "r1", 2, "b"), (1, "-!", "r2", 3, "c"), (1, "+", None, 4, "d"), (2, "-", "r", 1, "e")], "id long, direction string, reason string, lamport long, log_uuid string")
    got = {r.id: (r.confidence, r.annotation) for r in merge.convergent_confidence(log).collect()}
    assert got == {1: (0.757, "r2"), 2: (0.7, None)}


def test_fingerprints_tell_joints_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "c"), ("", "c")], "a string, b string")
    assert rows.select(merge.fingerprint(F.col("a"), F.col("b")).alias("x")).distinct().count() == 4
    now, old = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k long, fingerprint string"), spark.createDataFrame([(1, "x"), (2, "n"), (3, "g")], "k long, fingerprint string")
    assert {r.k: r.state for r in merge.changed_units(now, old, ["k"]).collect()} == {1: "same", 2: "changed", 3: "gone", 4: "new"}


def test_as_of_joins(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 9), (3, "v", 1), (4, "u", 1)], "id long, k string, t long")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 7, 70), ("u", 9, 90), ("w", 1, 0)], "k string, t long, x long")
    assert {r.id: r.x for r in sessions.as_of_backward(left, right, "k", "t", ["x"]).collect()} == {1: 50, 2: 90, 3: None, 4: None}
    got = sorted((r.id, r.nth, r.x) for r in sessions.next_rows(left, right, "k", "t", "id", ["x"], 2).collect())
    assert got == [(1, 1, 50), (1, 2, 70), (2, 1, 90), (4, 1, 20), (4, 2, 50)]


def test_graph(spark):
    s = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("d", "b")], "session_id string, parent_session_id string")
    start = spark.createDataFrame([("c",)], "session_id string")
    assert [(r.session_id, r.depth) for r in graph.chain(s, start).orderBy("depth").collect()] == [("c", 0), ("b", 1), ("a", 2)]
    down = graph.chain(s, spark.createDataFrame([("a",)], "session_id string"), up=False)
    assert {(r.session_id, r.depth) for r in down.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 2)}
    calls = spark.createDataFrame([("x", "pkg.mod.run"), ("y", "run"), ("z", "other.run"), ("w", "walk")], "source string, target string")
    names = spark.createDataFrame([("pkg.mod.run",)], "name string")
    assert {r.source for r in graph.call_targets(calls, names).collect()} == {"x", "y", "z"}
    asked = spark.createDataFrame([("run",), ("pkg.mod.run",)], "symbol string")
    assert {(r.symbol, r.name) for r in graph.resolve(names, asked).collect()} == {("run", "pkg.mod.run"), ("pkg.mod.run", "pkg.mod.run")}


def test_a_chain_has_no_limit_of_rows(spark):
    """Chains of more rows than the engine's recursive queries may give."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        s = spark.range(1, 41).select(F.col("id").alias("session_id"), F.expr("CASE WHEN id > 1 THEN id - 1 END").alias("parent_session_id"))
        got = graph.chain(s, s.filter("session_id IN (10, 40)"), most=35)
        assert got.count() == 10 + 36 and got.filter("start = 40").agg(F.min("session_id")).first()[0] == 5
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_parameters_can_be_replaced():
    assert Params(dedup=0.5).dedup == 0.5 and Params().dedup == 0.95
