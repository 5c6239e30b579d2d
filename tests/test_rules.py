"""Rules with hand-computed results: gates, scopes, clusters, liveness, streams that go on, positions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from memlake.operators import curation, gates, graph, outcomes, positions, records, retrieval
from memlake.params import Params
from memlake.plans import upkeep
from memlake.sources import capture, repository
from memlake.streaming import jobs


def test_positions_and_every_nth(spark):
    rng = random.Random(1)
    values = [rng.randrange(1000) for _ in range(500)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, id long").repartition(7)
    got = {r.id: r.position for r in positions.numbered(rows, [F.desc("v"), F.col("id")]).collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(500), key=lambda i: (-values[i], i)))}
    first = [r.id for r in positions.every_nth(rows, [F.col("id")], 120).orderBy("id").collect()]
    assert first == list(range(0, 500, 5)) and positions.every_nth(rows, [F.col("id")], 500).count() == 500
    assert positions.every_nth(rows.limit(0), [F.col("id")], 5).count() == 0
    plan = positions.numbered(rows, [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]


SIM = "query_id long, id long, similarity double, score double, kind string, topic string, words array<string>, archived boolean, ce_score double"


def similar(spark, rows, **how):
    rows = [(1, i, sim, score, "k", str(i) if topic is None else topic, [str(i)], old, ce) for i, sim, score, topic, old, ce in rows]
    return [(r.id, r.archived, round(r.score, 6), r.gate_status) for r in gates.find_similar(spark.createDataFrame(rows, SIM), **how).orderBy("place").collect()]


def test_chain_of_gates(spark):
    assert similar(spark, [(1, 0.44, 0.9, None, False, 1.0), (2, 0.9, 0.1, None, False, 1.0)]) == []  # G1: the first by score is garbage
    weak = Params(garbage_gate=0.2)
    assert similar(spark, [(1, 0.3, 0.4, None, False, 1.0)], p=weak) == [] and len(similar(spark, [(1, 0.3, 0.5, None, False, 1.0)], p=weak)) == 1  # G2
    rows = [(1, 0.8, 0.50, None, False, None), (2, 0.57, 0.48, None, False, None), (3, 0.55, 0.47, None, False, None)]
    assert [x[0] for x in similar(spark, rows, rerank=False)] == [1, 2]  # G3: 0.55 < 0.7 * 0.8
    assert [x[0] for x in similar(spark, rows, limit=1, rerank=False)] == [1, 2]  # G4: the first two are close
    apart = [(1, 0.8, 0.60, None, False, None), (2, 0.7, 0.48, None, False, None)]
    assert [x[0] for x in similar(spark, apart, limit=1, rerank=False)] == [1]
    same = [(1, 0.8, 0.5, "t", False, None), (2, 0.8, 0.4, "t", False, None), (3, 0.8, 0.3, "u", False, None)]
    assert [x[0] for x in similar(spark, same, rerank=False)] == [1, 3]  # G5
    old = [(1, 0.6, 0.5, None, False, None), (7, 0.5, 0.9, None, True, None), (8, 0.7, 0.1, None, True, None), (9, 0.44, 0.1, None, True, None)]
    assert [(x[0], x[1]) for x in similar(spark, old, rerank=False)] == [(1, False), (8, True), (7, True)]  # G6, G9
    assert similar(spark, [x for x in old if x[4]], rerank=False) == []  # none without an active one


def test_question_forms_count_before_the_row(spark, tmp_path):
    """A row's own similarity of 1 doesn't replace that of its question forms, 0.9."""
    spark.createDataFrame([(i, [1.0, 0.0], 1) for i in (0, 4, 5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: r.score for r in upkeep.calibration_retrieval(spark, str(tmp_path)).collect()}
    assert got == {4: round(0.55 * 0.9 + 0.2 * 0.8 + 0.105, 6), 5: round(0.55 + 0.2 * 0.5 + 0.105, 6)}


def test_topics_tie_at_nine_digits_from_0_to_1(spark, tmp_path):
    """Similarities that differ by 1.6e-9 are one from 0 to 1, so the lower id comes first; 0.6 itself is enough."""
    far = [0.5 + 8e-10, 0.5 - 8e-10, 0.2, 0.19]
    rows = [(0, [1.0, 0.0], 1), *[(2 * i, [x, (1 - x * x) ** 0.5], 1) for i, x in zip((2, 1, 3, 4), far, strict=True)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = upkeep.topic_candidates(spark, str(tmp_path)).orderBy("rank").collect()
    assert [round((1 + x) / 2, 9) for x in far[:2]] == [0.75, 0.75] and [r.id for r in got] == [2, 4, 6]


def test_reranking_and_its_status(spark):
    rows = [(1, 0.8, 0.5, None, False, -5.0), (2, 0.8, 0.4, None, False, 2.0), (3, 0.8, 0.3, None, False, 0.0)]
    # 1 is below the floor; 2 and 3 are scaled to 1 and 0
    assert similar(spark, rows) == [(2, False, round(0.4 * 0.4 + 0.6, 6), "reranked"), (3, False, round(0.4 * 0.3, 6), "reranked")]
    low = [(i, s, c, t, a, -9.0) for i, s, c, t, a, _ in rows]
    assert similar(spark, low) == [(1, False, round(0.4 * 0.5, 6), "reranked")]  # one stays at least; no range
    none = [(i, s, c, t, a, None if i == 3 else 1.0) for i, s, c, t, a, _ in rows]
    assert {x[3] for x in similar(spark, none)} == {"gate-unavailable"} and [x[0] for x in similar(spark, none)] == [1, 2, 3]
    assert {x[3] for x in similar(spark, rows, rerank=False)} == {"ungated-by-design"} and {x[3] for x in similar(spark, rows, enabled=False)} == {"disabled"}
    many = [(i, 0.8, 0.5 - i / 1000, None, False, float(i)) for i in range(14)]
    assert [x[0] for x in similar(spark, many, limit=20)] == list(range(11, -1, -1))  # the 12 best by score are reranked


def test_scopes(spark):
    cols = "query_id long, id long, similarity double, score double, source string, in_project boolean, kind string"
    rows = [
        (1, 1, 0.31, 0.5, "semantic", True, "fact"), (1, 2, 0.29, 0.6, "semantic", True, "fact"), (1, 3, 0.35, 0.41, "fts", True, "fact"), (1, 4, 0.2, 0.41, "fts", True, "fact"), (1, 5, 0.2, 0.39, "fts", True, "fact"),
        (1, 6, 0.2, 0.9, "fts", False, "fact"), (1, 7, 0.55, 0.9, "both", False, "reference"), (1, 8, 0.56, 0.9, "both", False, "reference"), (2, 9, 0.62, 0.9, "semantic", False, "fact"), (2, 10, 0.59, 0.9, "semantic", False, "fact"),
    ]
    df = spark.createDataFrame(rows, cols)
    got = lambda tau, **how: {(r.id, r.scope) for r in gates.scopes(df, F.lit(tau), **how).collect()}
    assert got(0.30) == {(1, "project"), (3, "project"), (4, "global"), (8, "global"), (9, "global"), (10, "global")}
    # a boosted threshold: no row of the project passes, 3 comes by words alone, and only the floor lets 9 pass
    assert got(0.65) == {(3, "global"), (4, "global"), (9, "global")}
    assert got(0.30, served=spark.createDataFrame([(1, 1), (1, 4)], "query_id long, id long")) == {(3, "project"), (8, "global"), (9, "global"), (10, "global")}
    assert {r.id for r in gates.scopes(df, F.lit(0.30), limit=1).collect()} == {1, 8, 9}
    boost = lambda *x: spark.createDataFrame([(y,) for y in x], "outcome string").agg(gates.adaptive_boost().alias("b")).first().b
    assert [boost(*["harmful"] * 4), boost(*["harmful"] * 3, *["good"] * 2), boost("harmful", "neutral", *["good"] * 3), boost("neutral", *["good"] * 4)] == [0.0, 0.10, 0.05, 0.0]


def test_exclusions_come_before_ranks(spark):
    found = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.6)], "query_id long, id long, score double")
    known = spark.createDataFrame([(1, "s", "p"), (2, "t", "p"), (3, None, None)], "id long, session string, project string")
    q = lambda elsewhere: spark.createDataFrame([(1, "s", "p", elsewhere)], "query_id long, session string, project string, elsewhere boolean")
    left = lambda e: sorted(r.id for r in gates.allowed(found, q(e), known).collect())
    assert left(False) == [2, 3, 4] and left(True) == [3, 4]


def test_liveness(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    events = [("beat", "2024-01-31 20:00:00"), ("slow", "2024-01-29 00:00:00"), ("rare", "2023-01-01 00:00:00"), ("broken", None), ("fresh", "2024-01-31 12:00:00")]
    signals = spark.createDataFrame([("beat", 24), ("slow", 48), ("rare", None), ("broken", 24), ("fresh", 24), ("new", 24)], "signal string, max_silence_h int")
    status = lambda rows: {r.signal: r.status for r in outcomes.liveness(spark.createDataFrame(rows, "signal string, ts string").withColumn("ts", F.col("ts").cast("timestamp")), signals, now, 24, "beat").collect()}
    assert status(events) == {"beat": "OK", "slow": "STALE", "rare": "RARE", "broken": "UNKNOWN", "fresh": "OK", "new": "NEVER"}
    quiet = status([("beat", "2024-01-20 00:00:00"), *events[1:]])
    assert quiet["slow"] == quiet["beat"] == "IDLE"


def test_chain_ends_where_it_came_from(spark):
    s = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1)], "session_id long, parent_session_id long")
    got = {(r.start, r.session_id, r.depth) for r in graph.chain(s, s).collect()}
    assert got == {(1, 1, 0), (1, 2, 1), (2, 2, 0), (2, 1, 1), (3, 3, 0), (4, 4, 0), (4, 1, 1), (4, 2, 2)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_chain")]


def greedy(edges, most):
    near, taken, out = {}, set(), set()
    for a, b in sorted(edges):
        near.setdefault(a, []).append(b)
    for s in sorted({x for e in edges for x in e}):
        if s not in taken:
            got = [s, *[x for x in near.get(s, ()) if x not in taken][: most - 1]]
            taken.update(got)
            out |= {(s, x) for x in got} if len(got) > 1 else set()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_stars_in_rounds_equal_the_walk(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}
    df = spark.createDataFrame(sorted(edges), "a long, b long")
    for small in (0, 10, 1000):
        assert {(r.seed, r.id) for r in curation.star_clusters(df, most=4, small=small).collect()} == greedy(edges, 4)


def test_star_clusters_settle_in_few_rounds(spark):
    """Rounds decide single pairs; a seed need not wait for what others may take."""
    edges = sorted({(i, j) for i in range(12) for j in range(i + 1, min(i + 4, 12))})
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.seed, r.id) for r in curation.star_clusters(df, most=4, small=0, rounds=4).collect()} == greedy(set(edges), 4)
    hubs = spark.createDataFrame([(0, 9), (1, 9), *[(0, i) for i in range(2, 5)], *[(1, i) for i in range(5, 8)]], "a long, b long")
    assert {(r.seed, r.id) for r in curation.star_clusters(hubs, most=4, small=0, rounds=2).collect()} == {(0, i) for i in (0, 2, 3, 4)} | {(1, i) for i in (1, 5, 6, 7)}


def test_joins_in_groups_and_of_sets(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(12)], "id long, g long, embedding array<double>")
    got = {(r.a, r.b) for r in retrieval.similarity_join(rows, 0.5, by=("g",), tile=2).collect()}
    assert got == {(i, j) for i in range(12) for j in range(i + 1, 12) if i % 2 == j % 2 and (i < 6) == (j < 6)}
    rng = random.Random(5)
    sets = {i: {str(rng.randrange(12)) for _ in range(6)} for i in range(40)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, words array<string>")
    for least in (0.2, 0.5, 0.85):
        want = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > least}
        assert {(r.a, r.b) for r in retrieval.similar_sets(df, least).collect()} == want


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(folder)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    schema, source, out = "k long, lamport long, node string, v string", f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda n, rows: spark.createDataFrame(rows, schema).write.parquet(f"{source}/part={n}")
    run = lambda: {r.k: r.v for r in jobs.upsert_stream(stream_of(spark, f"{source}/*", schema), "k", "lamport", "node", out).collect()}
    put(1, [(i, 1, "a", f"old{i}") for i in range(40)])
    assert run() == {i: f"old{i}" for i in range(40)}
    put(2, [(3, 2, "a", "new3"), (5, 0, "z", "stale"), (99, 1, "a", "added")])
    want = {**{i: f"old{i}" for i in range(40)}, 3: "new3", 99: "added"}
    assert run() == want and run() == want
    table = jobs.KeyedTable(spark, f"{out}/table", spark.createDataFrame([], schema).schema, ["k"])
    places = table.places()
    assert len({r.batch for r in places}) > 1  # parts that the second batch did not touch were left alone
    again = spark.createDataFrame([(3, 2, "a", "new3"), (5, 0, "z", "stale"), (99, 1, "a", "added")], schema)
    table.put(again, lambda old, new: jobs.last_writer_wins(old.unionByName(new), "k", "lamport", "node"), max(r.batch for r in places))
    assert {r.k: r.v for r in table.read().collect()} == want


def test_topic_gate_and_caps(spark, tmp_path):
    schema = "s string, n long, v array<double>, kind string"
    rows = [("a", 1, [1.0, 0.0], "x"), ("a", 2, [0.9, 0.1], "x"), ("a", 3, [0.6, 0.8], "x"), ("a", 4, [0.55, 0.85], "y"), ("a", 5, None, "y"), ("b", 1, [0.0, 0.0], "x"), ("b", 2, [0.0, 1.0, 0.0], "x")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: stream_of(spark, f"file://{tmp_path}/in", schema)
    got = {r.s: (r.ran, r.skipped) for r in jobs.topic_gate(stream(), "s", "n", "v", f"file://{tmp_path}/gate").collect()}
    assert got == {"a": (3, 2), "b": (2, 0)}
    runs = {r.s: (r.n, r.run, r.best, r.held) for r in jobs.streaks(stream(), "s", "n", "kind", f"file://{tmp_path}/runs", cap=2).collect()}
    assert runs == {"a": (5, 2, 3, 1), "b": (2, 2, 2, 0)}


def test_queue_stops_at_the_first_failure(spark):
    queue = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 0)], "seq long, attempts long")
    fail = lambda rows: rows.filter("seq IN (2, 4)")
    seqs = lambda df: sorted((r.seq, r.attempts) for r in df.collect())
    done, waiting, dropped = jobs.drain(queue, "seq", fail, 3)
    assert (seqs(done), seqs(waiting), seqs(dropped)) == ([(1, 0)], [(2, 2), (3, 0), (4, 0)], [])
    done, waiting, dropped = jobs.drain(queue, "seq", fail, 2)
    assert (seqs(done), seqs(waiting), seqs(dropped)) == ([(1, 0)], [(3, 0), (4, 0)], [(2, 2)])
    done, waiting, dropped = jobs.drain(queue, "seq", lambda r: r.limit(0), 2)
    assert len(seqs(done)) == 4 and not seqs(waiting) and not seqs(dropped)


def test_blocks_and_definitions(spark):
    one = lambda f, text: [r.asDict() for r in f(spark.createDataFrame([(1, text)], "id long, text string")).collect()]
    assert one(capture.compact_entries, "no block at all") == []
    got = one(capture.linkdef_entries, "x\n[cm]: # '{\"e\":[{\"t\":\"fact\",\"to\":\"a\",\"c\":\"it's \\\"quoted\\\" and C:\\\\dir\"}],\"ok\":true}'")
    assert got[0]["content"] == 'it\'s "quoted" and C:\\dir' and got[0]["recovery"] is None
    got = one(capture.linkdef_entries, "[cm]: # '{\"e\":[{\"t\":\"fact\",\"to\":\"a\",\"c\":\"the bot says \"contact the merchant\"\"}],\"kw\":[\"k\"]}'")
    assert got[0]["content"] == 'the bot says "contact the merchant"' and got[0]["recovery"] == "salvage" and got[0]["keywords"] == ["k"]
    assert one(capture.linkdef_entries, "[cm]: # 'not json at all'") == []
    flags = one(capture.compact_flags, "<memory>\n- :later\n+ c h:2a\n</memory>")[0]
    assert flags["complete"] is True and flags["remaining"] == "later" and flags["hash"] == 42
    entries = one(capture.verbose_entries, "<memory>type: fact\ntopic: a\ntype: skill\ntopic: b\ncontent: c")
    assert [(e["type"], e["topic"], e["content"]) for e in entries] == [("skill", "b", "c")]  # a type without content is replaced


def test_files_and_dates(spark):
    files = spark.createDataFrame([("package.json", '{"dependencies":{"a":"1"}}'), ("bad/package.json", "{"), ("requirements.txt", "x==1.0\n# y\nz\n"), ("a/b.py", "# note: short because\nx = 1  # TODO later\n"), ("node_modules/x.js", "")], "path string, content string")
    assert {(r.path, r.name, r.version) for r in repository.dependencies(files).collect()} == {("package.json", "a", "1"), ("requirements.txt", "x", "==1.0"), ("requirements.txt", "z", None)}
    assert {(r.section, r.line) for r in repository.line_notes(files).collect()} == {("comments", 1), ("todos", 2)}
    assert {r.path for r in repository.tree(files).collect()} == {"package.json", "bad/package.json", "requirements.txt", "a/b.py"}
    env = repository.env_files(spark.createDataFrame([("a", "HOME"), ("b", "HOME"), ("a", "X")], "path string, unit string"))
    assert {r.variable: r.files for r in env.collect()} == {"HOME": ["a", "b"], "X": ["a"]}
    with pytest.raises(Exception, match="no date"):
        spark.range(1).select(records.relative_bound(F.lit("whenever"), F.current_timestamp())).collect()
