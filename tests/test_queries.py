"""Registered queries against their SQL, text sources and streams."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from memlake.plans import analytics, feeds, graphs, listings, messages, reports, rules, search, upkeep
from memlake.sources import text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MODULES = (reports, analytics, search, feeds, rules, messages, upkeep, graphs, listings)


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64").round(6)
        else:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES])
def test_query(spark, data, oracle, name):
    got = {n: f for m in MODULES for n, f in m.QUERIES.items()}[name](spark, data).toPandas()
    sql = {n: s for m in MODULES for n, s in m.ORACLE.items()}.get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = oracle.sql(sql).df()
    if name == "superseded_in_set":
        assert len(want)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)


def test_engagement_over_many_turns(spark, tmp_path):
    """A term in 400 of 4,000 turns is distinctive; a turn that repeats nothing of the one before scores 0."""
    rows = [(c, i, "granite lantern velvet" if c < 400 and i == 0 else f"filler{c}x{i} other{c}y{i}") for c in range(1000) for i in range(4)]
    rows = [(c, i, "granite lantern velvet") if (c, i) == (0, 2) else (c, i, t) for c, i, t in rows]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.id: (r.engaged, r.engaged_score) for r in search.engagement_score(spark, str(tmp_path)).collect()}
    assert len(got) == 2000 and got[1] == (1, 1.0) and got[1001] == (0, 0.0)


def test_entry(spark):
    assert entry_points.entry(spark).count() >= 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"type":"user","message":{"role":"user","content":"hi"},"timestamp":"t1"}\nnot json\n{"role":"assistant","content":"[{\\"type\\":\\"text\\",\\"text\\":\\"yes\\"},{\\"type\\":\\"tool_use\\"}]"}\n{"type":"human","message":{"role":"human","content":"more"}}\n')
    rows = text.read_transcripts(spark, f"file://{tmp_path}/a.jsonl").orderBy("idx").collect()
    assert [(r.idx, r.role, r.text) for r in rows] == [(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "more")]


def test_chunks_sections_notes(spark, tmp_path):
    one = lambda c, v: spark.createDataFrame([(v,)], "a string").select(c.alias("x")).first().x
    assert one(text.chunks(F.col("a"), 10), "aaaa\n\nbbbb\n\n\ncccccccccccc\n\nd") == ["aaaa\n\nbbbb", "cccccccccccc", "d"]
    files = spark.createDataFrame([("app.py", "@app.get('/x')\nos.getenv('HOME_DIR')\n# TODO fix it"), ("m.proto", "message Foo {}"), ("q.sql", "CREATE TABLE IF NOT EXISTS t1 (a int)")], "path string, content string")
    got = {(r.section, r.unit) for r in text.sections(files).collect()}
    assert {("routes", "/x"), ("env", "HOME_DIR"), ("todo", "TODO fix it"), ("messages", "Foo"), ("tables", "t1")} <= got
    notes = text.notes(spark.createDataFrame([(1, "x <memory_note>fact/cache: it is\nlazy</memory_note> y")], "id long, text string")).first()
    assert (notes.type, notes.topic, notes.content) == ("fact", "cache", "it is\nlazy")
    marks = text.grades(spark.createDataFrame([("42:3!, 7:0",)], "grades string")).collect()
    assert [(r.id, r.grade, r.strong) for r in marks] == [(42, 3, True), (7, 0, False)]
    out = text.write_labels(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "split string, x long"), f"file://{tmp_path}/labels")
    assert {r.split: r.rows for r in out.collect()} == {"a": 2, "b": 1}
    wire = text.changeset_json(spark.createDataFrame([(1, "x")], "id long, v string"), "records")
    assert text.read_changeset(wire, "records", "id long, v string").first().v == "x"
