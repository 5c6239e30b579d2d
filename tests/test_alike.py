"""Queries that ask the same, against plain joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import alike, graph, listing, records


def test_tiles_give_every_query_its_answers(spark):
    answers = spark.createDataFrame([(["a", None], i) for i in range(50)] + [([], 7), (["b"], 8)], "key array<string>, id long")
    queries = spark.createDataFrame([(q, ["a", None]) for q in range(30)] + [(90, []), (91, ["c"])], "query_id long, key array<string>")
    for how in ({}, {"tile": (7, 4), "task_rows": 100}):
        got = [tuple(r) for r in alike.to_each(answers, queries, "key", **how).select("query_id", "id").collect()]
        assert sorted(got) == sorted([(q, i) for q in range(30) for i in range(50)] + [(90, 7)])
    assert alike.to_each(answers.limit(0), queries, "key").count() == 0


def test_files_of_queries_alike(spark):
    """One answer for four queries, which is ranked before it is given to them; unknown sessions and projects count as such."""
    rows = spark.createDataFrame([(1, "p", 5, 1, ["a/x.py"]), (2, None, 6, 2, ["a/x.py", "b/x.py"]), (3, "p", None, 3, ["c/x.py"])], "id long, project string, session long, updated_at long, files array<string>")
    asked = spark.createDataFrame([(q, "a/x.py", "p", 5) for q in range(4)] + [(8, "a/x.py", None, None), (9, None, "p", 1)], "query_id long, path string, project string, session long")
    got = records.file_matches(rows, asked)
    assert sorted(map(tuple, got.collect())) == sorted([(q, *x) for q in range(4) for x in ((2, 2, 0), (3, 1, 1))] + [(8, 2, 2, 0), (8, 1, 2, 1)])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_parts_of_queries_alike(spark):
    asked = spark.createDataFrame([(1, "a | b"), (2, "b|a|"), (3, "c"), (4, "a"), (4, "c"), (5, "")], "query_id long, query string")
    found = spark.createDataFrame([("a", 10, 0.1), ("b", 10, 0.3), ("b", 11, 0.2), ("c", 12, 0.9)], "query string, id long, score double")
    got = listing.best_of_queries(asked, found)
    assert sorted(map(tuple, got.collect())) == [(1, 10, 0.3), (1, 11, 0.2), (2, 10, 0.3), (2, 11, 0.2), (3, 12, 0.9), (4, 10, 0.1), (4, 12, 0.9)]
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_symbols_of_one_file(spark):
    rows = spark.createDataFrame([(1, ["f", "f"]), (2, ["g", "f"]), (3, ["h"])], "id long, files array<string>")
    symbols = spark.createDataFrame([(7, "f"), (8, "f"), (9, "g"), (9, "f"), (6, None)], "symbol long, file string")
    found = spark.createDataFrame([(s, i, r) for s in (6, 7, 9) for r, i in enumerate((3, 2))], "symbol long, id long, rank long")
    got = sorted(map(tuple, graph.knowledge(rows, found, symbols).select("symbol", "id", "source").collect()))
    assert got == [(6, 2, "text"), (6, 3, "text"), *[(s, i, x) for s in (7, 8, 9) for i, x in ((1, "file"), (2, "file"), (3, "text")) if s != 8 or x == "file"]]
