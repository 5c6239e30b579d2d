"""the derived graph's edges are told apart by numbers, before their names are made."""

from __future__ import annotations

from memlake.plans import inputs


def test_edges_are_distinct_by_numbers(spark, tmp_path):
    rows = [(p, s) for p in range(6) for s in (1, 2, 3, 7)] * 3
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = inputs.edges(spark, str(tmp_path))
    want = {(f"p{p}", f"s{s}") for p, s in rows} | {(f"s{s}", f"s{s // 3 + 1}") for _, s in rows if s % 3}
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "HashAggregate(keys=[source" not in edges._jdf.queryExecution().executedPlan().toString()
