"""Pairs worth a check against brute force, with assessed pairs as rows or as a condition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import curation


def _corpus(spark, n=90):
    v = np.random.default_rng(5).normal(size=(n, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    held = [(i, "kj"[i % 3 == 0], i % 2, v[i].tolist()) for i in range(n)]
    return held, spark.createDataFrame(held, "id long, kind string, topic long, embedding array<double>")


def _expected(held, least, most):
    pairs = []
    for i, a in enumerate(held):
        for b in held[i + 1 :]:
            sim = float(np.dot(a[3], b[3]))
            if sim >= least and (a[0] + b[0]) % 13:
                pairs.append((a[1:3] == b[1:3], -round(sim, 9), a[0], b[0]))
    same = sorted(p for p in pairs if p[0])[:most]
    other, room = sorted(p for p in pairs if not p[0]), most - len(same)
    step = max(1, -(-len(other) // room)) if room else 1
    return [(p[2], p[3], p[0]) for p in same + (other[::step][:room] if room else [])]


@pytest.mark.parametrize("most, joins", [(40, 1), (500, 2)])
def test_tiers(spark, monkeypatch, most, joins):
    held, rows = _corpus(spark)
    calls, join = [], curation.similarity_join
    monkeypatch.setattr(curation, "similarity_join", lambda *a, **k: [calls.append(k), join(*a, **k, tile=16)][1])
    condition = (F.col("a") + F.col("b")) % 13 == 0
    ids = rows.select("id")
    listed = ids.select(F.col("id").alias("a")).crossJoin(ids.select(F.col("id").alias("b"))).filter(condition)
    for assessed in (listed, condition):
        calls.clear()
        got = [(r.a, r.b, r.same_topic) for r in curation.contradiction_pairs(rows, 0.3, most, assessed=assessed).collect()]
        assert got == _expected(held, 0.3, most)
        assert len(calls) == joins  # others are compared only where the first tier leaves room
