"""Vector search in tiles, by an inverted-file index and by moments, against plain numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import retrieval, vectors

SCHEMA = "id long, embedding array<float>"


def unit(rng, n, wide=16):
    m = rng.normal(size=(n, wide))
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def m():
    """400 vectors about eight centres, one of which holds half; some are repeated, so similarities tie."""
    rng = np.random.default_rng(1)
    centres = unit(rng, 8)
    near = centres[rng.choice(8, 400, p=[0.5, *[0.5 / 7] * 7])] + 0.3 * rng.normal(size=(400, 16))
    near = (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)
    near[50:60] = near[40]
    return near


@pytest.fixture(scope="module")
def corpus(spark, m):
    odd = [(1000, None), (1001, [1.0, 0.0]), (None, None)]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + odd, SCHEMA).repartition(5)


def plain(m, ask, k, least=-1.0):
    out = {}
    for q in ask:
        sim = m.astype(float) @ m[q].astype(float)
        best = sorted((-round(s, 9), i) for i, s in enumerate(sim) if s >= least)[:k]
        out[q] = [i for _, i in best]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


def queries(corpus, every=20):
    return corpus.filter(f"id % {every} = 0 AND id < 1000").select(F.col("id").alias("query_id"), "embedding")


def test_tiles(corpus, m):
    ask = range(0, 400, 20)
    rows, asked = corpus.filter("embedding IS NOT NULL").select("id", F.col("embedding").alias("v")), queries(corpus).select("query_id", F.col("embedding").alias("v"))
    for tiles in ({}, {"tile": 37, "block": 3, "slice_rows": 2}):
        assert by_query(vectors.tiled_top_k(rows, asked, 12, **tiles)) == plain(m, ask, 12)
        assert {q: ids for q, ids in plain(m, ask, 12, 0.5).items() if ids} == by_query(vectors.tiled_top_k(rows, asked, 12, 0.5, **tiles))
    assert vectors.tiled_top_k(rows, asked, None, 0.5).count() == sum(len(x) for x in plain(m, ask, 400, 0.5).values())
    assert retrieval.vector_top_k(corpus, queries(corpus).limit(0), 5).count() == retrieval.vector_top_k(corpus.limit(0), queries(corpus), 5).count() == 0


def test_index(spark, corpus, m):
    index = vectors.build_index(corpus.filter("id % 4 = 0 OR id > 900"), 10, sample=60)
    files = {r.path for r in index.rows().select(F.input_file_name().alias("path")).distinct().collect()}
    for k in (1, 2, 3):
        index.append(corpus.filter(f"id % 4 = {k} AND id < 1000"))
    kept = {r.path for r in index.rows().select(F.input_file_name().alias("path")).distinct().collect()}
    assert files <= kept and sorted(r.id for r in index.rows().collect()) == list(range(400))
    centres = index.centroids()
    assert all(int(np.argmax(centres @ np.array(r.v, float))) == r.cell for r in index.rows().collect())
    assert by_query(index.top_k(queries(corpus), 10, 10)) == plain(m, range(0, 400, 20), 10)
    few = index.probes_for(queries(corpus), 10, 0.9)
    assert few < 10
    found = vectors.recall(index.top_k(queries(corpus), 10, few), retrieval.vector_top_k(corpus, queries(corpus), 10)).first()
    assert found.queries == 20 and found.recall >= 0.9
    one = index.top_k(queries(corpus).limit(1), 5, 1)
    assert one.count() == 5 and vectors.build_index(corpus.limit(0), 4).centroids().shape[0] == 0


def test_moments_and_variants(spark, corpus, m):
    n, mean, second = vectors.moments(corpus, fan=2)
    x = m.astype(float)
    assert n == 400 and np.allclose(mean, x.mean(0)) and np.allclose(second, x.T @ x / 400)
    variants = queries(corpus).select(F.expr("query_id div 60").alias("query_id"), F.expr("query_id div 20 % 3").alias("variant"), F.col("embedding").alias("v"))
    got = by_query(vectors.variant_top_k(corpus, variants, 9, tile=90, block=4))
    for q in range(7):
        of = [i for i in range(0, 400, 20) if i // 60 == q]
        sim = np.array([x @ x[i] for i in of])
        z = np.round((sim - sim.mean(1, keepdims=True)) / np.maximum(sim.std(1, keepdims=True), 1e-6), 9)
        raw = sim[np.argmax(z, axis=0), np.arange(400)]
        assert got[q] == [i for _, i in sorted((-round(s, 9), i) for i, s in enumerate(raw))[:9]]
        every = {r.id: r.similarity for r in vectors.variant_top_k(corpus, variants.filter(f"query_id = {q}"), None, tile=90, block=4).collect()} if q in (0, 6) else None
        assert every is None or (len(every) == 400 and np.allclose([every[i] for i in range(400)], raw))
    assert vectors.variant_top_k(corpus.limit(0), variants, 3).count() == 0
