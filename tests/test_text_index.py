"""The full-text index on disk against a search over all documents, through updates, deletions and merges."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memlake.operators import retrieval
from memlake.operators.text_index import text_index

WORDS = [f"w{i}" for i in range(60)]


def texts(rng, ids):
    return {i: " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))) for i in ids}


def frame(spark, held):
    return spark.createDataFrame([(i, t) for i, t in held.items()], "id long, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(q, " ".join(rng.choices(WORDS, k=n))) for q, n in enumerate([1, 2, 4, 12, 30, 0])] + [(9, "W1 w1 unknown")], "query_id long, query string")


def same(index, spark, held, asked):
    got = sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in index.top_k(asked, 7).collect())
    want = sorted((r.query_id, r["rank"], r.id, round(r.score, 7)) for r in retrieval.bm25_top_k(frame(spark, held), asked, 7).collect())
    assert got == want and got
    assert {r.id: r.length for r in index.documents().collect()} == {i: len((t or "").split()) for i, t in held.items()}


def test_three_updates_and_a_merge(spark, asked):
    rng = random.Random(2)
    held = texts(rng, range(300))
    held[7], held[8] = None, ""
    index = text_index(spark, ranges=40)
    assert index.top_k(asked, 7).count() == 0
    assert index.update(frame(spark, held)) == 300
    same(index, spark, held, asked)
    first = {i: t for i, t in texts(rng, range(250, 330)).items()}
    held.update(first)
    assert index.update(frame(spark, first)) == 80
    assert index.update(frame(spark, held)) == 0  # nothing new: no document is cut into words
    held = {i: t for i, t in held.items() if i % 5} | texts(rng, [1000])
    assert index.update(frame(spark, held), complete=True) == 66 + 1
    same(index, spark, held, asked)
    index.merge()
    assert index._state()[1] == [5]
    same(index, spark, held, asked)
    again = {0: "w1 w1 w1"}  # a document that was taken out comes back
    held.update(again)
    index.update(frame(spark, again))
    same(index, spark, held, asked)


def test_blocks(spark):
    """A frequent term has a block in each range, in the order of ids and within its bounds."""
    held = {i: "often " * (i % 4 + 1) + f"x{i % 50}" for i in range(2000)}
    index = text_index(spark, ranges=64)
    index.update(frame(spark, held).repartition(6))
    blocks = index._read("postings", [1]).collect()
    assert len({b.range for b in blocks if b.term == "often"}) == sum(b.term == "often" for b in blocks) == 64
    assert all(b.most_tf == max(b.tfs) and b.least_length == min(b.lengths) and b.ids == sorted(b.ids) for b in blocks)
    assert Counter(i for b in blocks if b.term == "often" for i in b.ids) == Counter(range(2000))


def test_unfinished_update_is_not_seen(spark, asked):
    """Segments without a list, as a run that died leaves them, change nothing; the next update writes over them."""
    held = texts(random.Random(3), range(50))
    index = text_index(spark, ranges=64)
    index.update(frame(spark, held))
    frame(spark, {}).select("id").write.parquet(f"{index.folder}/segments/2/docs")
    same(index, spark, held, asked)
    held.update({3: "w2 w3"})
    assert index.update(frame(spark, {3: "w2 w3"})) == 1
    same(index, spark, held, asked)


def test_pruning_reads_fewer_blocks(spark):
    """A query with a rare and a common word opens the common word's blocks only in ranges that hold the rare one."""
    held = {i: "common " + "filler " * (30 + i % 7) for i in range(3000)} | {5000 + i: "rare common" for i in range(20)}
    index = text_index(spark, ranges=100)
    index.update(frame(spark, held))
    opened = []
    scores = type(index)._scores

    def spy(self, pairs, *rest):
        opened.append(pairs.count())
        return scores(self, pairs, *rest)

    type(index)._scores = spy
    try:
        got = index.top_k(spark.createDataFrame([(1, "rare common")], "query_id long, query string"), 10)
        assert [r.id for r in got.orderBy("rank").collect()] == list(range(5000, 5010))
    finally:
        type(index)._scores = scores
    assert opened[1] <= 20 < 90 < index._read("postings", [1]).filter(F.col("term") == "common").count()
