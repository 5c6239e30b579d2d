"""Sets in tiles, against brute force."""

from __future__ import annotations

import random

import numpy as np

from memlake.operators import retrieval
from memlake.operators.set_tiles import shared_counts


def test_frequent_and_rare_members_are_counted():
    rng = np.random.default_rng(1)
    share = np.r_[np.full(20, 0.4), np.full(500, 0.01)]
    a, b = rng.random((70, 520)) < share, rng.random((90, 520)) < share
    a[5] = False
    as_lists = lambda m: (np.nonzero(m)[1], m.sum(1))
    for how in ({}, {"block": 9, "chunk": 7, "most": 50}):
        got = np.concatenate([counts for _, counts in shared_counts(as_lists(a), as_lists(b), 520, **how)])
        assert (got == a.astype(int) @ b.T.astype(int)).all()


def test_sets_of_a_group_in_many_tiles(spark):
    rng = random.Random(5)
    sets = {i: (rng.choice("xy"), {str(rng.randrange(12)) for _ in range(6)}) for i in range(60)}
    df = spark.createDataFrame([(i, g, sorted(s)) for i, (g, s) in sets.items()] + [(98, None, ["1"]), (99, None, ["1"]), (97, "x", None)], "id long, g string, words array<string>")
    want = {(i, j): len(s & t) / len(s | t) for i, (g, s) in sets.items() for j, (h, t) in sets.items() if i < j and g == h and len(s & t) / len(s | t) > 0.5}
    for how in ({"tile": 7}, {"tile_words": 50}):
        found = retrieval.similar_sets(df, 0.5, by=("g",), **how)
        assert {(r.a, r.b): r.jaccard for r in found.collect()} == want and found.count() == len(want)


def test_keywords_in_many_tiles(spark):
    """The first k by shared keywords, age and id, whatever tile they are in; a query doesn't find itself."""
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 1, 2]), sorted({str(rng.randrange(15)) for _ in range(6)})) for i in range(80)]
    df = spark.createDataFrame([*rows, (90, 1, None), (91, 1, [])], "id long, updated_at long, keywords array<string>")
    asked = df.filter("id % 10 = 0").selectExpr("id AS query_id", "keywords")
    want = []
    for q, _, words in rows[::10]:
        shared = [(-len({*words} & {*w}), at or 0, i) for i, at, w in rows if i != q]
        want += [(q, i, -n, r) for r, (n, _, i) in enumerate(sorted(x for x in shared if -x[0] >= max(2, 0.25 * len(words)))[:5])]
    for how in ({}, {"tile": (3, 7)}, {"tile_words": 40}):
        assert sorted(map(tuple, retrieval.keyword_matches(asked, df, 5, others=True, **how).collect())) == sorted(want)
