"""Pairs of like sets that bounds leave, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from memlake.operators import retrieval
from memlake.operators.set_tiles import similar_rows


@pytest.mark.parametrize("above", [0, 3])
@pytest.mark.parametrize("least", [0.0, 0.3, 0.6])
def test_bounds_lose_no_pair(least, above):
    """Rare, middle and common members in any share, sizes of sets above their members', and sets without any."""
    rng = np.random.default_rng(2)
    share = np.r_[np.full(15, 0.7), np.full(90, 0.15), np.full(400, 0.01)]
    m = rng.random((90, 505)) < share * rng.random((90, 1)) * 2
    m[3] = False
    m[60:70] = m[50:60] ^ (rng.random((10, 505)) < 0.01)
    more = rng.integers(0, max(above, 1), 90) * (m.sum(1) > 0)  # none where above is 0, and then the pairs are exact
    sizes = m.sum(1) + more
    order = np.argsort(sizes)
    m, more, sizes = m[order], more[order], sizes[order]
    tile = lambda rows: (np.nonzero(m[rows])[1], m[rows].sum(1), sizes[rows])
    shared = m.astype(int) @ m.T.astype(int) + more[:, None] + more[None, :]
    both = sizes[:, None] + sizes[None, :]
    may, must = (x > max(least - 1e-9, 0) * (both - x) for x in (shared, np.minimum(shared, np.minimum(sizes[:, None], sizes[None, :]))))
    for how in ({}, {"hits": 0.0, "wide": 5}, {"hits": 3.0, "wide": 20, "cells": 200, "most": 10}, {"hits": 1e9}):
        for x, y, same in ((slice(0, 90), slice(0, 90), True), (slice(0, 40), slice(40, 90), False), (slice(40, 90), slice(0, 40), False)):
            got = [p for i, j in similar_rows(tile(x), tile(y), 505, least, same, **how) for p in zip((i + x.start).tolist(), (j + y.start).tolist(), strict=True)]
            low, high = ({(int(i), int(j)) for i, j in zip(*np.nonzero(z), strict=True) if x.start <= i < x.stop and y.start <= j < y.stop and (i < j or not same)} for z in (must, may))
            assert len(got) == len(set(got)) and low <= set(got) <= high


def test_tiles_that_sizes_rule_out_do_not_meet(spark):
    """Sets of 10 and of 100 words can't have a Jaccard above 0.3, so a task has one size; like sets are found all the same."""
    rng = random.Random(4)
    sets = {i: {str(rng.randrange(40 * size)) for _ in range(size)} for i in range(60) for size in ((10, 100)[i % 2],)}
    sets |= {100 + i: sets[i] | {"x"} for i in range(0, 60, 7)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, words array<string>")
    want = {(i, j) for i, s in sets.items() for j, t in sets.items() if i < j and len(s & t) / len(s | t) > 0.3}
    for how in ({"tile": 8}, {"tile": 1 << 14}, {"tile_words": 300}):
        got = retrieval.similar_sets(df, 0.3, **how)
        assert {(r.a, r.b) for r in got.collect()} == want
    seen = spark.sparkContext.accumulator(0)
    one = retrieval.similar_rows

    def sizes(left, right, *rest, **more):
        seen.add(int(left[2].max() * 3 < right[2].min()))
        return one(left, right, *rest, **more)

    retrieval.similar_rows = sizes
    try:
        retrieval.similar_sets(df, 0.3, tile=8).count()
    finally:
        retrieval.similar_rows = one
    assert seen.value == 0
