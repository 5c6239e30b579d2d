"""Phrase mining against a count over plain lists, and the trie by itself."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from memlake.llm import phrases


def plain(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    longer = Counter()
    for g, a in found.items():
        if len(g) == 4:
            for part in ((g[0], *g[1:3]), (g[0], *g[2:4])):
                longer[part] = max(longer[part], a)
    out = {}
    for g, a in found.items():
        if longer[g] and 100 * longer[g] >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[g[: k + 1]] * f[(g[0], *g[k + 1 :])]), k, f[g[: k + 1]], f[(g[0], *g[k + 1 :])]) for k in range(1, len(g) - 1)]
        score, _, left, right = min(cuts)
        out.setdefault(g[0], []).append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def check(df, least=2, **how):
    got = phrases.collocations(df, least, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == plain([(r.lang, r.text) for r in df.collect()], least, how.get("top", 2000))
    return rows


@pytest.mark.parametrize("how", [{}, {"burst": 4, "most": 50, "hot_share": 50}, {"bitmap_bits": 64}, {"top": 3}])
def test_odd_rows(odd, how):
    """Nulls, empty and very long texts, repeated rows, clashing columns; containers that burst, tries that spill, full bitmaps."""
    assert check(odd, **how)


def test_documents(docs):
    assert check(docs, 10)


def test_hot_words_and_pairs(spark):
    """One word is half of all words, one pair a third; words repeat themselves; a phrase begins and ends a piece."""
    rows = [("hot", f"the the the w{i % 40} the pair of the pair\tof x{i}, Pair of; a{i % 3} b{i % 3} a{i % 3} b{i % 3}") for i in range(400)]
    rows += [(None, "the pair of nothing"), ("", "a b c\x0ba b c"), ("de", None), ("de", "")] * 20
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    found = check(df, 10, most=100, hot_share=20)
    assert {r[0] for r in found} == {"hot", "und", ""}


def test_none(none):
    assert phrases.collocations(none).collect() == []


def test_trie_bursts_and_spills():
    """Whatever bursts and spills, a phrase's counts add up; containers hold their own ranges of prefixes, and the largest leaves first and whole."""
    rng, trie, want, got = np.random.default_rng(1), phrases.HatTrie(3, burst=8, most=300), Counter(), Counter()
    for _ in range(60):
        ids = rng.zipf(1.6, (200, 3)).clip(1, 50)
        keys, counts = np.unique(ids[:, 0] << 42 | ids[:, 1] << 21 | ids[:, 2], return_counts=True)
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        trie.add(keys, counts)
        assert (np.diff(trie.starts) > 0).all() and trie.size == sum(map(len, trie.containers))
        for low, high, held in zip(trie.starts.tolist(), [*trie.starts.tolist()[1:], 1 << 63], trie.containers):
            assert all(low <= k < high for k in held)
            prefixes = {k >> 21 for k in held}
            assert len(held) <= 8 or max(Counter(k >> 21 for k in held).values()) > 2 or len(prefixes) == 1  # only a long prefix of two words makes one longer
        if trie.full:
            largest = max(range(len(trie.containers)), key=lambda i: len(trie.containers[i]))
            for k, n in trie.spill():
                got.update(dict(zip(k.tolist(), n.tolist())))
            assert not trie.containers[largest] and trie.size <= 300
    assert len(trie.containers) > 20
    for k, n in trie.spill(1.0):
        got.update(dict(zip(k.tolist(), n.tolist())))
    assert got == want and trie.size == 0


def test_exact_beyond_64_bits(spark):
    """a * a * 1000000 passes 64 bits."""
    from pyspark.sql import functions as F

    wide = spark.createDataFrame([(5_000_000_000, 6_000_000_001, 7_000_000_003)], "a long, l long, r long").select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert wide.first().s == 1000000 * 5_000_000_000**2 // (6_000_000_001 * 7_000_000_003)
