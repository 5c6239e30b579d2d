"""SimHash, suffix arrays, fuzzy lines and exact duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from memlake.llm import line_dedup, shared, simhash, suffix_dedup
from memlake.llm.components import components
from memlake.llm.exact_dedup import exact_dedup, misra_gries

from .conftest import words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def joined(n, links):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def print_of(text, size=3):
    w = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 9), (7, 20), (20, 21), (21, 22), (22, 23), (23, 24), (24, 5)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    want = joined(len(nodes), [(at[a], at[b]) for a, b in edges if a != b])
    assert got == {x: nodes[want[at[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_against_brute_force(odd, none):
    rows = simhash.simhash_dedup(odd).collect()
    source = odd.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    prints = {(r.doc_id, f"{print_of(r.text):016x}") for r in source}
    assert {(r.doc_id, r.fingerprint) for r in rows} == prints
    fps = sorted({int(p, 16) for _, p in prints})
    group = joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = defaultdict(list)
    for d, p in prints:
        least[group[fps.index(int(p, 16))]].append(d)
    for r in rows:
        ids = [d for d in least[group[fps.index(int(r.fingerprint, 16))]] if d is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.simhash_dedup(none).count() == 0


def test_tiles_link_like_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    x = np.unique(np.concatenate([base, near]))[:, None]
    i, j = simhash._forest(x, x, 2, 2, True)
    want = joined(len(x), [(a, b) for a in range(len(x)) for b in range(a) if int(x[a, 0] ^ x[b, 0]).bit_count() <= 2])
    assert joined(len(x), zip(i.tolist(), j.tolist())) == want
    assert len(i) == len(x) - len(set(want))


def test_near_dedup_keeps_one_of_each(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) + ids.count(None) - (None in ids)
    assert 0 in ids and not {1, 3, 6, 9} & set(ids)  # exact copies, the near copy and another case of the text
    assert {33, 36} <= set(ids)


def test_suffix_spans_against_brute_force(spark, odd, none):
    got = defaultdict(set)
    for r in suffix_dedup.repeated_spans(odd).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    source, seen = [], defaultdict(set)
    for r in odd.select("doc_id", "text").collect():
        w = WORD.findall((r.text or "").encode())
        source.append((r.doc_id, w))
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(r.doc_id)
    want = defaultdict(set)
    for d, w in source:
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                want[d] |= set(range(i, i + 50))
    assert {d: x for d, x in got.items() if x} == {d: x for d, x in want.items() if x}
    assert suffix_dedup.repeated_spans(none).count() == 0


def test_suffix_spans_with_frequent_tails(spark):
    rng, rows = random.Random(3), []
    for own, tail in ((15, 40), (25, 30), (29, 21), (28, 50), (10, 45), (20, 35)):
        shared, often = words(rng, own), words(rng, tail)
        for k in range(62):
            middle = (shared if k in (7, 41) else words(rng, own)) + often
            rows.append((len(rows), " ".join(words(rng, 60) + middle + words(rng, 60))))
    rng.shuffle(rows)
    seen, want = defaultdict(set), defaultdict(set)
    for d, t in rows:
        for i in range(len(w := t.split()) - 49):
            seen[tuple(w[i : i + 50])].add(d)
    for d, t in rows:
        for i in range(len(w := t.split()) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                want[d] |= set(range(i, i + 50))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for adaptive, parts in (("true", "4"), ("false", "13")):  # in one chunk, and ties that go on in the next
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = defaultdict(set)
            for r in suffix_dedup.repeated_spans(docs).collect():
                got[r.doc_id] |= set(range(r.start, r.end))
            assert dict(got) == dict(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_word_hashes_do_not_depend_on_place():
    a, at = suffix_dedup.word_hashes([b"x yy zzz", b"", b"  zzz x", "ü yy".encode()])
    assert at.tolist() == [0, 3, 3, 5, 7] and a[0] == a[4] and a[2] == a[3] and a[1] == a[6]


def test_long_texts_in_pieces():
    import pyarrow as pa

    text = b" ".join(b"w%d" % (i * i % 99991) for i in range(60_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.binary())], ["id", "utf8"])
    whole = suffix_dedup.minimisers(*suffix_dedup.word_hashes([text]))[1]
    parts = [x for *_, x in suffix_dedup._long(batch, text, 100_000)]
    assert set(whole.tolist()) == set(np.concatenate(parts).tolist())


def fuzzy(docs):
    first, order = {}, lambda d: (d is not None, d or 0)
    for d, t in sorted(docs, key=lambda x: order(x[0])):
        for i, x in enumerate((t or "").encode().split(b"\n")):
            if x.strip():
                first[x.strip()] = min(first.get(x.strip(), (order(d), i)), (order(d), i))  # rows without an id share places
    lines = list(first)
    sets = [{s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in (x.decode() for x in lines)]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group, best = joined(len(lines), pairs), {}
    for i, x in enumerate(lines):
        best[group[i]] = min(best.get(group[i], first[x]), first[x])
    at = {x: i for i, x in enumerate(lines)}

    def left(d, t):
        return None if t is None else b"\n".join(x for i, x in enumerate(t.encode().split(b"\n")) if not x.strip() or best[group[at[x.strip()]]] == (order(d), i)).decode()

    return left


def test_line_dedup_against_brute_force(odd, none):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    left = fuzzy(docs)
    done = line_dedup.line_dedup(odd)
    assert done.columns == odd.columns
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted([(r.doc_id, r.text) for r in done.collect()], key=key) == sorted([(d, left(d, t)) for d, t in docs], key=key)
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_of_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    left = fuzzy(rows)
    got = {r.doc_id: r for r in line_dedup.deduped_lines(docs).collect()}
    assert all(got[d].text == left(d, t) for d, t in rows)
    assert all(got[d].n_lines == len(t.split("\n")) for d, t in rows)


def test_minhash_bins_agree_like_jaccard():
    a = "".join(chr(97 + i * i % 26) + chr(97 + i % 23) for i in range(400))
    b = a[:700] + a[:100]
    x, y = (set(z[i : i + 8] for i in range(len(z) - 7)) for z in (a, b))
    sigs = line_dedup.signatures([a, b, "short", "shorter x"])
    assert not (sigs == line_dedup._NONE).any()
    assert abs((sigs[0] == sigs[1]).mean() - len(x & y) / len(x | y)) < 0.3


def test_exact_dedup(odd, none):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    source = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in source:
        groups[low(r.text)].append(r.doc_id)
    for counters in (1024, 2):
        got = exact_dedup(odd, counters=counters).collect()
        assert len(got) == len(source) and sum(r.kept for r in got) == len(groups)
        by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by[r.text_sha256]
            known = [x for x in ids if x is not None]
            assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
            assert not r.kept or r.doc_id == r.keep_id
    assert exact_dedup(none).count() == 0


def test_misra_gries_names_every_heavy_digest():
    import pyarrow as pa

    items = [b"a"] * 400 + [b"%d" % i for i in range(600)] + [b"b"] * 300
    batches = [pa.RecordBatch.from_arrays([pa.array(items[i::4], pa.binary())], ["digest"]) for i in range(4)]
    found = dict(zip(*(c.to_pylist() for c in next(misra_gries(iter(batches), 8)).columns)))
    assert {b"a", b"b"} <= set(found) and len(found) <= 8
    assert 400 - 1300 / 9 <= found[b"a"] <= 400


def test_slices_hold_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([b"x" * n for n in (1, 9, 2, 0, 30, 1, 1)])], ["id", "utf8"])
    parts = list(shared.slices(iter([batch]), limit=10))
    assert [x for p in parts for x in p.column("id").to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(map(len, p.column("utf8").to_pylist())) <= 10 for p in parts)
