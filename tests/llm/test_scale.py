"""Hot keys, large groups and very long texts: the ways that large tables take, on small ones."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from memlake.llm import line_dedup, shared, simhash, suffix_dedup, toxicity

from .conftest import words
from .test_pairs import WORD, fuzzy, joined


def test_heavy_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(i, rng.choice([1, 1, 1, 2, 2, 3, 4, 5, None])) for i in range(200)], "id long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in (1, 3, 4, 9)], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        want = Counter(map(tuple, left.join(right, "k", how).collect()))
        for least, most in ((1, 1), (2, 2), (1, 1024), (1000, 1024)):
            assert Counter(map(tuple, shared.heavy_join(left, right, "k", how, least=least, most=most).collect())) == want


def test_slices_leave_a_long_row_alone():
    batch = pa.RecordBatch.from_arrays([pa.array([b"", b"", b"x" * 50, b"", b"yy"], pa.binary())], ["utf8"])
    assert [[len(x) for x in p.column(0).to_pylist()] for p in shared.slices(iter([batch]), limit=10)] == [[0, 0], [50], [0, 2]]


def test_suffixes_of_a_long_text_after_an_empty_one():
    text = b" ".join(b"%d" % (i * 7919 % 9973 % 10) for i in range(4_400_000))  # over 2^22 one-letter words

    def positions(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["id", "utf8"])
        return {int(p) for _, _, begin, moved, at, _ in suffix_dedup._blocks(iter([batch])) for p in at - begin[np.searchsorted(begin, at, side="right") - 1] + moved[-1]}

    alone = positions([text])
    assert positions([b"", text]) == alone and max(alone) > 4_399_000


def test_suffix_spans_of_a_document_that_repeats_itself(spark):
    """A run of one document's suffixes that is longer than several chunks, between those of another."""
    rng = random.Random(6)
    passage, other = words(rng, 60), words(rng, 60)
    rows = [(1, " ".join((passage + words(rng, 3)) * 300)), (2, " ".join(words(rng, 40) + passage + words(rng, 40))), (3, " ".join(words(rng, 50) + other)), (4, " ".join(other + words(rng, 9)))]
    seen, want = defaultdict(set), defaultdict(set)
    for d, t in rows:
        for i in range(len(w := t.split()) - 49):
            seen[tuple(w[i : i + 50])].add(d)
    for d, t in rows:
        for i in range(len(w := t.split()) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                want[d] |= set(range(i, i + 50))
    got = defaultdict(set)
    for r in suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), chunk=50).collect():
        got[r.doc_id] |= set(range(r.start, r.end))
    assert dict(got) == dict(want)


def test_tiles_meet_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    x = np.unique(np.concatenate([base, near]))
    fps = spark.createDataFrame([(v.astype(">u8").tobytes(),) for v in x], "fp binary")
    want = joined(len(x), [(a, b) for a in range(len(x)) for b in range(a) if int(x[a] ^ x[b]).bit_count() <= 2])
    at = {v.astype(">u8").tobytes(): i for i, v in enumerate(x)}
    for parts, tile, block in ((4, 2, 1), (1, 7, 2), (1, 3, 1)):
        links = simhash.near_links(fps, 2, parts=parts, tile=tile, block=block).collect()
        assert joined(len(x), [(at[bytes(r.a)], at[bytes(r.b)]) for r in links]) == want


def jaccard_groups(rows, size=5, least=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").encode().lower())
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    like = lambda a, b: a == b or (a and b and len(a & b) >= least * len(a | b))
    return joined(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])) and like(sets[i], sets[j])])


def planted(rng, sizes):
    """Texts with near copies of about the similarity that decides, and one large group of them."""
    texts = []
    for n in sizes:
        base = words(rng, n)
        texts.append(base)
        for changed in (1, max(1, n // 40), max(1, n // 22), max(1, n // 15)):
            copy = base.copy()
            at = rng.randrange(n)
            copy[at : at + 1] = words(rng, 1) if changed == 1 else []
            for _ in range(changed - 1):
                copy[rng.randrange(len(copy))] = words(rng, 1)[0]
            texts.append(copy)
        texts.append(base[:-1])
        texts.append([*base, *words(rng, 1)])
    base = words(rng, 60)
    for i in range(80):
        texts.append([w if j != i % 60 else "other" for j, w in enumerate(base)])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_dedup_against_brute_force(spark, odd):
    """All pairs at 0.8 of planted texts, short ones too; groups larger than a block."""
    rng = random.Random(8)
    rows = planted(rng, [5, 8, 9, 9, 10, 12, 15, 20, 30, 45, 60, 80, 120, 200, 300, 500])
    group = jaccard_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if group[i] == group[j]]
    for block in (256, 16):
        got = {r.doc_id: r.component_id for r in simhash.near_dedup(docs, block=block).collect()}
        assert all(group[i] == group[got[i]] for i in got)  # no link that brute force lacks
        assert sum(got[i] == got[j] for i, j in pairs) >= 0.998 * len(pairs)
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert len(kept) == len(set(got.values()))


def test_lines_in_groups_larger_than_a_block(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij klmn") for _ in range(90))
    vary = lambda x, n: "".join(rng.choice("xyz") if i in set(rng.sample(range(90), n)) else c for i, c in enumerate(x))
    lines = [vary(base, k % 4) for k in range(60)] + [vary(vary(base, 2), 1) for _ in range(20)] + [f"a line of its own {rng.random()}" for _ in range(9)]
    rng.shuffle(lines)
    rows = [(i if i % 9 else None, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(-(-len(lines) // 4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = fuzzy(rows)
    for block in (256, 5):
        got = Counter((r.doc_id, r.text) for r in line_dedup.line_dedup(docs, block=block).collect())
        assert got == Counter((d, left(d, t)) for d, t in rows)


def test_very_long_texts(spark):
    """A text of 6 MB in one line and its copy, with a passage of another: every operator on pairs takes them whole."""
    rng = random.Random(10)
    vocabulary, passage = words(rng, 5000), words(rng, 70)
    long = [rng.choice(vocabulary) for _ in range(1_000_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join([*words(rng, 40), *passage])), (4, " ".join([*long[:500_000], *passage])), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).persist()
    same = {r.doc_id: r.component_id for r in simhash.simhash_dedup(docs).collect()}
    assert same[1] == same[2] == 1 and same[3] == 3 and same[5] == 5
    spans = {(r.doc_id, r.start, r.end) for r in suffix_dedup.repeated_spans(docs).collect()}
    assert {(1, 0, 1_000_000), (2, 0, 1_000_000), (3, 40, 110), (4, 0, 500_070)} == spans
    kept = {r.doc_id: len(r.text or "") for r in line_dedup.line_dedup(docs).collect()}
    assert kept[2] == 0 and kept[1] == len(rows[0][1]) and kept[4] == len(rows[3][1])
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == {1, 3, 4, 5}
    docs.unpersist()


def test_fit_learns_a_pair_of_neutral_terms(spark):
    """Two terms, neither of which goes with the label, are toxic together; a third one makes up the balance."""
    rng, rows = random.Random(11), []
    filler = words(rng, 200)
    for i in range(6000):
        c = rng.random() < 1 / 3
        a, b = (not c and rng.random() < 0.5 for _ in range(2))
        rows.append((i, " ".join([*rng.sample(filler, 6), *["zig"] * a, *["zag"] * b, *["slur"] * c]), int(c or (a and b)), a, b))
    with_a = [r[2] for r in rows if r[3]]
    assert abs(np.mean(with_a) - np.mean([r[2] for r in rows])) < 0.03
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int, a boolean, b boolean")
    machine = toxicity.fit_toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    done = toxicity.score_toxicity(table.select("doc_id", "text"), machine, 0.5).join(table.select("doc_id", "toxic", "a", "b"), "doc_id").filter("held_out AND (a OR b)")
    assert done.filter(F.col("predicted") == F.col("toxic")).count() >= 0.9 * done.count()


def test_rows_alike_are_dealt(spark, tmp_path):
    """60,000 rows without an id and with one text: numbered apart, whatever partition they lie in, so they fill many buckets and parts."""
    from memlake.llm import mixing, sharding
    from memlake.llm.shared import twin_numbers

    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source")).unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("four words are here").alias("text"), F.lit("t").alias("source")))
    rows.repartition(7).write.parquet(f"{tmp_path}/a")
    rows.repartition(3).write.parquet(f"{tmp_path}/b")
    got = {}
    for name in "ab":
        table = spark.read.parquet(f"{tmp_path}/{name}")
        numbers = twin_numbers(table, ["doc_id", "text"], 1000).filter("doc_id IS NULL").select("_twin").collect()
        assert sorted(r[0] for r in numbers) == list(range(60_000))
        mixed = mixing.mix_documents(table).collect()
        assert abs(sum(r.taken for r in mixed if r["size"] == 3) - mixed[0].target) < 30 or {r["size"] for r in mixed} == {3, 4}
        got[name, "mix"] = sorted((r.doc_id is None, r.doc_id or 0, r.taken) for r in mixed)
        done = sharding.shard_documents(table).collect()
        got[name, "shards"] = sorted((r.doc_id is None, r.doc_id or 0, r.shard, r.slot) for r in done)
        sizes = [sum(r.shard == s for r in done) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1
    assert got["a", "mix"] == got["b", "mix"] and got["a", "shards"] == got["b", "shards"]
    dealt = twin_numbers(spark.read.parquet(f"{tmp_path}/a"), ["doc_id", "text"], 1000).groupBy(F.pmod(F.xxhash64("doc_id", "text", "_twin"), F.lit(12)).alias("p")).count().collect()
    assert max(r["count"] for r in dealt) < 2 * 60_500 / 12


def test_toxicity_takes_one_text_of_an_id(spark):
    """20,000 documents of one labelled id reach the driver as one row, of bounded width."""
    from memlake.llm import toxicity

    docs = spark.range(20_000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("common words and "), F.col("id").cast("string"), F.lit(" x")).alias("text"))
    long = spark.range(1).select(F.lit(4).cast("long").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda i: F.translate(i.cast("string"), "0123456789", "abcdefghij"))).alias("text"))
    labels = spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, toxic int").filter(~toxicity.held_out(F.col("doc_id")))
    seen = {}
    fit = toxicity.fit_machine

    def spy(on, y, feature, **how):
        seen.update(rows=len(y), width=max(map(len, on.to_pylist())))
        return fit(on, y, feature, **how)

    toxicity.fit_machine = spy
    try:
        toxicity.fit_toxicity(docs.unionByName(long), labels, most_terms=500)
    finally:
        toxicity.fit_machine = fit
    assert seen["rows"] == labels.count() and seen["width"] <= 500


def test_machine_equals_a_dense_one():
    """Weights, factors and scores of a sparse fit equal those of the same steps on dense matrices."""
    import math

    from memlake.llm import toxicity

    rng = np.random.default_rng(4)
    x = (rng.random((200, 30)) < 0.2).astype(float)
    x[7] = 0
    y = (rng.random(200) < 0.3).astype(float)
    on = [np.flatnonzero(r).tolist() for r in x]
    m = toxicity.fit_machine(on, y, range(30), rank=3, epochs=4)
    rng, n, rank, step, decay = np.random.default_rng(5), 30, 3, 0.1, 1e-4
    rate = min(0.98, max(0.02, y.mean()))
    share, pos = x.mean(0), y.sum()
    z2 = (x[y > 0].sum(0) / pos - x[y == 0].sum(0) / (200 - pos)) ** 2 / (share * (1 - share) * (1 / pos + 1 / (200 - pos)) + 1e-12)
    damp, turn = ((z2 + 1) / (z2 + toxicity.DAMPING)) ** 2, step * min(1.0, 16 / max(1.0, x.sum(1).mean()))
    order = rng.permutation(200)
    blocks = [order[i : i + 64] for i in range(0, 200, 64)]
    bias, w, v = math.log(rate / (1 - rate)), np.zeros(n), rng.normal(0, 0.01, (n, rank))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, rank), 1e-2), 1e-6
    value = lambda a: bias + a @ w + 0.5 * (((a @ v) ** 2).sum(1) - a @ (v * v).sum(1))
    for _ in range(4):
        for k in rng.permutation(len(blocks)):
            a, real = x[blocks[k]], y[blocks[k]]
            err = (1 / (1 + np.exp(-np.clip(value(a), -30, 30))) - real) / len(real)
            here = a.sum(0) > 0
            dw = a.T @ err + decay * w
            dv = a.T @ (err[:, None] * (a @ v)) - (a.T @ err)[:, None] * v + decay * v
            gb += err.sum() ** 2
            bias -= step * err.sum() / math.sqrt(gb)
            gw[here] += dw[here] ** 2
            gv[here] += dv[here] ** 2
            w[here] -= (damp * step * dw / np.sqrt(gw))[here]
            v[here] -= (turn * dv / np.sqrt(gv))[here]
    assert abs(m.bias - bias) < 1e-5 and np.abs(m.weight - w).max() < 1e-4 and np.abs(m.factor - v).max() < 1e-4
    assert np.abs(np.array([m.score(r) for r in on]) - 1 / (1 + np.exp(-value(x)))).max() < 1e-4
