"""The corpus pipeline: each stage on odd rows, and the whole against the stages' own rules."""

from __future__ import annotations

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline

from .test_pairs import WORD, fuzzy
from .test_scale import jaccard_groups
from .test_texts import VOCABULARY, targets


def test_stages_on_odd_rows(spark, data, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, data)
        assert out.columns == odd.columns, name
        assert out.count() > 0
        empty = stage(spark, none, data)
        assert empty.columns == odd.columns and empty.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, data).count() == 0


def test_run(spark, data, docs):
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = corpus_pipeline.run(spark, data).select("doc_id", "n_tokens", "ids").collect()
    assert {r.doc_id for r in rows} <= ids and all(len(r.ids) == r.n_tokens for r in rows)
    assert max(Counter(r.doc_id for r in rows).values()) <= 2
    again = corpus_pipeline.run(spark, data).select("doc_id", "n_tokens").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter(map(tuple, again))


def test_stages_against_brute_force(spark, data, docs):
    """Line dedup, near-dedup, mixing and encoding of documents, each against a plain version on its own input."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    left = fuzzy(rows)
    lined = corpus_pipeline.lines(spark, docs, data).select("doc_id", "text", "n_chars").collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in lined} == {d: (left(d, t), len(left(d, t))) for d, t in rows}
    group = jaccard_groups(rows)
    least = {g: min(d for (d, _), k in zip(rows, group) if k == g) for g in set(group)}
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).select("doc_id").collect()]
    assert sorted(kept) == sorted(least.values())
    size = {d: len(WORD.findall((t or "").encode())) for d, t in rows}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    taken, whole = Counter(), Counter()
    for d, n in size.items():
        whole[source[d]] += n
    for r in corpus_pipeline.mixing(spark, docs, data).select("doc_id").collect():
        taken[source[r.doc_id]] += size[r.doc_id]
    longest = {s: max(n for d, n in size.items() if source[d] == s) for s in whole}
    for s, want in targets(whole).items():
        assert abs(taken[s] - want) <= longest[s], s  # some ten documents a source here
    assert abs(sum(taken.values()) - 1.5 * sum(whole.values())) <= 0.03 * sum(whole.values())
    lib = Tokenizer.from_file(VOCABULARY)
    texts = dict(rows)
    for r in corpus_pipeline.encode(spark, docs.filter("doc_id % 4 = 0"), data).collect():
        assert r.ids == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
