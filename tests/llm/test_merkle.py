"""The Merkle manifest against a walk over plain lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from memlake.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        j = i // 3 * 3
        yield "".join(level[j:i]), "".join(level[i + 1 : j + 3])
        i //= 3


def plain_manifest(rows):
    groups = {}
    for r in rows:
        text = r["text"]
        if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, text), r["doc_id"]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (_, _, own, changed, doc_id) in enumerate(sorted(groups[s])):
            steps = [*siblings(trees[s], i), *siblings(top, k)]
            folded = changed
            for left, right in steps:
                folded = digest(left, folded, right)
            yield doc_id, own, trees[s][-1][0], top[-1][0], digest(*(a + b for a, b in steps)), folded, folded == top[-1][0]


def check(df, digits):
    got = merkle.merkle_manifest(df, merkle.without_breaks(df), digits=digits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = sorted(plain_manifest([r.asDict() for r in df.collect()]), key=repr)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == want
    return rows


@pytest.mark.parametrize("digits", [1, 3])
def test_odd_rows(odd, digits):
    """Nulls in any column, repeated rows, null ids, long texts, columns with clashing names; depths that differ by source."""
    check(odd, digits)


def test_documents(docs):
    rows = check(docs, 2)
    assert 0 < sum(r[-1] for r in rows) < len(rows)


def test_hot_source_and_repeats(spark):
    """One source holds all but a few rows, a third of them alike; one source has a single row, one is the empty string."""
    rows = [(i if i % 3 else 5, "t\n" if i % 3 == 0 else f"text {i}", "en", "hot", 5) for i in range(1000)]
    rows += [(7, "alone", None, "alone", None), (8, None, "en", None, None), (9, "", "en", "", 0), (10, "ö\nz", "de", "über", 3)]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), 2)


def test_single_and_none(spark, odd, none):
    assert merkle.merkle_manifest(none).collect() == []
    row = merkle.merkle_manifest(odd.filter("doc_id = 3").limit(1)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == digest()


def test_ranks_of_a_hot_group_are_dealt(spark):
    """Ranks of one group with seven keys: its rows lie in several tasks, whose first ranks are the sums of those before."""
    rows = spark.range(4000).select(F.lit("g").alias("grp"), (F.col("id") % 7).alias("key"), F.col("id").alias("row"))
    got = merkle.ranked(rows, "key").collect()
    assert [(r.key, r.row) for r in sorted(got, key=lambda r: r.rank)] == sorted((i % 7, i) for i in range(4000))
    assert sorted(r.rank for r in got) == list(range(4000)) and {r.n for r in got} == {4000}
