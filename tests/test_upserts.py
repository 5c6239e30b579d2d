"""Entries of a batch against a walk that takes them one after another; the keyed table through retries and growth."""

from __future__ import annotations

import random

import numpy as np
import pytest

from memlake.operators import records
from memlake.params import DEFAULTS, Params
from memlake.streaming import jobs


def walk(stored, entries, vec_of_row, vec_of_entry, p):
    """stored: id to [type, topic, content, superseded]; gives actions and the rows that end up new or changed."""
    base = max(stored, default=0)
    rows, vec, out, touched = {i: [*r, None] for i, r in stored.items()}, dict(vec_of_row), {}, set()
    against = lambda a, b: ("never" in a.split()) != ("never" in b.split())

    def insert(n, kind, topic, content):
        rows[base + 1 + n] = [kind, topic, content, None]
        vec[base + 1 + n] = vec_of_entry[n]
        touched.add(base + 1 + n)

    for n, kind, topic, content in entries:
        if len(content) < 20:
            out[n] = ("dropped", None, False)
            continue
        sims = {i: float(vec[i] @ vec_of_entry[n]) for i in rows}
        same = [i for i in sorted(rows) if rows[i][:2] == [kind, topic]]
        mark = None
        if same:
            t, old = same[0], rows[same[0]][2]
            if old and old != content and sims[t] < p.variant:
                mark = t if against(content, old) else None
                out[n] = ("variant", t, mark is not None)
                insert(n, kind, topic, content)
            elif old != content:
                mark = t if old else None
                out[n] = ("overwrite", t, bool(old))
                rows[t][2], vec[t] = content, vec_of_entry[n]
                touched.add(t)
            else:
                out[n] = ("same", t, False)
        else:
            near = min(rows, key=lambda i: (-round(sims[i], 9), i)) if rows else None
            if near is not None and sims[near] >= p.dedup:
                out[n] = ("same" if rows[near][2] == content else "duplicate", near, False)
                if rows[near][2] != content:
                    rows[near][2], vec[near] = content, vec_of_entry[n]
                    touched.add(near)
            else:
                mark = near if near is not None and sims[near] >= p.negation_floor and against(content, rows[near][2]) else None
                out[n] = ("insert", mark, mark is not None)
                insert(n, kind, topic, content)
        if mark is not None:
            rows[mark][3] = content[:200]
            touched.add(mark)
    return out, {i: tuple(rows[i]) for i in touched}


@pytest.mark.parametrize("seed", [2])
def test_batch_equals_one_after_another(spark, seed):
    """Few topics and vectors close to each other: chains, repeats within the batch, rows overwritten twice, variants of variants."""
    rng, np_rng = random.Random(seed), np.random.default_rng(seed)
    p = Params(dedup=0.9, variant=0.8, negation_floor=0.6)
    centres = np_rng.normal(size=(5, 6))

    def vector():
        v = centres[rng.randrange(5)] + 0.45 * np_rng.normal(size=6)
        return v / np.linalg.norm(v)

    texts = [f"we {word} keep plan number {i} in this place" for i in range(5) for word in ("never", "often")]
    stored = {i: [rng.choice("fd"), rng.choice("xyzuvw"), rng.choice([*texts, ""])] for i in range(1, 10)}
    entries = [(n, rng.choice("fd"), rng.choice("xyzuvwabcde"), rng.choice([*texts, "short"])) for n in range(24)]
    rv, ev = {i: vector() for i in stored}, {n: vector() for n, *_ in entries}
    near = [(n, i, float(rv[i] @ ev[n])) for n in ev for i in rv if rv[i] @ ev[n] >= p.negation_floor]
    among = [(n, m, float(ev[m] @ ev[n])) for n in ev for m in ev if n != m and ev[m] @ ev[n] >= p.negation_floor]
    frame = spark.createDataFrame
    told, delta = records.upsert_batch(
        frame([(i, *r) for i, r in stored.items()], "id long, type string, topic string, content string"), frame([(n, n, *e) for n, *e in entries], "nth long, message_id long, type string, topic string, content string"),
        frame(near, "nth long, id long, similarity double"), frame(among, "nth long, other long, similarity double"), p,
    )
    want, rows = walk(stored, entries, rv, ev, p)
    assert {r.nth: (r.action, r.target, r.annotates) for r in told.collect()} == want
    assert {r.id: (r.type, r.topic, r.content, r.superseded) for r in delta.collect()} == rows
    assert {a for a, *_ in want.values()} >= {"variant", "overwrite", "insert", "dropped"}


def test_entries_by_themselves(spark):
    """A missing similarity of the same topic makes a variant, not an overwrite; an identical text changes nothing."""
    stored = spark.createDataFrame([(1, "f", "t", "we never use the old cache here"), (2, "f", "u", "the build runs on each commit made"), (3, "f", "e", "")], "id long, type string, topic string, content string")
    entries = spark.createDataFrame([(0, 0, "f", "t", "we always use the old cache here"), (1, 1, "f", "u", "the build runs on each commit made"), (2, 2, "f", "e", "now there is something to keep here")], "nth long, message_id long, type string, topic string, content string")
    none = spark.createDataFrame([], "nth long, id long, similarity double")
    got = {r.nth: (r.action, r.target) for r in records.insert_entries(stored, entries, none, DEFAULTS).collect()}
    assert got == {0: ("variant", 1), 1: ("same", 2), 2: ("overwrite", 3)}


def test_keyed_table_retries_and_grows(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    table = lambda **how: jobs.KeyedTable(spark, f"file://{tmp_path}/t", schema, ["k"], **how)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], schema)
    put = lambda n, ids, v, **how: table(**how).put(rows(ids, v), jobs.replaced(["k"]), n)
    read = lambda: {r.k: r.v for r in table().read().collect()}
    put(0, range(100), "a", parts=4)
    for _ in range(3):  # tried again after its list was written, as after a crash before the stream's commit
        put(1, range(40), "b", parts=4)
        assert read() == {i: "b" if i < 40 else "a" for i in range(100)}
    (tmp_path / "t/lists/1/_SUCCESS").unlink()  # a crash between the rows and the list
    assert read() == dict.fromkeys(range(100), "a")
    put(1, range(40), "b", parts=4)
    put(2, [7], "c", parts=4)
    want = {i: "b" if i < 40 else "a" for i in range(100)} | {7: "c"}
    assert read() == want and {r.parts for r in table().places()} == {4}
    put(3, [200], "d", part_rows=10)
    put(3, [200], "d", part_rows=10)
    assert read() == want | {200: "d"} and {r.parts for r in table().places()} == {16}
    put(4, [], "e", part_rows=10)
    assert read() == want | {200: "d"} and sum(r.rows for r in table().places()) == 101
