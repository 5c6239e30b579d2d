"""Loads of a table with a past: what they write, repeated and null keys, sections of many files."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from memlake.operators.history import VersionedTable, versioned_table


def _size(folder: Path) -> int:
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_the_same_load_again_writes_no_values(spark):
    text = lambda i: "".join(hashlib.sha256(f"{i} {n}".encode()).hexdigest() for n in range(40))
    rows = spark.createDataFrame([(i, f"s{i % 3}", text(i)) for i in range(400)], "id long, sect string, body string")
    table = versioned_table(rows, ("id",), "sect")
    assert table.load(rows, 1) == 3
    shared = Path(table.folder.removeprefix("file:").replace("//", "/")).parent
    before = _size(shared)
    assert table.load(rows, 2) == 0
    assert _size(shared) - before < before / 20  # some keys and section numbers
    assert table.load(rows.filter("sect <> 's0'"), 3) == 1
    assert _size(shared) - before < before / 2  # one of three sections, once


def test_null_and_repeated_keys(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b string, sect string, body string")
    table = versioned_table(frame([]), ("a", "b"), "sect")
    table.load(frame([(None, "x", "s", "1"), (1, None, "s", "2"), (1, "x", "s", "3")]), 10)
    table.load(frame([(None, "x", "s", "1"), (None, "x", "s", "0"), (1, None, "s", "2"), (1, None, "r", "9"), (1, "x", "s", "4")]), 20)
    got = sorted((r.valid_from, str(r.valid_to), str(r.a), str(r.b), r.body) for r in table.rows().collect())
    assert got == [(10, "20", "1", "x", "3"), (10, "None", "1", "None", "2"), (10, "None", "None", "x", "1"), (20, "None", "1", "x", "4")]


def test_sections_of_many_parts(spark):
    """Keys of a section that is dealt to several partitions meet as in one, values of all kinds, history of several steps."""
    kind = "id long, sect string, n double, xs array<int>"
    first = [(i, "ab"[i % 7 == 0], float("nan") if i % 5 == 0 else i / 3, [i, None]) for i in range(300)]
    later = [(i, s, n if i % 4 else 0.5, xs) for i, s, n, xs in first if i % 11]
    last = [(i, "c" if i % 9 == 0 else s, n, xs if i % 6 else None) for i, s, n, xs in first]
    loads = {t: spark.createDataFrame(rows, kind) for t, rows in ((1, first), (2, later), (3, last))}
    table = versioned_table(loads[1], ("id",), "sect")
    table = VersionedTable(spark, table.folder, table.keys, table.section, table.schema, part_chars=500)
    for t, rows in loads.items():
        table.load(rows, t)
    for t, rows in loads.items():
        assert sorted(map(str, table.as_of(t).collect())) == sorted(map(str, rows.collect()))
    spans = table.rows().groupBy("id").agg(F.sort_array(F.collect_list("valid_from")).alias("at"))
    value = lambda r: None if r is None else (str(r[1:]))
    steps = [{r[0]: r for r in rows} for rows in (first, later, last)]
    want = {i: [t for t, now, was in ((1, steps[0], {}), (2, steps[1], steps[0]), (3, steps[2], steps[1])) if i in now and value(now[i]) != value(was.get(i))] for i in steps[0]}
    assert {r["id"]: r["at"] for r in spans.collect()} == want
