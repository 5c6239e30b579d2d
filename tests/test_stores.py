"""Exports with manifests, tables with a past, and queues as streams: round trips, failures, restarts."""

from __future__ import annotations

import glob
import gzip
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from memlake.operators.history import versioned_table
from memlake.sources import exports
from memlake.streaming import queue

LABELS = "query string, mem string, grade long"


def test_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"q{i % 7}", f'text "{i}" ö\n', i % 4) for i in range(50)] + [("alone", None, None)], LABELS).repartition(3)
    path = f"file://{tmp_path}/out"
    manifest = exports.export_labels(rows, path, "query")
    assert manifest["rows"] == 51 and manifest["counts"] == {"labels": 51, "distinct_queries": 8, "labels_per_query": 6.38, "single_label_queries": 1, "pairable_queries": 7}
    for p in manifest["files"]:
        data = (tmp_path / "out" / p["name"]).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest(), len(gzip.decompress(data).splitlines())) == (p["bytes"], p["sha256"], p["rows"])
    back = exports.import_labels(spark, path, LABELS)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    again = exports.export_labels(rows.limit(0), path, "query")
    assert again["rows"] == 0 and exports.import_labels(spark, path, LABELS).count() == 0
    assert {f.name for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")} == {p["name"] for p in again["files"]}


def test_failing_task_leaves_the_earlier_export(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        exports.import_labels(spark, path, LABELS)
    bad = spark.range(40, numPartitions=4).select(F.lit("q").alias("query"), F.when(F.col("id") == 39, F.raise_error(F.lit("no text"))).otherwise("m").alias("mem"), F.col("id").alias("grade"))
    spark.dataSource.register(exports.LabelExport)
    write = lambda: bad.write.format("label_export").mode("overwrite").save(path)
    with pytest.raises(Exception, match="no text"):
        write()
    for _ in range(100):  # tasks that were still running when the job was given up clear their own files
        if not list((tmp_path / "out").glob("part-*")):
            break
        time.sleep(0.1)
    assert not (tmp_path / "out/manifest.json").exists() and not list((tmp_path / "out").glob("part-*"))
    good = spark.createDataFrame([("q", "m", 1)], LABELS)
    kept = exports.export_labels(good, path, "query")
    with pytest.raises(Exception, match="no text"):
        write()
    assert exports.read_manifest(path) == kept and exports.import_labels(spark, path, LABELS).count() == 1
    name = next(p["name"] for p in kept["files"] if p["rows"])
    (tmp_path / "out" / name).write_bytes(gzip.compress(json.dumps({"query": "other"}).encode()))
    with pytest.raises(ValueError, match="digest"):
        exports.import_labels(spark, path, LABELS)


def test_history(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id long, sect string, body string")
    loads = {
        10: [(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, None)],
        20: [(1, "a", "x"), (2, "a", "y2"), (3, "b", "z"), (4, None, None), (4, None, None)],
        30: [(1, "b", "x"), (2, "a", "y2"), (5, "c", "")],
        40: [(1, "b", "x"), (2, "a", "y2"), (5, "c", "")],
        50: [(2, "a", "y"), (4, None, None)],
    }
    table = versioned_table(frame([]), ("id",), "sect")
    assert table.as_of(99).count() == 0
    changed, files = {}, {}
    for time, rows in loads.items():
        changed[time] = table.load(frame(rows), time)
        files[time] = {f for r in table.places().collect() for f in glob.glob(f"{table.folder.removeprefix('file:').replace('//', '/')}/rows/{r.load}/place={r.place}/*.parquet")}
    assert changed == {10: 3, 20: 1, 30: 4, 40: 0, 50: 4}  # a repeated row changes nothing
    assert len(files[10] & files[20]) == 2 and files[30] == files[40]  # sections that stay keep their files
    for time, rows in loads.items():
        assert sorted(map(str, table.as_of(time + 5).collect())) == sorted({str(r) for r in frame(rows).collect()})
    assert table.as_of(9).count() == 0
    past = sorted((r.valid_from, r.valid_to, r.sect, r.body) for r in table.rows().filter("id = 2").collect())
    assert [p[:2] for p in past] == [(10, 20), (20, 50), (50, None)]
    only = table.load(frame([(2, "a", "new")]), 60, sections=frame([(0, "a", "")]))
    assert only == 1 and {r.id for r in table.as_of(60).collect()} == {2, 4}


def test_queue(spark, tmp_path):
    """A row that never works is given up after three attempts while later rows come; a restart handles nothing twice."""
    path, folder = f"file://{tmp_path}/queue", f"file://{tmp_path}/state"
    bad = lambda rows: rows.filter("payload = 'bad'").select("seq")
    seen = []
    run = lambda: queue.drain_stream(queue.queue_stream(spark, path), bad, folder, 3, lambda df, n: seen.append((n, sorted(r.seq for r in df.collect()))))
    state = lambda: {name: sorted((r.seq, *([r.attempts] if name != "handled" else [])) for r in getattr(queue.drained(spark, folder), name).read().collect()) for name in ("handled", "waiting", "dead")}
    queue.enqueue(path, [(i, "k", "bad" if i == 3 else f"p{i}") for i in range(5)])
    run()
    assert state() == {"handled": [(0,), (1,), (2,)], "waiting": [(3, 1), (4, 0)], "dead": []}
    queue.enqueue(path, [(5, "k", "p5")])
    run()
    assert state() == {"handled": [(0,), (1,), (2,)], "waiting": [(3, 2), (4, 0), (5, 0)], "dead": []}
    run()  # nothing new
    queue.enqueue(path, [(6, "k", "p6"), (7, "k", "p7")])
    run()
    assert state() == {"handled": [(0,), (1,), (2,)], "waiting": [(4, 0), (5, 0), (6, 0), (7, 0)], "dead": [(3, 3)]}
    queue.enqueue(path, [(8, "k", "p8")])
    run()
    want = {"handled": [(i,) for i in (0, 1, 2, 4, 5, 6, 7, 8)], "waiting": [], "dead": [(3, 3)]}
    assert state() == want
    last = max(n for n, _ in seen)
    for name in ("commits", "offsets"):
        assert (tmp_path / f"state/progress/{name}/{last}").exists()
    for name in (f"{last}", f".{last}.crc"):  # a crash after the tables were written, before the stream's commit
        (tmp_path / f"state/progress/commits/{name}").unlink()
    run()
    assert state() == want and seen[-1] == (last, [4, 5, 6, 7, 8])
