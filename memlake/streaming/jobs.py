"""Structured Streaming jobs whose results equal the batch ones: windows, upserts, keyed state, late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.merge import last_writer_wins
from ..sources.storage import work_folder  # noqa: F401


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; times without a zone become times of the session's zone, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str) -> None:
    """Takes what is there in micro-batches, exactly once by batch number, and stops."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


class KeyedTable:
    """A table in parts by a hash of its key, each batch rewriting the parts that its keys fall into.

    A batch writes its parts under its number and then a list of every part's place. The list with the highest number
    holds, so a new process goes on where the last one ended. A batch that is tried again, even after its list was
    written, starts from the list before it and writes the same again: what that list names is only removed by the
    batch after. When the rows pass `part_rows` a part, a batch deals all of them into twice as many parts or more.
    """

    LIST = "part int, batch long, parts int, rows long"

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], parts: int = 16, part_rows: int = 1_000_000):
        self.spark, self.folder, self.schema, self.keys, self.parts, self.part_rows = spark, folder.rstrip("/"), schema, keys, parts, part_rows
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = spark._jvm.org.apache.hadoop.fs.Path

    def _lists(self) -> list[int]:
        at = self.path(f"{self.folder}/lists")
        names = [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and self.files.exists(self.path(f"{self.folder}/lists/{n}/_SUCCESS")))

    def places(self, below: int | None = None) -> list[Row]:
        """Each part's number, the batch that wrote it, the number of parts and its rows, by the last list, or the last one below a number."""
        known = [n for n in self._lists() if below is None or n < below]
        return self.spark.read.schema(self.LIST).json(f"{self.folder}/lists/{known[-1]}").collect() if known else []  # a row a part

    def _read(self, places: list[Row]) -> DataFrame:
        paths = [f"{self.folder}/rows/{r.batch}/_part={r.part}" for r in places if r.rows]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, below: int | None = None) -> DataFrame:
        """The rows, by the last list or by the last one below a batch number."""
        return self._read(self.places(below))

    def put(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], number: int) -> None:
        """merge(old, batch) takes the place of the parts that batch's keys fall into; it keeps their keys."""
        before = self.places(number)
        had, rows = (before[0].parts if before else self.parts), sum(r.rows for r in before)
        parts = had
        while rows > parts * self.part_rows:
            parts *= 2
        part = F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("int")
        batch = batch.persist()
        touched = {r.part for r in batch.select(part.alias("part")).distinct().collect()} if parts == had else set(range(parts))  # a number a part
        old = self._read([r for r in before if r.part in touched or parts != had])
        merge(old, batch).withColumn("_part", part).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/rows/{number}")
        batch.unpersist()
        written = self.spark.read.schema(StructType([*self.schema, StructField("_part", IntegerType())])).parquet(f"{self.folder}/rows/{number}") if touched else None
        counts = {r["_part"]: r["count"] for r in written.groupBy("_part").count().collect()} if touched else {}
        now = [(p, number, parts, counts.get(p, 0)) for p in touched] + [(r.part, r.batch, parts, r.rows) for r in before if parts == had and r.part not in touched]
        self.spark.createDataFrame(now, self.LIST).coalesce(1).write.mode("overwrite").json(f"{self.folder}/lists/{number}")
        kept = {n for _, n, _, _ in now} | {r.batch for r in before}
        at = self.path(f"{self.folder}/rows")
        for name in [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []:
            if name.isdigit() and int(name) not in kept and int(name) < number:
                self.files.delete(self.path(f"{self.folder}/rows/{name}"), True)
        for n in self._lists()[:-2]:
            self.files.delete(self.path(f"{self.folder}/lists/{n}"), True)


def upsert_stream(stream: DataFrame, key: str, lamport: str, node: str, folder: str) -> DataFrame:
    """Rows merged into a table, last writer first; order and retries of batches don't matter."""
    table = KeyedTable(stream.sparkSession, f"{folder}/table", stream.schema, [key])
    run_to_end(stream, lambda df, n: table.put(df, lambda old, new: last_writer_wins(old.unionByName(new), key, lamport, node), n), folder, "append")
    return table.read()


def replaced(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of a batch take the place of earlier ones with their keys."""
    return lambda old, new: old.join(new, keys, "left_anti").unionByName(new)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], length: str, slide: str, late: str, folder: str) -> DataFrame:
    """Counts per sliding window. Windows that a batch changes replace their earlier state."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), *keys).agg(F.count("*").alias("n"))
    rows = w.select(F.unix_timestamp("w.start").alias("start_s"), *keys, "n")
    both = ["start_s", *keys]
    table = KeyedTable(stream.sparkSession, f"{folder}/windows", rows.schema, both)
    run_to_end(rows, lambda df, n: table.put(df, replaced(both), n), folder, "update")
    return table.read()


def first_seen(stream: DataFrame, keys: list[str], ts: str, within: str, folder: str) -> DataFrame:
    """Rows without repeats of their keys inside the watermark. They are only appended, under each batch's number."""
    rows = stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
    run_to_end(rows, lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/seen/batch={n}"), folder, "append")
    return stream.sparkSession.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/seen")


def keyed(stream: DataFrame, key: str, columns: list[str], step: Callable, state: str, out: str, folder: str) -> DataFrame:
    """The last output row of each key of a keyed state: step(key, parts, state) yields rows of `out`."""
    rows = stream.select(key, *columns).groupBy(key).applyInPandasWithState(step, out, state, "update", "NoTimeout")
    table = KeyedTable(stream.sparkSession, f"{folder}/keyed", rows.schema, [key])
    run_to_end(rows, lambda df, n: table.put(df, replaced([key]), n), folder, "update")
    return table.read()


def streaks(stream: DataFrame, key: str, ts: str, kind: str, folder: str, cap: int | None = None) -> DataFrame:
    """Per key the number of rows, the current run of one kind, the longest run, and how many rows a cap held back.

    Within a batch rows are taken by time; across batches in the order of arrival. cap: rows of a run beyond it are
    counted as held back, as reminders of one kind are.
    """
    key_type = stream.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, best, n, held = state.get if state.exists else (None, 0, 0, 0, 0)
        for x in pd.concat(list(parts)).sort_values(ts, kind="stable")[kind]:
            run = run + 1 if x == last else 1
            last, best, n, held = x, max(best, run), n + 1, held + (cap is not None and run > cap)
        state.update((last, run, best, n, held))
        yield pd.DataFrame({key: [k[0]], "n": [n], "run": [run], "best": [best], "held": [held]})

    return keyed(stream, key, [ts, kind], step, "last string, run long, best long, n long, held long", f"{key} {key_type}, n long, run long, best long, held long", folder)


def topic_gate(stream: DataFrame, key: str, order: str, vector: str, folder: str, sticky: float = 0.80) -> DataFrame:
    """Per key how many searches ran and how many were skipped as being on the topic of the last one that ran.

    The anchor vector moves only when a search runs, so a slow drift can't skip for ever; a vector of another
    length or of no length never skips.
    """
    key_type = stream.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, ran, skipped = state.get if state.exists else (None, 0, 0)
        for v in pd.concat(list(parts)).sort_values(order, kind="stable")[vector]:
            if v is None:
                ran += 1
                continue
            a, b = np.array(anchor if anchor is not None else [], float), np.array(v, float)
            scale = float(np.linalg.norm(a) * np.linalg.norm(b)) if len(a) == len(b) else 0.0
            if scale > 0 and float(a @ b) / scale >= sticky:
                skipped += 1
            else:
                anchor, ran = b.tolist(), ran + 1
        state.update((anchor, ran, skipped))
        yield pd.DataFrame({key: [k[0]], "ran": [ran], "skipped": [skipped]})

    return keyed(stream, key, [order, vector], step, "anchor array<double>, ran long, skipped long", f"{key} {key_type}, ran long, skipped long", folder)


def drain(queue: DataFrame, order: str, handle: Callable[[DataFrame], DataFrame], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(handled, to try again, given up) of a queue (order, attempts, ...) taken in order.

    handle(rows) gives the `order` values it failed on. Rows from the first failure on wait; that one has an attempt
    more and is given up at `most` attempts, when the queue goes on behind it the next time.
    """
    failed = handle(queue).select(order)
    first = failed.agg(F.min(order).alias("_first"))
    marked = queue.crossJoin(F.broadcast(first))  # one row on the right
    done = marked.filter(F.col("_first").isNull() | (F.col(order) < F.col("_first"))).drop("_first")
    stuck = marked.filter(F.col(order) == F.col("_first")).withColumn("attempts", F.col("attempts") + 1).drop("_first")
    waiting = marked.filter(F.col(order) > F.col("_first")).drop("_first").unionByName(stuck.filter(F.col("attempts") < most))
    return done, waiting, stuck.filter(F.col("attempts") >= most)
