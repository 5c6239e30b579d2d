"""An ordered queue as a stream source, drained into a table with retries and dead letters."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources.exports import place
from .jobs import KeyedTable, drain, run_to_end

#: Rows of a queue: their order, what they are, and a JSON payload.
SCHEMA = "seq long, kind string, payload string"


@dataclass
class Piece(InputPartition):
    """Rows with seq above `low`, up to `high`, of one file."""

    name: str
    low: int
    high: int


class QueueReader(DataSourceStreamReader):
    """Offsets are sequence numbers. A file of the queue is named first-last.jsonl after the numbers that it holds, so plans need names only."""

    def __init__(self, path: str, most: int) -> None:
        self.path, self.most = path, most

    def _files(self) -> list[tuple[int, int, str]]:
        files, base = place(self.path)
        names = [i.base_name for i in files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)) if i.base_name[:1].isdigit() and i.base_name.endswith(".jsonl")]
        return sorted((int(a), int(b), f"{a}-{b}.jsonl") for a, b in (n.removesuffix(".jsonl").split("-") for n in names))

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"seq": -1}

    def latestOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"seq": max((b for _, b, _ in self._files()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        low, high = start["seq"], end["seq"]
        return [Piece(name, max(low, at), min(high, at + self.most)) for a, b, name in self._files() if b > low and a <= high for at in range(max(a - 1, low), min(b, high), self.most)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        files, base = place(self.path)
        with files.open_input_stream(f"{base}/{partition.name}") as f:
            for line in f.read().decode().splitlines():
                row = json.loads(line)
                if partition.low < row["seq"] <= partition.high:
                    yield row["seq"], row.get("kind"), row.get("payload")

    def commit(self, end: dict) -> None:
        """Files stay; the producer clears what lies behind the stream's offset."""


class QueueSource(DataSource):
    """spark.readStream.format("ordered_queue"): load(path); option rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "ordered_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> QueueReader:  # noqa: N802  Spark's name
        return QueueReader(self.options["path"], int(self.options.get("rows_per_task", 100_000)))


def enqueue(path: str, rows: list[tuple[int, str, str]]) -> None:
    """One producer's rows (seq, kind, payload) as the queue's next file, which appears whole."""
    files, base = place(path)
    files.create_dir(base, recursive=True)
    name = f"{rows[0][0]}-{rows[-1][0]}.jsonl"
    with files.open_output_stream(f"{base}/.{name}") as out:
        out.write("".join(json.dumps(dict(zip(("seq", "kind", "payload"), r))) + "\n" for r in rows).encode())
    files.move(f"{base}/.{name}", f"{base}/{name}")


def queue_stream(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("ordered_queue").load(path)


@dataclass(frozen=True)
class Drained:
    """Three tables in a folder: what was handled, what waits (with its attempts), and what was given up."""

    handled: KeyedTable
    waiting: KeyedTable
    dead: KeyedTable


def drained(spark: SparkSession, folder: str) -> Drained:
    rows = spark.createDataFrame([], SCHEMA).schema
    tried = spark.createDataFrame([], SCHEMA + ", attempts long").schema
    return Drained(*(KeyedTable(spark, f"{folder}/{name}", kind, ["seq"], parts=8) for name, kind in (("handled", rows), ("waiting", tried), ("dead", tried))))


def drain_stream(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], folder: str, most: int = 3, then: Callable[[DataFrame, int], None] | None = None) -> Drained:
    """Takes a queue's rows in order: each batch is what waits and what is new, up to the first row that handle fails on.

    handle(rows) gives the `seq` of those it can't take; then(rows, batch number) merges those it can, and must give
    the same when a batch is tried again (KeyedTable.put does). A failed row has an attempt more; after `most` it goes to
    the dead letters and the queue goes on behind it. All tables are written under the batch's number and read as the
    batch before left them, so each row is handled once, whatever is tried again.
    """
    out = drained(stream.sparkSession, folder)

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.select("seq", "kind", "payload", F.lit(0).cast("long").alias("attempts"))
        queue = out.waiting.read(number).unionByName(fresh).persist()
        done, wait, dead = drain(queue, "seq", handle, most)
        if then is not None:
            then(done.drop("attempts"), number)
        out.handled.put(done.drop("attempts"), lambda old, new: old.join(new, "seq", "left_anti").unionByName(new), number)
        out.dead.put(dead, lambda old, new: old.join(new, "seq", "left_anti").unionByName(new), number)
        # Every row that was in the queue names its part; those that wait still take the part's place.
        out.waiting.put(queue, lambda old, new: new.drop("attempts").join(wait.select("seq", "attempts"), "seq"), number)
        queue.unpersist()

    run_to_end(stream, step, folder, "append")
    return out


def enqueue_rows(rows: DataFrame, path: str) -> None:
    """rows (seq, kind, payload) as queue files, one for each range of numbers; a task tried again writes the same file."""

    def write(part: Iterator) -> None:
        held = [(r.seq, r.kind, r.payload) for r in part]
        if held:
            enqueue(path, held)

    rows.select("seq", "kind", "payload").repartitionByRange("seq").sortWithinPartitions("seq").foreachPartition(write)
