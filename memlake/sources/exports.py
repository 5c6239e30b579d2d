"""Label files to travel: compressed JSON lines whose manifest is published last, with counts and digests."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    path = "file://" + path.removeprefix("file://").removeprefix("file:") if path.startswith(("file:", "/")) else path
    files, inner = pyarrow.fs.FileSystem.from_uri(path)
    return files, inner.rstrip("/")


@dataclass
class Part(WriterCommitMessage):
    """What a task has written."""

    name: str
    rows: int
    bytes: int
    sha256: str


class _Counted:
    """A stream that hashes and counts what goes through it."""

    def __init__(self, out: pa.NativeFile) -> None:
        self.out, self.size, self.hash = out, 0, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        self.hash.update(data)
        return len(data)

    def flush(self) -> None:
        return


class LabelWriter(DataSourceArrowWriter):
    """One file a task, streamed; nothing counts until the driver has written the manifest of all files."""

    def __init__(self, path: str, facts: dict, overwrite: bool) -> None:
        self.path, self.facts, self.overwrite, self.job = path, facts, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, base = place(self.path)
        task = TaskContext.get()
        name, rows = f"part-{self.job}-{task.partitionId():05d}-{task.attemptNumber()}.jsonl.gz", 0
        files.create_dir(base, recursive=True)
        done = False
        try:
            with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                counted = _Counted(out)
                with gzip.GzipFile(fileobj=counted, mode="wb", mtime=0) as lines:
                    for batch in iterator:
                        rows += batch.num_rows
                        lines.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()).encode())
            done = files.get_file_info(f"{base}/{self._mark()}").type == pyarrow.fs.FileType.NotFound
        finally:
            if not done:  # it failed, or the job was given up meanwhile
                files.delete_file(f"{base}/{name}")
        return Part(name, rows, counted.size, counted.hash.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        """The manifest, moved to its place as one file, then what an overwritten export had."""
        files, base = place(self.path)
        parts = sorted((asdict(m) for m in messages if m is not None), key=lambda p: p["name"])
        before = read_manifest(self.path)
        if before and not self.overwrite:
            parts = before["files"] + parts
        manifest = {"schema_version": 1, "rows": sum(p["rows"] for p in parts), "files": parts, **self.facts}
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/.{MANIFEST}-{self.job}") as out:
            out.write(json.dumps(manifest, indent=1).encode())
        files.move(f"{base}/.{MANIFEST}-{self.job}", f"{base}/{MANIFEST}")
        self._clear({p["name"] for p in parts})

    def abort(self, messages: list[Part | None]) -> None:
        """Takes away whatever this job's tasks have written; those that still run see a mark and do so themselves. An earlier export stays as it was."""
        files, base = place(self.path)
        files.create_dir(base, recursive=True)
        files.open_output_stream(f"{base}/{self._mark()}").close()
        before = read_manifest(self.path)
        self._clear({p["name"] for p in before["files"]} if before else set(), self.job)

    def _mark(self) -> str:
        return f".given-up-{self.job}"

    def _clear(self, named: set[str], job: str = "") -> None:
        files, base = place(self.path)
        for info in files.get_file_info(pyarrow.fs.FileSelector(base, allow_not_found=True)):
            if (info.base_name.startswith(f"part-{job}") and info.base_name not in named) or (not job and info.base_name.startswith(".given-up-")):
                files.delete_file(info.path)


class LabelExport(DataSource):
    """df.write.format("label_export"): options path (or save(path)) and facts (JSON that the manifest takes up)."""

    @classmethod
    def name(cls) -> str:
        return "label_export"

    def writer(self, schema: StructType, overwrite: bool) -> LabelWriter:
        return LabelWriter(self.options["path"], json.loads(self.options.get("facts", "{}")), overwrite)


def read_manifest(path: str) -> dict | None:
    files, base = place(path)
    if files.get_file_info(f"{base}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def label_counts(rows: DataFrame, query: str) -> dict:
    """What decides an export's worth: labels, distinct queries, labels a query, and queries with one label, which make no pairs."""
    each = rows.groupBy(query).agg(F.count("*").alias("n"))
    x = each.agg(F.count("*").alias("q"), F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("one")).first()
    return {"labels": x.n or 0, "distinct_queries": x.q, "labels_per_query": round((x.n or 0) / x.q, 2) if x.q else 0, "single_label_queries": x.one or 0, "pairable_queries": x.q - (x.one or 0)}


def export_labels(rows: DataFrame, path: str, query: str) -> dict:
    """rows as an export that replaces the one at path; gives its manifest. A task that fails leaves the earlier one."""
    rows.sparkSession.dataSource.register(LabelExport)
    rows.write.format("label_export").mode("overwrite").option("facts", json.dumps({"counts": label_counts(rows, query)})).save(path)
    return read_manifest(path)


def import_labels(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of the files that the manifest names, after their digests have been checked; another digest is an error."""
    manifest = read_manifest(path)
    if manifest is None:
        raise FileNotFoundError(f"{path} has no {MANIFEST}")
    listed = spark.createDataFrame([(p["name"], p["bytes"], p["sha256"]) for p in manifest["files"]], "name string, bytes long, sha256 string")
    read = spark.read.format("binaryFile").load([f"{path}/{p['name']}" for p in manifest["files"]]) if manifest["files"] else None
    if read is not None:
        found = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
        wrong = [r.name for r in listed.join(found, "name", "left").filter("NOT (sha256 <=> found)").limit(20).collect()]
        if wrong:
            raise ValueError(f"files with another digest than the manifest's: {wrong}")
    paths = [f"{path}/{p['name']}" for p in manifest["files"] if p["rows"]]
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)
