"""Helpers that the training-data operators share: written tables, Arrow batches, word splitting."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute available
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than ASCII white space.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The same for Spark's regular expressions.
WORD_SQL = r"[^\x20\x09-\x0D]+"


#: The fresh folder of each local application without spark.checkpoint.dir, which can't be set in a running session.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="memlake-")
    return _LOCAL[app]


def keep(df: DataFrame, label: str, level: int = 3) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/memlake/{uuid.uuid4().hex}-{label}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def heavy_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, least: int = 1000, most: int = 1024) -> DataFrame:
    """left.join(right, key, how) for inner, left and left_semi joins, with the commonest keys of left joined on the map side.

    right has one row a key at most. Keys with `least` or more rows in left, the `most` commonest of them, have
    their rows of right broadcast (`most` rows at most), so left's rows of a hot key stay where they are; all
    other keys are joined by shuffling. counts: (key, n) of left's keys, where it is known already. left is read
    three times, so it should be a written table. Null keys join nothing.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts.select(key, "n")
    heavy = counts.filter((F.col("n") >= least) & F.col(key).isNotNull()).orderBy(F.desc("n"), key).limit(most).select(key)
    light = left.join(F.broadcast(heavy), key, "left_anti").join(right, key, how)
    hot = left.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), key, "left_semi")), key, how)
    return light.unionByName(hot)


def twin_numbers(rows: DataFrame, keys: list[str], least: int, into: str = "_twin", most: int = 1024) -> DataFrame:
    """rows with a number (long) that tells rows alike in all keys apart: 0, 1, ... where `least` or more are alike, else 0.

    Only the `most` commonest combinations are numbered, so any other has rows / most rows at most. Their counts are
    summed on the map side; each partition numbers its own, and begins where those before it ended. Which of the alike
    rows gets which number is open, so a hash of the keys and the number gives the same rows in each run. rows should
    be a written table.
    """
    key = F.xxhash64(*keys)
    heavy = rows.groupBy(key.alias("_alike")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).orderBy(F.desc("_n"), "_alike").limit(most).select("_alike")
    heavy = keep(heavy, "twins")
    if heavy.isEmpty():
        return rows.withColumn(into, F.lit(0).cast("long"))
    marked = rows.withColumn("_alike", key)
    hot = marked.join(F.broadcast(heavy), "_alike", "left_semi").withColumn("_from", F.spark_partition_id())
    hot = keep(hot.withColumn("_at", F.row_number().over(Window.partitionBy("_alike", "_from").orderBy("_alike")) - 1), "twins-here")
    before = Window.partitionBy("_alike").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = hot.groupBy("_alike", "_from").agg(F.count("*").alias("_n")).select("_alike", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    hot = hot.join(starts, ["_alike", "_from"]).withColumn(into, (F.col("_start") + F.col("_at")).cast("long"))
    light = marked.join(F.broadcast(heavy), "_alike", "left_anti").withColumn(into, F.lit(0).cast("long"))
    return light.unionByName(hot.select(*light.columns)).drop("_alike")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of a few megabytes where the session doesn't say otherwise: both sides of a Python worker hold some."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", str(64 << 20)):
        spark.conf.set(name, size)


def with_utf8(docs: DataFrame, *ids: str, text: str = "text") -> DataFrame:
    """The id columns and the text's UTF-8 bytes (null: empty) as `utf8`; no other column is read."""
    small_batches(docs.sparkSession)
    return docs.select(*ids, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("utf8"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "utf8", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds about `limit` bytes of the column, or one row if that is longer."""
    for batch in batches:
        at, held = 0, 0
        for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
            if i > at and held + n > limit:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def sorted_set(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; sorting beats the hash table that numpy's unique takes here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def give_back() -> None:
    """Returns freed memory to the system: Python workers are reused, and what they hold counts for their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
