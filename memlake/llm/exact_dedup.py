"""Exact deduplication with a split for heavy hitters.

Texts are equal when identical after lower-casing A-Z. Misra-Gries summaries of each partition's digests,
merged, name at most `counters` candidates, among them every digest with over 2/(counters + 1) of the rows.
Their exact winners are counted in a second pass and broadcast (at most `counters` rows), so copies of a heavy
text are resolved on the map side and never shuffled; all other digests go through one ordinary shuffle.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import keep, with_utf8


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [hashlib.sha256(x.as_py().lower()).digest() for x in batch.column("utf8")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "digest"])


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One summary of a partition's digests: each count is too low by rows/(counters + 1) at most."""
    held: Counter[bytes] = Counter()
    for batch in batches:
        held.update(batch.column(0).to_pylist())
        if len(held) > counters:
            less = sorted(held.values(), reverse=True)[counters]
            held = Counter({k: n - less for k, n in held.items() if n > less})
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "n"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the largest id stays; a null id is below all others,
    and of repeated rows with one id a single one stays. Other columns are ignored. No rows: an empty result.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("digest", T.BinaryType())])
    rows = keep(with_utf8(docs, F.col(id_col).alias("id"), text=text_col).mapInArrow(_digests, schema).withColumn("row", F.monotonically_increasing_id()), "digests")
    summaries = rows.select("digest").mapInArrow(lambda b: misra_gries(b, counters), "digest binary, n long")
    candidates = summaries.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    winner = F.max(F.struct("id", "row")).alias("top")
    heavy = keep(rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("size"), winner).filter("size > 1"), "heavy")
    light = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    each = Window.partitionBy("digest")
    light = light.select("digest", "id", "row", F.count("*").over(each).alias("size"), F.max(F.struct("id", "row")).over(each).alias("top"))
    both = rows.join(F.broadcast(heavy), "digest").select(*light.columns).unionByName(light)
    return both.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), F.col("size").cast("long").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
