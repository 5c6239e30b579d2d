"""Exact comparison inside groups of rows, without all pairs of a large group.

A group of up to `block` rows is compared in one task. A larger one is dealt into parts of about that size, and each
part is compared together with one row of the whole group; rows that this links to the one row are done with each
other. What is left of the group, often little, then meets every part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, heavy_join, keep, slices

#: From a batch's rows and group numbers to the positions of links, those of a group from its first row on, breadth first.
Compare = Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray]]
_BY = ["near", "grp", "i", "j"]


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by `by` that end where a group ends, about `limit` bytes of a column each, with group numbers."""
    held: list[pa.RecordBatch] = []

    def numbered(batch: pa.RecordBatch) -> np.ndarray:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in by]
        return np.cumsum(np.append(False, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])))

    for batch in slices(batches, column, limit):
        held.append(batch)
        now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        group = numbered(now)
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield now.slice(0, end), group[:end]
        held = [now.slice(end)]
    if held:
        now = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield now, numbered(now)


def linked(member: DataFrame, sizes: DataFrame, payload: DataFrame, column: str, compare: Compare, limit: int, block: int = 256) -> DataFrame:
    """Links (a, b) between keys that join what the pairs of a group that `compare` finds alike join.

    member: (grp, key), a written table; sizes: (grp, n, near) of all its groups; payload: (key, column), a written
    table. Groups with the same `near` lie side by side, so `compare` can share its work for keys that they share.
    """
    kind, key_kind = (dict(member.dtypes)[k] for k in ("grp", "key"))
    parts = F.ceil(F.col("n") / block)
    # What many groups have for `near` would be one hot key: its groups are dealt among as many as their rows need.
    rows = sizes.groupBy("near").agg(F.sum("n").alias("rows"), F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("grp"), F.ceil(F.col("rows") / (4 * block)))
    sizes = keep(heavy_join(sizes, rows.select("near", "rows"), "near", counts=rows).select("grp", "n", F.struct("near", salt.alias("salt")).alias("near")), "group-sizes")
    sized = keep(heavy_join(member, sizes, "grp", counts=sizes).select("near", "grp", "key", F.when(F.col("n") > block, parts).otherwise(0).alias("parts")), "sized").withColumn("i", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("key"), "parts")).otherwise(0))
    large = sized.filter("parts > 0")
    one = large.groupBy("near", "grp").agg(F.min("key").alias("key"), F.first("parts").alias("parts"))
    one = one.select("near", "grp", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(True).alias("one"))
    nil = F.lit(-1).cast("long").alias("j")
    first = keep(sized.select("near", "grp", "key", "i", nil, F.lit(False).alias("one")).unionByName(one.select("near", "grp", "key", "i", nil, "one")), "first-blocks")

    def meet(rows: DataFrame, again: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, group in whole_groups(batches, _BY[1:], column, limit):
                a, b = compare(batch, group)
                keys, grp = batch.column("key"), batch.column("grp")
                none = pa.nulls(len(a), grp.type)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(a)), keys.take(pa.array(b)), none], ["a", "b", "grp"])
                ones = batch.column("one").to_numpy(zero_copy_only=False)
                if again or not ones.any():
                    continue
                tree = np.arange(len(group))
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    tree[y] = tree[x]  # a link comes after the one that reached its first row
                top = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[group]
                rest = np.flatnonzero(ones[top] & (tree != top) & ~ones)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rest)), pa.nulls(len(rest), keys.type), grp.take(pa.array(rest))], ["a", "b", "grp"])
            give_back()

        held = heavy_join(rows, payload, "key").repartition("near", "i", "j").sortWithinPartitions(*_BY, F.desc("one"), "key")
        return held.select("grp", "i", "j", "one", "key", column).mapInArrow(run, f"a {key_kind}, b {key_kind}, grp {kind}")

    found = keep(meet(first, False), "first-links")
    rest = found.filter("b IS NULL").select("grp", F.col("a").alias("key")).distinct()
    left = keep(rest.groupBy("grp").agg(F.ceil(F.count("*") / block).alias("rest_parts")), "rest-sizes")
    large_sizes = sizes.filter(F.col("n") > block).select("near", "grp", parts.alias("parts"))
    rest = rest.join(large_sizes.join(left, "grp"), "grp").select("near", "grp", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.pmod(F.xxhash64(F.lit(1), "key"), "rest_parts").alias("j"))
    all_of = heavy_join(large, left, "grp", counts=sizes).select("near", "grp", "key", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_parts") - 1)).alias("j"))
    second = keep(rest.unionByName(all_of).distinct().withColumn("one", F.lit(False)), "second-blocks")
    return found.filter("b IS NOT NULL AND a <> b").select("a", "b").unionByName(meet(second, True).select("a", "b"))
