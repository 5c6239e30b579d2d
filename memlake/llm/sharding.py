"""Uniform shuffle into shards of exact sizes.

Rows fall into P source parts by a hash. A communication matrix of P rows says how many rows each part sends to
each shard; its rows are drawn one after another from the multivariate hypergeometric law over the places still
free, which is the law of a uniform permutation. Each part permutes its rows and deals them out by its row of the
matrix; each shard permutes what it receives: rows take random keys, ranges of keys are permuted by themselves, and
a range's first slot is the number of rows in the ranges before it. So shard sizes and slots are exact. P grows
with the rows up to a bound on the matrix, which is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, twin_numbers

#: Populations from which on numpy does not draw.
_NUMPY_DRAWS = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among n drawn from good + bad. Large populations: by inverting the law around its mode.

    Probabilities are products of ratios of neighbours, and 16 standard deviations to each side are summed; what
    lies beyond is less than a double can tell.
    """
    if good + bad < _NUMPY_DRAWS:
        return int(rng.hypergeometric(good, bad, n))
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = 64 + int(16 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5)
    first, last = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(first, last, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))))])
    sums = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], side="right"))


def _deal(rng: np.random.Generator, free: np.ndarray, n: int) -> np.ndarray:
    """n rows into free places: halves of the places first, until numpy can draw the rest at once."""
    if len(free) == 1:
        return np.array([n], np.int64)
    if free.sum() < _NUMPY_DRAWS:
        return rng.multivariate_hypergeometric(free, n, method="marginals")
    half = len(free) // 2
    left = hypergeometric(rng, int(free[:half].sum()), int(free[half:].sum()), n)
    return np.concatenate([_deal(rng, free[:half], left), _deal(rng, free[half:], n - left)])


def communication_matrix(sent: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Counts from each part (rows: sent) to each shard (columns: places), drawn exactly, for any number of rows."""
    rng, free = np.random.default_rng(seed), places.astype(np.int64).copy()
    out = np.zeros((len(sent), len(places)), np.int64)
    for p, n in enumerate(sent):
        out[p] = _deal(rng, free, int(n))
        free -= out[p]
    return out


def _keyed(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def shuffle_into_shards(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 20, rows_per_part: int = 50_000, most_cells: int = 1 << 20) -> DataFrame:
    """df with `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard).

    Row counts of shards differ by one at most. `keys` name the columns that tell rows apart and decide a row's
    random keys: null keys are values like others, and rows alike in all keys are interchangeable, so a rerun
    gives the same result; where they would fill a part or a range, they are numbered, and the number is a key.
    Columns of df stay; it must not have shard or slot. most_cells: the matrix's size at
    most, parts by shards, and that of the table of ranges. No rows: an empty result.
    """
    cols, by, total = df.columns, [F.col(k) for k in [*keys, "_twin"]], df.count()
    parts = max(1, min(most_cells // shards, -(-total // rows_per_part)))
    runs = max(1, min(most_cells // shards, -(-total // (shards * rows_per_part))))
    df = twin_numbers(df, keys, max(2, rows_per_part // 8))
    dealt = df.withColumn("_part", F.pmod(_keyed(seed, *by), F.lit(parts)).cast("int"))
    sent = np.zeros(parts, np.int64)
    for r in dealt.groupBy("_part").count().toLocalIterator():  # most_cells / shards rows at most
        sent[r["_part"]] = r["count"]
    places = np.array([total // shards + (s < total % shards) for s in range(shards)])
    ends = df.sparkSession.sparkContext.broadcast(np.cumsum(communication_matrix(sent, places, seed), axis=1))

    @F.pandas_udf("int")
    def shard(part: pd.Series, rank: pd.Series) -> pd.Series:
        out, p, r = np.empty(len(part), np.int32), part.to_numpy(), rank.to_numpy()
        order = np.argsort(p, kind="stable")
        cuts = np.flatnonzero(np.append(True, p[order][1:] != p[order][:-1])) if len(p) else []
        for at in np.split(order, cuts[1:]) if len(p) else []:
            out[at] = np.searchsorted(ends.value[p[at[0]]], r[at], side="right")
        return pd.Series(out)

    local = Window.partitionBy("_part").orderBy(_keyed(seed + 1, *by), *by)
    dealt = dealt.withColumn("_rank", F.row_number().over(local) - 1).withColumn("shard", shard("_part", "_rank"))
    place = F.shiftrightunsigned(_keyed(seed + 2, *by), 32)  # 32 random bits; ranges of them are runs
    dealt = keep(dealt.withColumn("_run", F.shiftright(place * runs, 32).cast("int")).select(*cols, "_twin", "shard", "_run"), "dealt")
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # `runs` rows at most
    starts = dealt.groupBy("shard", "_run").agg(F.count("*").alias("n")).select("shard", "_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_run").orderBy(_keyed(seed + 2, *by), *by)
    slots = dealt.join(F.broadcast(starts), ["shard", "_run"]).withColumn("slot", F.col("_start") + F.row_number().over(own) - 1)
    return slots.select(*cols, "shard", F.col("slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contract columns of a `rows` sharding: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = keep(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32")), "sizes")
    done = shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"], shards)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
