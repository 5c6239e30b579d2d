"""Merging changes: last-writer-wins rows, log unions, convergent counters, tombstones, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import saturated_confidence


def last_writer_wins(rows: DataFrame, key: str, lamport: str = "lamport", node: str = "node") -> DataFrame:
    """M2: of each key the whole row with the greatest (lamport, node). One partial aggregation, any order of input."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(lamport, node)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def apply_changes(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Stored rows with changes merged in; an equal or older change is ignored."""
    return last_writer_wins(stored.unionByName(changes), key)


def log_union(stored: DataFrame, incoming: DataFrame, uuid: str = "log_uuid") -> DataFrame:
    """M3: an append-only log with what is new by uuid."""
    return stored.unionByName(incoming.join(stored.select(uuid), uuid, "left_anti").dropDuplicates([uuid]))


def convergent_confidence(log: DataFrame, key: str = "id") -> DataFrame:
    """M4: (key, confidence, annotation) from votes (key, direction, reason, lamport, log_uuid), in any order.

    A vote `+` moves towards 1; `-` changes nothing; the last `-!` leaves its reason.
    """
    strong = F.when(F.col("direction") == "-!", F.struct("lamport", "log_uuid"))
    sums = log.groupBy(key).agg(F.count_if(F.col("direction") == "+").alias("ups"), F.max_by("reason", strong).alias("annotation"))
    return sums.select(key, F.round(saturated_confidence(F.col("ups")), 9).alias("confidence"), "annotation")


def tombstones(rows: DataFrame, key: str, deleted_at: str = "deleted_at") -> DataFrame:
    """M5: the earliest deletion of each key."""
    return rows.groupBy(key).agg(F.min(deleted_at).alias(deleted_at))


def changeset(rows: DataFrame, marks: DataFrame, me: str, most: int) -> DataFrame:
    """M1: this node's public rows above the peer's watermark, oldest first."""
    seen = marks.select(F.col("node").alias("_node"), F.col("lamport").alias("_mark"))
    new = rows.filter((F.col("node") == me) & (F.col("visibility") != "private")).join(F.broadcast(seen), F.col("node") == F.col("_node"), "left")
    return new.filter(F.col("lamport") > F.coalesce("_mark", F.lit(-1))).drop("_node", "_mark").orderBy("lamport", "id").limit(most)


def watermarks(rows: DataFrame) -> DataFrame:
    """M6: the highest lamport seen of each node."""
    return rows.groupBy("node").agg(F.max("lamport").alias("lamport"))


def fingerprint(*parts: Column) -> Column:
    """M9: SHA-256 over parts; nulls differ from empty strings, and no joint of parts can be mistaken."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256)


def changed_units(now: DataFrame, cached: DataFrame, keys: list[str], mark: str = "fingerprint") -> DataFrame:
    """M9: keys with how their fingerprints compare: new, changed, same or gone."""
    old = cached.select(*keys, F.col(mark).alias("_old"))
    both = now.select(*keys, F.col(mark).alias("_new")).join(old, keys, "full")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return both.select(*keys, state.alias("state"))


def history(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """M8: the replaced contents of rows whose content changed."""
    new = after.select(key, F.col(content).alias("_new"))
    return before.join(new, key).filter(~F.col(content).eqNullSafe(F.col("_new"))).select(key, content)


def next_lamport(rows: DataFrame) -> DataFrame:
    """M7."""
    return rows.agg((F.coalesce(F.max("lamport"), F.lit(0)) + 1).alias("lamport"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def rekeyed(pairs: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs under other names (id, uuid); pairs with an unknown id are left out."""
    for k in keys:
        pairs = pairs.join(names.select(F.col("id").alias(k), F.col("uuid").alias("_name")), k).withColumn(k, F.col("_name")).drop("_name")
    return pairs
