"""Replicas that exchange changesets, in any order and as often as they like."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written
from .merge import convergent_confidence, last_writer_wins, log_union, tombstones


@dataclass(frozen=True)
class Changeset:
    """What one node knows beyond another's vector: rows and deletions (id, ..., lamport, node), votes, and its own vector."""

    rows: DataFrame
    gone: DataFrame
    log: DataFrame
    vector: DataFrame


@dataclass(frozen=True)
class Replica:
    """One node's state.

    rows: (id, any values, lamport, node), the last writer's of each id; gone: (id, deleted_at, lamport, node), the
    earliest deletion; log: votes (log_uuid, id, direction, reason, lamport, node), only ever added to; vector: (node,
    lamport), the highest clock of each node whose changes are all here. clock: this node's Lamport clock.
    """

    name: str
    rows: DataFrame
    gone: DataFrame
    log: DataFrame
    vector: DataFrame
    clock: int = 0

    def changes(self, since: DataFrame) -> Changeset:
        """All that a node with the vector `since` (node, lamport) lacks; nodes that it has not heard of count from nothing."""
        old = since.select("node", F.col("lamport").alias("_since"))

        def newer(df: DataFrame) -> DataFrame:
            return df.join(old, "node", "left").filter(F.col("_since").isNull() | (F.col("lamport") > F.col("_since"))).select(*df.columns)

        return Changeset(newer(self.rows), newer(self.gone), newer(self.log), self.vector)

    def apply(self, change: Changeset) -> Replica:
        """The state after a changeset: later writers win (clock, then node), deletions and votes are united, the clock moves past all of it."""
        rows = last_writer_wins(self.rows.unionByName(change.rows), "id", "lamport", "node")
        gone = last_gone(self.gone.unionByName(change.gone))
        log = log_union(self.log, change.log)
        vector = self.vector.unionByName(change.vector).groupBy("node").agg(F.max("lamport").alias("lamport"))
        kept = [written(df, label) for df, label in ((rows, "rows"), (gone, "gone"), (log, "votes"), (vector, "vector"))]
        high = kept[3].agg(F.max("lamport")).first()[0] or 0
        return replace(self, rows=kept[0], gone=kept[1], log=kept[2], vector=kept[3], clock=max(self.clock, high) + 1)

    def write(self, rows: DataFrame | None = None, gone: DataFrame | None = None, log: DataFrame | None = None) -> Replica:
        """Own changes, without lamport and node: all of one write have the clock's next value."""
        stamp = lambda df: df.withColumn("lamport", F.lit(self.clock + 1).cast("long")).withColumn("node", F.lit(self.name))
        own = self.vector.limit(0).unionByName(self.vector.sparkSession.createDataFrame([(self.name, self.clock + 1)], "node string, lamport long"))
        none = self.changes(self.vector)
        return self.apply(Changeset(stamp(rows) if rows is not None else none.rows.limit(0), stamp(gone) if gone is not None else none.gone.limit(0), stamp(log) if log is not None else none.log.limit(0), own))

    def state(self) -> DataFrame:
        """rows with deleted_at (the earliest), and confidence and annotation by all votes."""
        return self.rows.join(tombstones(self.gone, "id"), "id", "left").join(convergent_confidence(self.log), "id", "left")


def last_gone(gone: DataFrame) -> DataFrame:
    """The earliest deletion of each id, whole; of equal ones the one with the lowest clock and node."""
    rest = [c for c in gone.columns if c != "id"]
    order: Column = F.struct("deleted_at", "lamport", "node")
    return gone.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("x")).select("id", *[F.col(f"x.{c}").alias(c) for c in rest])


def exchange(a: Replica, b: Replica) -> tuple[Replica, Replica]:
    """Both ways: each gets what it lacks of the other."""
    to_b, to_a = a.changes(b.vector), b.changes(a.vector)
    return a.apply(to_a), b.apply(to_b)
