"""Clusters, contradiction candidates, duplicate groups, upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import direction_mismatch
from ..params import DEFAULTS, Params
from ..sources.storage import written
from .positions import every_nth, numbered
from .retrieval import similarity_join


def duplicate_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Groups of more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def star_clusters(edges: DataFrame, least: int = DEFAULTS.cluster_least, most: int = DEFAULTS.cluster_most, small: int = 200_000, rounds: int = 1000) -> DataFrame:
    """Greedy clusters (seed, id) from similarity edges (a, b), a < b. Not transitive.

    In id order a node that no seed has taken becomes a seed and takes its free later neighbours, `most` rows at
    most. A node with no undecided node before it among its neighbours is a seed, and takes a later one at once if
    that has none before the seed and is among as many undecided ones as the seed has room for. A round decides all
    such pairs; what is left after some, `small` edges at most, is walked in one task.
    """
    kind = edges.schema["a"].dataType.simpleString()
    left, found = written(edges.select("a", "b").distinct().withColumn("room", F.lit(most - 1).cast("long")), "edges"), None

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(part["a"], part["b"], strict=True):
            near.setdefault(a, []).append(b)
        room, taken, out = dict(zip(part["a"], part["room"], strict=True)), set(), []
        for seed in sorted(near):
            if seed not in taken:
                got = [x for x in sorted(near[seed]) if x not in taken][: room[seed]]
                taken.update(got)
                out += [(seed, x) for x in got]
        return pd.DataFrame(out, columns=["seed", "id"])

    for _ in range(rounds):
        if left.count() <= small:
            rest = left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(walk, f"seed {kind}, id {kind}")
            found = written(rest if found is None else found.unionByName(rest), "stars")
            found = found.unionByName(found.select("seed", F.col("seed").alias("id")).distinct())
            return found.withColumn("_n", F.count("*").over(Window.partitionBy("seed"))).filter(F.col("_n") >= least).drop("_n")
        first = left.groupBy("b").agg(F.min("a").alias("first"))
        nth = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        seeds = left.join(first.select(F.col("b").alias("a")), "a", "left_anti").withColumn("nth", nth).filter(F.col("nth") <= F.col("room"))
        now = written(seeds.join(first, "b").filter(F.col("first") == F.col("a")).select(F.col("a").alias("seed"), F.col("b").alias("id")), "stars")
        free = left.join(now.select(F.col("id").alias("a")), "a", "left_anti").join(now.select(F.col("id").alias("b")), "b", "left_anti")
        used = now.groupBy(F.col("seed").alias("a")).agg(F.count("*").alias("used"))
        free = free.join(used, "a", "left").select("a", "b", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"))
        left = written(free.filter("room > 0"), "edges")
        found = now if found is None else found.unionByName(now)
    raise RuntimeError("stars did not settle")


def contradiction_pairs(rows: DataFrame, least: float = DEFAULTS.contradiction, most: int = DEFAULTS.contradiction_pairs, assessed: DataFrame | Column | None = None) -> DataFrame:
    """Pairs (a, b, similarity, same_topic) worth a check, those of one kind and topic first, then by similarity.

    rows: (id, kind, topic, embedding). assessed: pairs (a, b) to leave out, or a condition on a and b that holds for
    them. Both tiers are similarity joins in tiles. Pairs of other topics fill what the first tier leaves of `most`, by
    every n-th over the range of similarities; where it leaves nothing, they aren't looked for.
    """
    order = [F.round("similarity", 9).desc(), F.col("a"), F.col("b")]

    def open_(pairs: DataFrame) -> DataFrame:
        if isinstance(assessed, Column):
            return pairs.filter(~F.coalesce(assessed, F.lit(False)))
        return pairs if assessed is None else pairs.join(assessed.select("a", "b"), ["a", "b"], "left_anti")

    same = open_(similarity_join(rows, least, by=("kind", "topic"))).withColumn("same_topic", F.lit(True))
    same = written(same.orderBy(*order).limit(most), "pairs")
    room = most - same.count()
    if room:
        other = open_(similarity_join(rows, least, apart=("kind", "topic"))).withColumn("same_topic", F.lit(False))
        same = same.unionByName(every_nth(other, order, room))
    return same.orderBy(F.desc("same_topic"), *order)


def unassessed(clusters: DataFrame, assessed: DataFrame) -> DataFrame:
    """(seed, id) of clusters of which some pair was not assessed. assessed: (a, b), a < b."""
    left, right = clusters.withColumnRenamed("id", "a"), clusters.withColumnRenamed("id", "b")
    pairs = left.join(right, "seed").filter("a < b")  # a cluster has few members
    open_ = pairs.join(assessed.select("a", "b"), ["a", "b"], "left_anti").select("seed").distinct()
    return clusters.join(open_, "seed", "left_semi")


def entailed(clusters: DataFrame, scores: DataFrame, least: float = 0.7) -> DataFrame:
    """(seed, id) of members that entail another member and are entailed by it; two at least stay in a cluster.

    scores: (a, b, score) of a entailing b, in both directions.
    """
    back = scores.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("score").alias("back"))
    both = scores.join(back, ["a", "b"]).filter((F.col("score") >= least) & (F.col("back") >= least)).select("a", "b")
    left, right = clusters.withColumnRenamed("id", "a"), clusters.withColumnRenamed("id", "b")
    kept = left.join(both, "a").join(right, ["seed", "b"]).filter("a <> b").select("seed", F.col("a").alias("id")).distinct()
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy("seed"))).filter("_n >= 2").drop("_n")


def merged_clusters(clusters: DataFrame, records: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """C4: (new rows, archived sources): of each cluster a new row from its newest record; sources point to it.

    records: (id, content, confidence, updated_at, archived_reason, ...). New ids follow the clusters' order.
    """
    order = Window.partitionBy("seed").orderBy(F.desc("updated_at"), F.desc("id"))
    held = clusters.join(records, "id").withColumn("_r", F.row_number().over(order))
    names = numbered(clusters.select("seed").distinct(), [F.col("seed")], "_nth").select("seed", (F.col("_nth") + next_id).alias("_new"))
    cols = [c for c in records.columns if c != "id"]
    new = held.filter("_r = 1").join(names, "seed").select(F.col("_new").alias("id"), *cols)
    reason = F.concat(F.lit("consolidated:"), F.col("_new").cast("string"))
    old = held.join(names, "seed").withColumn("archived_reason", reason).withColumn("confidence", F.lit(0.0)).select(*records.columns)
    return new, old


def assessments(clusters: DataFrame, merged: DataFrame, failed: DataFrame, known: DataFrame) -> DataFrame:
    """The cache of assessed pairs (a, b, verdict) after a run: merged clusters' pairs are `consolidated`, others'
    `no_entailment`, and those whose summary failed stay out. A pair's last verdict counts.
    """
    left, right = clusters.withColumnRenamed("id", "a"), clusters.withColumnRenamed("id", "b")
    pairs = left.join(right, "seed").filter("a < b").join(failed.select("seed"), "seed", "left_anti").join(merged.select("seed", F.lit("consolidated").alias("verdict")).distinct(), "seed", "left")
    new = pairs.select("a", "b", F.coalesce("verdict", F.lit("no_entailment")).alias("verdict")).distinct()
    return new.unionByName(known.join(new, ["a", "b"], "left_anti"))


def contradicted(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs whose greater contradiction score of both directions (fwd, rev) is `least` or more."""
    return pairs.filter(F.greatest("fwd", "rev") >= least)


def superseded(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records with the reason of what replaced them. pairs: (old, new); the newest replacement counts."""
    by = pairs.groupBy(F.col("old").alias("id")).agg(F.max("new").alias("_new"))
    reason = F.when(F.col("_new").isNotNull(), F.concat(F.lit("superseded by #"), F.col("_new").cast("string"))).otherwise(F.col("archived_reason"))
    return records.join(by, "id", "left").withColumn("archived_reason", reason).drop("_new")


def negation_candidates(pairs: DataFrame, a_text: str, b_text: str, same_topic: str, same: float = 0.5, cross: float = 0.8) -> DataFrame:
    """Pairs similar enough for their tier whose texts turn against each other."""
    enough = F.when(F.col(same_topic), F.col("similarity") >= same).otherwise(F.col("similarity") >= cross)
    return pairs.filter(enough & direction_mismatch(F.col(a_text), F.col(b_text)))


def upsert_decision(similarity: Column, same_key: Column, negated: Column, p: Params = DEFAULTS) -> Column:
    """What becomes of a new row, by its nearest stored row and whether that has its kind and topic."""
    return F.when(same_key & (similarity < p.variant), "variant").when(same_key, "supersede").when(similarity >= p.dedup, "duplicate").when((similarity >= p.negation_floor) & negated, "annotate").otherwise("insert")


def batches_by_size(rows: DataFrame, group: str, order: str, size: str, most_rows: int = 10, most_size: int = 6000, head: int = 400, each: int = 120) -> DataFrame:
    """Rows of a group, in order, with batch numbers: a batch closes before it has too many rows or characters."""
    item = F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cost = x["s"] + each
        full = (acc["n"] > 0) & ((acc["n"] >= most_rows) | (acc["c"] + cost > most_size))
        b = acc["b"] + full.cast("int")
        return F.struct(b.alias("b"), (F.when(full, 0).otherwise(acc["n"]) + 1).alias("n"), (F.when(full, F.lit(head).cast("long")).otherwise(F.when(acc["n"] == 0, F.lit(head).cast("long")).otherwise(acc["c"])) + cost).alias("c"), F.concat(acc["out"], F.array(b)).alias("out"))

    listed = rows.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("all"))
    numbered = listed.select(group, F.arrays_zip(F.col("all.o").alias("o"), F.aggregate("all", start, step, lambda a: a["out"]).alias("b")).alias("z"))
    return numbered.select(group, F.inline("z")).toDF(group, order, "batch")
