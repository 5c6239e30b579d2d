"""Mixing sources to target weights by entropy balancing, in DataFrame expressions only.

A document may be taken zero, one or two times. Among the laws of these copies, a fair draw of each of the two
copies is the base; the law closest to it whose expected words per source equal the source's target tilts it by
exp(lambda * words): the expected copies are 2 / (1 + exp(-lambda * words / scale)). The convex dual has one
lambda per source. Newton steps, kept inside a bracket, solve all sources at once; each step is one distributed
sum over a table of (source, words, documents), which is all that the dual needs. Expected copies are then
rounded by systematic selection, by falling size, in buckets of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import numbered
from .shared import WORD_SQL, keep, twin_numbers


def _source_key(source: Column) -> Column:
    """The source as a key that joins nulls as well."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), most_steps: int = 200) -> DataFrame:
    """sources (source, source_size, ...) with target: `share` of all sizes, dealt by repeating weights up to `cap` times a size.

    Sources come by code point, null last. The level, what a weight of 1 gets, starts as if no source were full;
    what full ones can't take raises it for the others, until no other source is full. Each step is a sum over
    all sources.
    """
    listed = numbered(sources, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    rows = keep(listed.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * F.lit(float(cap))).drop("_place"), "weights")
    level = 0.0
    for _ in range(most_steps):
        full = F.col("_weight") * F.lit(level) >= F.col("_most")
        left = F.sum("source_size") * F.lit(float(share)) - F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0.0))
        step = rows.agg((left / F.sum(F.when(~full, F.col("_weight")))).alias("level")).first().level  # null: all are full, or there are none
        if step is None or step <= level:
            break
        level = step
    else:
        raise RuntimeError(f"targets did not settle in {most_steps} steps")
    return rows.withColumn("target", F.least(F.col("_weight") * F.lit(level), F.col("_most"))).drop("_weight", "_most")


def tilts(cells: DataFrame, goals: DataFrame, small: bool, most_steps: int = 60, tolerance: float = 1e-11) -> DataFrame:
    """goals (key, source_size, target, scale) with `tilt`, the dual's solution per source.

    cells: (key, size, docs) with size above 0. A source that is to be taken twice whole has no finite tilt and
    gets the end of its bracket, where every document's rate is 2 to double precision.
    """
    end = F.col("scale") * 60.0  # at this tilt even a text of one word is taken surely, or surely not
    now = goals.select("key", "source_size", "target", "scale", (-end).alias("low"), end.alias("high"), F.lit(0.0).alias("tilt"))
    for _ in range(most_steps):
        s = 1 / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("scale")))
        words = F.col("docs") * F.col("size") * 2.0
        sums = cells.join(F.broadcast(now) if small else now, "key").groupBy("key").agg(F.sum(words * s).alias("taken"), F.sum(words * s * (1 - s) * F.col("size") / F.col("scale")).alias("slope"))
        step = now.join(F.broadcast(sums) if small else sums, "key")
        over = F.col("taken") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("taken") - F.col("target")) / F.col("slope")
        full = F.col("target") >= 2.0 * F.col("source_size") * (1 - 1e-12)
        done = full | (F.abs(F.col("taken") - F.col("target")) <= tolerance * F.col("source_size"))
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        tilt = F.when(full, end).when(done, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2)
        now = keep(step.select("key", "source_size", "target", "scale", low.alias("low"), high.alias("high"), tilt.alias("tilt"), done.alias("done")), "tilts")
        if now.agg(F.bool_and("done")).first()[0] in (True, None):
            break
        now = now.drop("done")
    return now.select("key", F.round("tilt", 8).alias("tilt"))  # rounded, so that the order of a sum can't show


def entropy_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), bucket_rows: int = 5000, small_sources: int = 50_000, into: str = "mix") -> DataFrame:
    """df's columns and `into` (which df must not have), a struct of source_size (long), target, rate (double), copies (int) and taken (long).

    size_col: words of a row, not null. Null sources are one source, after all others. Rows without words take
    rate 1 and no words. Repeated rows are rounded like others. The source table is broadcast if it has at
    most small_sources rows, else joined by shuffling. Rows with one id and size that would fill a bucket are numbered
    and dealt by their numbers. No rows: an empty result.
    """
    if cap != 2.0:
        raise ValueError("the base law has two copies")
    light = df.select(F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size")).withColumn("key", _source_key(F.col("source")))
    cells = keep(light.groupBy("key", "size").agg(F.count("*").alias("docs"), F.first("source").alias("source")), "cells")
    sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("rows"))
    goals = keep(source_targets(sources, share, cap, weights).withColumn("scale", F.greatest(F.col("source_size") / F.col("rows"), F.lit(1.0))), "goals")
    small = goals.count() <= small_sources
    solved = tilts(cells.filter("size > 0").select("key", "size", "docs"), goals.filter("source_size > 0"), small)
    plan = keep(goals.join(solved, "key", "left").select("key", "source_size", "target", "scale", "rows", F.coalesce("tilt", F.lit(0.0)).alias("tilt")), "plan")
    plan = plan.select(F.col("key").alias("_key"), F.struct("source_size", "target", "scale", "rows", "tilt").alias("_plan"))
    whole = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(size_col).cast("long").alias("_size"), _source_key(F.col(source_col)).alias("_key"))
    rows = twin_numbers(whole, ["_id", "_size", "_key"], max(2, bucket_rows // 4))
    rows = rows.join(F.broadcast(plan) if small else plan, "_key")
    size = F.col("_size")
    rate = F.round(2 / (1 + F.exp(-F.col("_plan.tilt") * size / F.col("_plan.scale"))), 9)
    rows = rows.withColumn("_rate", F.least(rate, F.lit(2.0)))
    drawn = F.xxhash64(F.lit(3), F.col("_id"), size, F.col("_twin"))
    rows = rows.withColumn("_bucket", F.pmod(drawn, F.ceil(F.col("_plan.rows") / bucket_rows)))
    line = Window.partitionBy("_key", "_bucket").orderBy(size.desc(), drawn, F.col("_id")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.round(F.sum("_rate").over(line), 6)
    rows = rows.withColumn("_reach", reach)
    copies = F.greatest(F.lit(0), F.least(F.lit(2), F.floor(F.col("_reach") + 0.5) - F.floor(F.round(F.col("_reach") - F.col("_rate"), 6) + 0.5))).cast("int")
    # What a bucket's rounding misses in words is made up by its smallest texts that were rounded the other way.
    rows = rows.withColumn("_copies", copies).withColumn("_missed", F.round(F.sum((F.col("_rate") - F.col("_copies")) * size).over(Window.partitionBy("_key", "_bucket")), 3))
    spare = F.when(F.col("_missed") > 0, F.col("_copies") < F.ceil("_rate")).otherwise(F.col("_copies") > F.floor("_rate"))
    small_first = Window.partitionBy("_key", "_bucket").orderBy(size, drawn, F.col("_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_spare", spare).withColumn("_mended", F.sum(F.when(F.col("_spare"), size)).over(small_first))
    copies = F.col("_copies") + F.when(F.col("_spare") & (F.col("_mended") <= F.abs("_missed")), F.signum("_missed").cast("int")).otherwise(0)
    mix = F.struct(F.col("_plan.source_size").alias("source_size"), F.col("_plan.target").alias("target"), F.col("_rate").alias("rate"), copies.alias("copies"), (copies * size).cast("long").alias("taken"))
    return rows.select("_row.*", mix.alias(into))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Contract columns: doc_id, size, source_size, target, taken, and rate and copies."""
    rows = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return entropy_mix(rows).select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken", "mix.rate", "mix.copies")
