"""Positions in an order of all rows, without a window over one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written


def numbered(rows: DataFrame, order: list[Column], into: str = "position") -> DataFrame:
    """rows with their 0-based place (long) in an order.

    Rows are dealt by ranges of the order and written with their range's number. A range's first place is the
    count of the rows before it, a sum over one row a range; within a range rows are numbered by themselves.
    Rows that tie in the order must be alike, or their places depend on the run.
    """
    held = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = held.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return held.join(F.broadcast(starts), "_range").withColumn(into, (F.col("_start") + place).cast("long")).drop("_range", "_start")


def every_nth(rows: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """Every n-th row of an order from the first one on, so that `budget` remain at most."""
    placed = numbered(rows, order, "_place")
    step = max(1, -(-placed.count() // budget))
    return placed.filter((F.col("_place") % step == 0) & (F.col("_place") < step * budget)).drop("_place")
