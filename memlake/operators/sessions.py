"""As-of joins and windows over turns and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_backward(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Both sides are put in one order and the last right values carried on: one shuffle, no pairs. Right rows come
    first at equal times; of right rows with one time, the greatest values count.
    """
    cols = left.columns
    r = right.select(key, at, F.lit(0).alias("_side"), F.struct(*values).alias("_value"))
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"))
    both = rows.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, F.col("_value")), ignorenulls=True).over(w)).filter("_side = 1")
    return carried.select(*cols, *[F.col(f"_last.{v}").alias(v) for v in values])


def next_rows(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, values: list[str], w: int = 1) -> DataFrame:
    """Each left row with the first w right rows of its key at or after its time, numbered from 1.

    Right rows are numbered per key; a left row finds how many came before it, and an equi-join on the number
    fetches the next w. No row meets more than w others.
    """
    order = Window.partitionBy(key).orderBy(at, *values)
    numbered = right.select(key, at, *values, F.row_number().over(order).alias("_n"))
    both = left.select(key, at, F.lit(0).alias("_side"), F.col(left_id)).unionByName(right.select(key, at, F.lit(1).alias("_side")), allowMissingColumns=True)
    before = F.sum(F.col("_side")).over(Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    asked = both.withColumn("_before", before).filter("_side = 0").select(key, left_id, F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + w)).alias("_n"), "_before")
    return asked.join(numbered.select(key, "_n", *values), [key, "_n"]).select(left_id, (F.col("_n") - F.col("_before")).cast("long").alias("nth"), *values)


def around(rows: DataFrame, key: str, order: str, anchor: Column, before: int, after: int) -> DataFrame:
    """Rows within a span of places around each anchor row of their key."""
    w = Window.partitionBy(key).orderBy(order)
    near = F.max(anchor.cast("int")).over(w.rowsBetween(-after, before))
    return rows.withColumn("_near", near).filter("_near = 1").drop("_near")


def sessionize(events: DataFrame, key: str, ts: str, gap_minutes: int) -> DataFrame:
    """T4: (key, start, end, n) of runs of events with gaps below the limit."""
    cut = events.groupBy(F.session_window(ts, f"{gap_minutes} minutes").alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("end"))
    return cut.select(key, F.col("w.start").alias("start"), "end", "n")


def turn_context(turns: DataFrame, key: str, order: str, most: int = 300) -> DataFrame:
    """The turn's text, then the last user and assistant texts before it, the latter capped."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda role: F.last(F.when(F.col("role") == role, F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("context", F.concat_ws("\n", "text", F.concat(F.lit("[prev user] "), last("user")), F.concat(F.lit("[prev assistant] "), F.substring(last("assistant"), 1, most))))
