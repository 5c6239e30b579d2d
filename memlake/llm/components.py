"""Connected components by alternating large-star and small-star steps over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import heavy_join, keep

#: Edges that a written part holds; the number of parts follows the number of edges.
EDGES_PER_PART = 250_000


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """u, v and m, the least of u and its neighbours. The sums are made on the map side first; hubs' edges aren't shuffled."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return heavy_join(edges, least.select("u", "m"), "u", counts=least).select("u", "v", F.least("u", "m").alias("m"))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge and no v is a u: then each v is its component's least node."""
    if edges.groupBy("u").count().agg(F.max("count")).first()[0] not in (None, 1):
        return False
    return not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the least node that it reaches. Repeated edges and loops are fine.

    A round hangs every larger neighbour on its node's least one, then does the same downwards, until stars
    are left; the number of rounds is logarithmic in practice.
    """
    now = keep(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "edges")
    parts = 8 + now.count() // EDGES_PER_PART
    now = keep(now.distinct().coalesce(parts), "edges")
    for _ in range(most_rounds):
        if _is_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keep(_linked_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts), "large")
        linked = _linked_to_least(large)
        small = linked.select("u", F.col("m").alias("v")).union(linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = keep(small.distinct().coalesce(parts), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
