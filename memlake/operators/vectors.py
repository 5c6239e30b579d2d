"""Vector search at scale: an inverted-file index, tiles for many queries, and z-scores from moments."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.storage import work_folder, written


def matrix(lists: pa.Array | pa.ChunkedArray, wide: int) -> np.ndarray:
    """Vectors of a batch as rows, without copying them one by one."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)


def unit_vectors(rows: DataFrame, vector: str, wide: int | None) -> DataFrame:
    """rows whose vector has `wide` numbers (any where wide is None) and isn't null."""
    return rows.filter(F.col(vector).isNotNull() if wide is None else F.size(vector) == wide)


def width(rows: DataFrame, vector: str) -> int | None:
    """Numbers of the first vector by a scan that ends at the first row."""
    first = rows.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
    return first[0] if first else None


def _pairs(sim: np.ndarray, k: int | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's k largest values of `least` or more, and of those that tie with the last one at nine digits."""
    if k is None or k >= sim.shape[1]:
        return np.nonzero(sim >= least)
    kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
    return np.nonzero((np.round(sim, 9) >= np.round(kth, 9)[:, None]) & (sim >= least))


def _numbers(own: pa.Table, column: str) -> np.ndarray:
    return own.column(column).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)


def _first(found: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.round("similarity", 9).desc(), F.col("id"))
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < k)


def in_tiles(corpus: DataFrame, queries: DataFrame, compare: Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], carry: tuple[str, ...] = (), tile: int = 8192, block: int = 1024, slice_rows: int = 256) -> DataFrame:
    """(query_id, id, similarity) that compare gives for any number of queries and rows, and the rows' columns `carry`.

    corpus: (id, v) and queries: (query_id, v), and maybe both a `cell` within which they meet; queries may have several
    rows, told apart by `variant`. Rows are dealt into tiles and queries into blocks, by hashes of their ids and the
    sizes of their cells, so a hot cell is many tiles; a task takes one block with one tile, and gives what it finds slice
    by slice. compare(q, first, m, own, floor): the block's vectors, the places where a query's rows begin, the tile's vectors
    and its other columns, the queries' own `least` (-inf where they have none); gives places in first, in m, and values.
    """
    cell = lambda df: (F.col("cell") if "cell" in df.columns else F.lit(0)).alias("cell")
    rows = corpus.select(cell(corpus), "id", "v", *carry)
    of = lambda c, other: F.col(c) if c in queries.columns else F.lit(other)
    asked = queries.select(cell(queries), "query_id", of("variant", 0).cast("long").alias("variant"), of("least", float("-inf")).cast("double").alias("_least"), "v")
    tiles = rows.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    plan = tiles.join(asked.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks")), "cell")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    left = rows.join(plan, "cell").select("cell", F.pmod(F.xxhash64("id"), "tiles").alias("i"), every("blocks").alias("j"), "id", none(asked, "query_id"), none(asked, "variant"), none(asked, "_least"), "v", *carry)
    right = asked.join(plan, "cell").select("cell", every("tiles").alias("i"), F.pmod(F.xxhash64("query_id"), "blocks").alias("j"), none(rows, "id"), "query_id", "variant", "_least", "v", *[none(rows, c) for c in carry])
    kinds = [queries.schema["query_id"].dataType, corpus.schema["id"].dataType]
    kept = [corpus.schema[c].dataType for c in carry]
    schema = pa.schema([("query_id", to_arrow_type(kinds[0])), ("id", to_arrow_type(kinds[1])), ("similarity", pa.float64()), *[(c, to_arrow_type(x)) for c, x in zip(carry, kept, strict=True)]])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(list(batches))
        is_row = pc.is_valid(part.column("variant"))
        own, ask = part.filter(pc.invert(is_row)), part.filter(is_row).sort_by([("query_id", "ascending"), ("variant", "ascending")])
        if not own.num_rows or not ask.num_rows:
            return
        wide = len(ask.column("v")[0])
        own = own.filter(pc.equal(pc.list_value_length(own.column("v")), wide)).combine_chunks()
        if not own.num_rows:
            return
        q, names, ids = matrix(ask.column("v"), wide), ask.column("query_id").combine_chunks(), own.column("id").combine_chunks()
        first = np.flatnonzero(np.append(True, pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)))
        m, floor, others = matrix(own.column("v"), wide), _numbers(ask, "_least"), own.select(list(carry))
        for a in range(0, len(first), slice_rows):
            begin = first[a : a + slice_rows]
            end = first[a + slice_rows] if a + slice_rows < len(first) else len(q)
            i, j, s = compare(q[begin[0] : end], begin - begin[0], m, own, floor[begin])
            for at in range(0, len(i), 1 << 18):
                x, y, z = (n[at : at + (1 << 18)] for n in (begin[i], j, s))
                told = [others.column(c).combine_chunks().take(pa.array(y)) for c in carry]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), ids.take(pa.array(y)), pa.array(z), *told], schema=schema)

    shape = "".join(f", `{c}` {x.simpleString()}" for c, x in zip(carry, kept, strict=True))
    return left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(meet, f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, similarity double{shape}")


def tiled_top_k(corpus: DataFrame, queries: DataFrame, k: int | None, least: float = -1.0, carry: tuple[str, ...] = (), **tiles: int) -> DataFrame:
    """(query_id, id, similarity, rank): each query's k best rows with a similarity of `least` or more; all of them, without rank, for k None.

    queries may have a column `least` of their own.
    """

    def compare(q: np.ndarray, first: np.ndarray, m: np.ndarray, own: pa.Table, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sim = q @ m.T
        low = np.maximum(floor, least)[:, None]
        i, j = _pairs(sim, k, low)
        return i, j, sim[i, j]

    found = in_tiles(corpus, queries, compare, carry, **tiles)
    return found if k is None else _first(found, k)


def tiles_best(corpus: DataFrame, queries: DataFrame, k: int, least: float = -1.0, carry: tuple[str, ...] = (), weight: float = 1.0, bonus: str | None = None, group: str | None = None, **tiles: int) -> DataFrame:
    """(query_id, id, similarity) of rows among which each query's k best are, by weight * similarity + bonus, of `least` similarity or more.

    bonus and group: carried columns; with a group, the k best of each of the query's groups are among them. A tile's k
    best leave a task, with those less than 1e-9 below, so a query has some k rows a tile. The exact order is the caller's.
    """

    def compare(q: np.ndarray, first: np.ndarray, m: np.ndarray, own: pa.Table, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sim = q @ m.T
        value = weight * sim + (0.0 if bonus is None else _numbers(own, bonus)[None, :])
        value = np.where(sim >= np.maximum(floor, least)[:, None], value, -np.inf)
        member = np.zeros(len(m), np.int64) if group is None else own.column(group).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        order = np.argsort(member, kind="stable")
        found = []
        for at in np.split(order, np.flatnonzero(np.diff(member[order])) + 1):
            some = value[:, at]
            kth = np.partition(some, -k, axis=1)[:, -k, None] if k < len(at) else -np.inf
            i, j = np.nonzero((some >= kth - 1e-9) & (some > -np.inf))
            found.append((i, at[j]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        return i, j, sim[i, j]

    return in_tiles(corpus, queries, compare, carry, **tiles)


@dataclass(frozen=True)
class VectorIndex:
    """An inverted file of vectors by cell, in a folder: `cells` has rows (id, v) by cell, `centroids` the cells' centres.

    Cells are the nearest of centroids that a bounded sample gave; every row has one, whatever the sample. Rows can be
    appended; they go to the cells that are there.
    """

    spark: SparkSession
    folder: str

    def centroids(self) -> np.ndarray:
        """As many rows as there are cells: a number given when the index was made."""
        rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").collect()
        return np.array([r.v for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/cells")

    def append(self, corpus: DataFrame, id_col: str = "id", vector: str = "embedding") -> None:
        """Writes rows into their cells; a cell that is large has several files, so no task has to write a hot one."""
        centres = self.centroids()
        held = self.spark.sparkContext.broadcast(centres)
        kind = corpus.schema[id_col].dataType.simpleString()

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for batch in batches:
                if batch.num_rows:
                    cell = np.argmax(matrix(batch.column("v"), c.shape[1]) @ c.T, axis=1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell)], ["id", "v", "cell"])

        rows = unit_vectors(corpus, vector, centres.shape[1]).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
        element = corpus.schema[vector].dataType.simpleString()
        rows.mapInArrow(nearest, f"id {kind}, v {element}, cell int").hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/cells")

    def _probes(self, queries: DataFrame, probes: int) -> DataFrame:
        held = self.spark.sparkContext.broadcast(self.centroids())
        kind = queries.schema["query_id"].dataType.simpleString()

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column("v"), c.shape[1])
                n = min(probes, len(c))
                near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :n]
                at = np.repeat(np.arange(len(q)), n)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], ["query_id", "v", "cell"])

        return queries.mapInArrow(probed, f"query_id {kind}, v {queries.schema['v'].dataType.simpleString()}, cell int")

    def top_k(self, queries: DataFrame, k: int, probes: int, least: float = -1.0, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(query_id, id, similarity, rank): the k best of the rows in each query's `probes` nearest cells, by exact similarity.

        With as many probes as cells the result is exact. Few queries read only the cells that they probe.
        """
        c = self.centroids()
        asked = unit_vectors(queries, vector, c.shape[1]).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"))
        asked = written(self._probes(asked, probes), "probes")
        wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # as many rows as cells at most
        rows = self.rows() if len(wanted) == len(c) else self.rows().filter(F.col("cell").isin(wanted))
        return tiled_top_k(rows, asked, k, least)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9, most_queries: int = 200, query_id: str = "query_id", vector: str = "embedding") -> int:
        """The least number of probes whose mean recall of the exact top k, measured on `most_queries` queries by hash, is `recall`.

        A row's cell is found at the place that its cell has among those nearest to the query; so one exact search
        measures all numbers of probes at once.
        """
        c = self.centroids()
        asked = written(unit_vectors(queries, vector, c.shape[1]).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v")).orderBy(F.xxhash64(query_id), query_id).limit(most_queries), "sample")
        best = tiled_top_k(self.rows().withColumn("cell", F.lit(0)), asked, k).select("query_id", "id")
        cells = best.join(self.rows().select("id", "cell"), "id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"), F.first("id"))
        found = cells.join(asked, "query_id").select("v", "cells").collect()  # most_queries rows of k cells
        if not found:
            return 1
        place = np.concatenate([np.argsort(np.argsort(-(c @ np.array(r.v, float)), kind="stable"))[r.cells] for r in found])
        return int(np.sort(place)[max(0, math.ceil(recall * len(place)) - 1)]) + 1


def build_index(corpus: DataFrame, cells: int, folder: str | None = None, id_col: str = "id", vector: str = "embedding", sample: int = 20_000, rounds: int = 10, seed: int = 3) -> VectorIndex:
    """An index of all rows with a vector of the width of the first; others are left out.

    The centroids come from `rounds` of spherical k-means over `sample` rows by a hash of the id, at most, in the driver.
    An empty corpus gives an index of no cells.
    """
    spark = corpus.sparkSession
    index = VectorIndex(spark, folder or f"{work_folder(spark)}-vectors")
    wide = width(corpus, vector)
    rows = unit_vectors(corpus, vector, wide)
    held = [r[0] for r in rows.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector).collect()]
    m = np.array(held, np.float64).reshape(len(held), wide or 0)
    rng = np.random.default_rng(seed)
    c = m[np.sort(rng.permutation(len(m))[:cells])]
    for _ in range(rounds if len(c) else 0):
        near = np.argmax(m @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.folder}/centroids")
    if len(c):
        index.append(corpus, id_col, vector)
    return index


def moments(corpus: DataFrame, vector: str = "embedding", fan: int = 1024) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of vectors, their mean, and the mean of their outer products with themselves.

    Each partition gives one row a dimension; sums go through `fan` groups a dimension and then one, so no group
    has more than the square root of the partitions' number of rows (to about a million partitions).
    """
    wide = width(corpus, vector)
    if wide is None:
        return 0, np.zeros(0), np.zeros((0, 0))  # no rows

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(wide), np.zeros((wide, wide))
        for batch in batches:
            m = matrix(batch.column("v"), wide)
            n, one, two = n + len(m), one + m.sum(0), two + m.T @ m
        rows = [[n, *([0.0] * (wide - 1))], one.tolist(), *two.tolist()] if n else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["slot", "x"])

    def added(part: pa.Table) -> pa.Table:
        total = matrix(part.column("x"), wide).sum(0)
        return pa.table([part.column("slot").slice(0, 1).cast(pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["slot", "x"])

    rows = unit_vectors(corpus, vector, wide).select(F.col(vector).alias("v")).mapInArrow(sums, "slot int, x array<double>")
    rows = rows.groupBy("slot", F.pmod(F.spark_partition_id(), F.lit(fan))).applyInArrow(added, "slot int, x array<double>")
    x = np.array([r.x for r in rows.groupBy("slot").applyInArrow(added, "slot int, x array<double>").orderBy("slot").collect()])  # wide + 2 rows
    n = int(x[0, 0]) if len(x) else 0
    return n, x[1] / n, x[2:] / n


def variant_top_k(corpus: DataFrame, variants: DataFrame, k: int | None, id_col: str = "id", vector: str = "embedding", **tiles: int) -> DataFrame:
    """(query_id, id, similarity, rank) of each query's k best rows, by the raw similarity of the variant with the best z-score.

    variants: (query_id, variant, v). A variant's z-scores need the mean and spread (population, 1e-6 at least) of its
    similarities with all rows: q . mean and q' S q - (q . mean)^2 with the corpus' second moments S, so no similarity
    but a tile's k best leaves a task. Of equal z-scores the first variant counts. For k None all rows come, without
    rank, one for each query and row.
    """
    n, mean, second = moments(corpus, vector)
    held = corpus.sparkSession.sparkContext.broadcast((mean, second))  # dimension by dimension

    def compare(q: np.ndarray, first: np.ndarray, m: np.ndarray, own: pa.Table, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, second = held.value
        mid = q @ mean
        spread = np.maximum(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", q, second, q) - mid**2, 0)), 1e-6)
        sim = q @ m.T
        z = np.round((sim - mid[:, None]) / spread[:, None], 9)
        pick = np.array([a + np.argmax(z[a:b], axis=0) for a, b in zip(first, np.append(first[1:], len(q)))])
        raw = np.take_along_axis(sim, pick, axis=0)
        i, j = _pairs(raw, k, -np.inf)
        return i, j, raw[i, j]

    rows = unit_vectors(corpus, vector, len(mean)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    found = in_tiles(rows, unit_vectors(variants, "v", len(mean)), compare, **tiles)
    return found if k is None else _first(found, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the mean share of each query's exact rows that are found."""
    hits = exact.join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("r"))
    return hits.agg(F.count("*").alias("queries"), F.avg("r").alias("recall"))
