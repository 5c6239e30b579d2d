"""A full-text index on disk: segments of postings in blocks, updates by fingerprints, top k with block-max pruning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import work_folder, written
from .retrieval import bm25_idf, bm25_weight, tokens, top_k

DOCS = "id long, mark long, length long, gone boolean"


@dataclass(frozen=True)
class TextIndex:
    """A folder of numbered segments: `docs` says which documents a segment has put in or taken out, `postings` their terms.

    Documents are dealt into `ranges` by a hash of their ids. A posting row is a block: a term's documents in one
    range, in the order of their ids, with their counts and lengths, and the block's largest count and least length, from
    which the largest weight follows whatever the mean length is by then. A block has as many documents as a range has
    at most, so `ranges` should grow with the collection. A document's last segment holds. `lists/<n>` names the
    segments of state n; the last complete one counts, so an update that dies leaves the state before it.
    """

    spark: SparkSession
    folder: str
    ranges: int = 1024

    # State

    def _files(self):  # noqa: ANN202  Hadoop's file system, which the folder may be in
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, list[int]]:
        """Number of the last state, and its segments: as many as updates since the last merge."""
        path, files = self._files()
        at = path(f"{self.folder}/lists")
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        done = [int(n) for n in names if n.isdigit() and files.exists(path(f"{self.folder}/lists/{n}/_SUCCESS"))]
        if not done:
            return 0, []
        return max(done), sorted(r.segment for r in self.spark.read.schema("segment int").json(f"{self.folder}/lists/{max(done)}").collect())

    def _commit(self, state: int, segments: list[int]) -> None:
        self.spark.createDataFrame([(s,) for s in segments], "segment int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/lists/{state}")

    def _read(self, what: str, segments: list[int]) -> DataFrame:
        schema = DOCS if what == "docs" else "term string, range int, ids array<long>, tfs array<int>, lengths array<int>, most_tf int, least_length int"
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{s}/{what}").withColumn("segment", F.lit(s)) for s in segments]
        if not parts:
            return self.spark.createDataFrame([], schema + ", segment int")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _last(self, segments: list[int]) -> DataFrame:
        """Each document's last word: id, segment, mark, length, gone."""
        last = self._read("docs", segments).groupBy("id").agg(F.max(F.struct("segment", "mark", "length", "gone")).alias("x"))
        return last.select("id", "x.*")

    def documents(self) -> DataFrame:
        """id, mark (the text's fingerprint) and length of what the index holds."""
        return self._last(self._state()[1]).filter("NOT gone").select("id", "mark", "length")

    # Writing

    def _write(self, segment: int, docs: DataFrame, counts: DataFrame) -> None:
        """counts: term, id, tf, length. Postings are dealt by term and range, so a frequent term is many keys."""
        docs.write.mode("overwrite").parquet(f"{self.folder}/segments/{segment}/docs")
        blocks = counts.groupBy("term", F.pmod(F.xxhash64("id"), F.lit(self.ranges)).cast("int").alias("range"))
        rows = blocks.agg(F.array_sort(F.collect_list(F.struct("id", "tf", "length"))).alias("p"), F.max("tf").cast("int").alias("most_tf"), F.min("length").cast("int").alias("least_length"))
        rows = rows.select("term", "range", F.col("p.id").alias("ids"), F.col("p.tf").cast("array<int>").alias("tfs"), F.col("p.length").cast("array<int>").alias("lengths"), "most_tf", "least_length")
        rows.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.mode("overwrite").parquet(f"{self.folder}/segments/{segment}/postings")

    def update(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", complete: bool = False) -> int:
        """Puts in documents that are new or whose text has another fingerprint; gives their number.

        Only these are cut into words. A null text is empty. complete: docs is all there is, so documents that it lacks
        are taken out. Of rows with one id the one with the largest text counts; rows without an id are left out.
        """
        state, segments = self._state()
        text = F.coalesce(F.col(text_col), F.lit(""))
        given = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
        held = self._last(segments).filter("NOT gone").select("id", F.col("mark").alias("old"))
        met = given.join(held, "id", "full")
        fresh = met.filter("mark IS NOT NULL AND NOT (old <=> mark)").groupBy("id").agg(F.max(F.struct("text", "mark")).alias("x")).select("id", "x.*")
        fresh = written(fresh.withColumn("words", tokens(F.col("text"))).drop("text"), "changed")
        rows = fresh.select("id", "mark", F.size("words").cast("long").alias("length"), F.lit(False).alias("gone"))
        if complete:
            rows = rows.unionByName(met.filter("mark IS NULL").select("id", F.lit(0).cast("long").alias("mark"), F.lit(0).cast("long").alias("length"), F.lit(True).alias("gone")))
        counts = fresh.select("id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
        self._write(state + 1, rows, counts)
        self._commit(state + 1, [*segments, state + 1])
        return rows.count()

    def merge(self) -> None:
        """All segments as one, without what is no more."""
        state, segments = self._state()
        last = written(self._last(segments).filter("NOT gone"), "live")
        live = self._live(self._read("postings", segments), last).select("term", "id", "tf", "length")
        self._write(state + 1, last.select("id", "mark", "length", "gone"), live)
        self._commit(state + 1, [state + 1])

    # Reading

    def _live(self, blocks: DataFrame, last: DataFrame) -> DataFrame:
        """The postings of blocks whose document has that segment as its last."""
        each = blocks.withColumn("p", F.explode(F.arrays_zip("ids", "tfs", "lengths"))).select(*[c for c in blocks.columns if c not in ("ids", "tfs", "lengths", "most_tf", "least_length")], F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))
        return each.join(last.select("id", "segment"), ["id", "segment"], "left_semi")

    def top_k(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, query_id: str = "query_id", query_col: str = "query", most_terms: int = 100_000) -> DataFrame:
        """(query_id, id, score, rank) as bm25_top_k gives them.

        What a document of a range can score for a query is at most the sum of its terms' largest weights there. The
        ranges where that is most, k of them and 4 k postings at least, are read first; their k-th score is one that the query's
        k-th document has at least. Then only ranges that could reach it are read.
        """
        _, segments = self._state()
        asked = written(queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_col)))).alias("term")), "asked-terms")
        last = written(self._last(segments).filter("NOT gone").select("id", "segment", "length"), "live")
        terms = asked.select("term").distinct()
        few = terms.count() <= most_terms
        small = lambda df: F.broadcast(df) if few else df  # noqa: E731  a row a term
        blocks = written(self._read("postings", segments).join(small(terms), "term", "left_semi"), "asked-blocks")
        sizes = last.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
        df = self._live(blocks, last).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(sizes))
        idf = written(df.select("term", bm25_idf(F.col("n"), F.col("df")).alias("idf"), "mean"), "idf")
        known = blocks.join(small(idf), "term")
        bound = bm25_weight(F.col("idf"), F.col("most_tf"), F.col("least_length"), F.col("mean"), k1, b)
        bounds = known.groupBy("term", "range").agg(F.max(bound).alias("bound"), F.sum(F.size("ids")).alias("held"))
        pairs = written(asked.join(bounds, "term").groupBy("query_id", "range").agg(F.sum("bound").alias("bound"), F.sum("held").alias("held")), "range-bounds")
        strong = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        before = F.coalesce(F.sum("held").over(strong.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = pairs.withColumn("before", before).withColumn("nth", F.row_number().over(strong)).filter((F.col("before") < 4 * k) | (F.col("nth") <= k))
        kth = top_k(self._scores(first, asked, known, last, k1, b), ["query_id"], [F.desc("score")], k)
        kth = kth.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        reach = pairs.join(kth, "query_id", "left").filter(F.coalesce(F.col("bound") >= F.col("floor") - 1e-9, F.lit(True)))
        return top_k(self._scores(reach, asked, known, last, k1, b), ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)

    def _scores(self, pairs: DataFrame, asked: DataFrame, known: DataFrame, last: DataFrame, k1: float, b: float) -> DataFrame:
        """(query_id, id, score) of the documents in pairs' (query_id, range), from the blocks of the query's terms there."""
        wanted = written(pairs.select("query_id", "range").join(asked, "query_id"), "wanted-blocks")
        opened = known.join(wanted.select("term", "range").distinct(), ["term", "range"], "left_semi").select("term", "range", "segment", "ids", "tfs", "lengths", "idf", "mean")
        weight = bm25_weight(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean"), k1, b)
        weights = self._live(opened, last).select("term", "range", "id", weight.alias("w"))
        return weights.join(wanted, ["term", "range"]).groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def text_index(spark: SparkSession, folder: str | None = None, ranges: int = 1024) -> TextIndex:
    """The index in a folder, which may be empty or new."""
    return TextIndex(spark, folder or f"{work_folder(spark)}-words", ranges)
