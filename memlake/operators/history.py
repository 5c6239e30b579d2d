"""Tables that keep their past: rows with intervals of validity, written section by section."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import work_folder, written


@dataclass(frozen=True)
class VersionedTable:
    """Each load compares its rows with what holds, and rewrites only the sections that differ.

    Rows have valid_from and valid_to (null: still); a row whose values stay keeps its interval, so there is history
    only by real changes. Sections are folders. A load writes the sections that it changes under its number, then a
    list that names each section's number; the last complete list holds, so a load that dies changes nothing, and
    files of other sections are never touched.
    """

    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    section: str
    schema: str = field(repr=False, default="")
    part_chars: int = 32 << 20  #: characters of values that a partition, and so a file, of a large section has, or so

    def _lists(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        at = path(f"{self.folder}/lists")
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and files.exists(path(f"{self.folder}/lists/{n}/_SUCCESS")))

    def places(self) -> DataFrame:
        """place (a hash of the section) and the load that wrote it, of every section that holds."""
        known = self._lists()
        kind = "place long, load long"
        return self.spark.read.schema(kind).json(f"{self.folder}/lists/{known[-1]}") if known else self.spark.createDataFrame([], kind)

    def _place(self) -> Column:
        return F.xxhash64(self.section).alias("place")

    def _stored(self) -> DataFrame:
        """All rows that a list names, with their place and load."""
        kind = f"{self.schema}, valid_from long, valid_to long"
        loads = [r.load for r in self.places().select("load").distinct().collect()]  # as many as loads whose rows still hold
        if not loads:
            return self.spark.createDataFrame([], f"{kind}, place long, load long")
        parts = [self.spark.read.schema(f"{kind}, place long").parquet(f"{self.folder}/rows/{n}").withColumn("load", F.lit(n).cast("long")) for n in loads]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.join(self.places(), ["place", "load"], "left_semi")

    def rows(self) -> DataFrame:
        return self._stored().drop("place", "load")

    def as_of(self, time: int) -> DataFrame:
        """The rows that held at a time."""
        held = self.rows().filter((F.col("valid_from") <= time) & (F.col("valid_to").isNull() | (F.col("valid_to") > time)))
        return held.drop("valid_from", "valid_to")

    def load(self, rows: DataFrame, time: int, sections: DataFrame | None = None) -> int:
        """Takes rows as all there is at a time (or all there is of `sections`, rows of the section column); gives the number of sections rewritten.

        Rows of the table that are missing are closed; of rows with one key the largest counts. Times must rise.
        rows is read three times and not written in between, so it should be a table that stays the same. Sections
        are compared by sums; only rows of those that differ are shuffled, once, old and new ones of a key to one
        partition, where they are compared in full and from where they are written.
        """
        cols = [c for c in rows.columns]
        number = (self._lists() or [0])[-1] + 1
        value = F.struct(*[c for c in cols if c not in self.keys])
        new = self._single(rows).withColumn("place", self._place())
        stored = self._stored().drop("load")
        if sections is not None:
            stored = stored.join(sections.select(F.xxhash64(F.col(self.section).cast(rows.schema[self.section].dataType)).alias("place")).distinct(), "place", "left_semi")
        shown = lambda df: df.select("place", *self.keys, F.to_json(value, {"ignoreNullFields": "false"}).alias("_json")).select("place", F.length("_json").alias("_long"), F.xxhash64("_json", *self.keys).alias("_mark"))
        sums = lambda df, kind: shown(df).groupBy("place").agg(F.count("*").alias(f"n_{kind}"), F.bit_xor("_mark").alias(f"x_{kind}"), F.sum(F.shiftright("_mark", 24)).alias(f"s_{kind}"), F.sum("_long").alias(f"long_{kind}"))
        both = sums(stored.filter("valid_to IS NULL"), "old").join(sums(new, "new"), "place", "full")
        parts = F.ceil((F.coalesce("long_old", F.lit(0)) + F.coalesce("long_new", F.lit(0)) + 1) / self.part_chars).alias("_parts")
        differs = both.filter("NOT (n_old <=> n_new AND x_old <=> x_new AND s_old <=> s_new)").select("place", parts)
        differs = written(differs, "changed-sections")
        if differs.isEmpty():
            return 0
        none = F.lit(None).cast("long")
        old = stored.select("*", F.lit(False).alias("_new"), F.col("valid_to").isNotNull().alias("_past"))
        every = old.unionByName(new.select("*", none.alias("valid_from"), none.alias("valid_to"), F.lit(True).alias("_new"), F.lit(False).alias("_past")))
        dealt = every.join(differs, "place").withColumn("_part", F.pmod(F.xxhash64(*self.keys), "_parts")).drop("_parts").repartition("place", "_part")
        key = Window.partitionBy("place", "_part", *self.keys, "_past").orderBy("_new")  # what holds, then what is new: two rows at most
        other = F.when(F.col("_new"), F.lag(value).over(key)).otherwise(F.lead(value).over(key))
        met = dealt.withColumn("_same", ~F.col("_past") & other.isNotNull() & other.eqNullSafe(value)).filter("NOT (_new AND _same)")
        began = F.when(F.col("_new"), F.lit(time)).otherwise(F.col("valid_from")).cast("long").alias("valid_from")
        ended = F.when(F.col("_past"), F.col("valid_to")).when(~F.col("_new") & ~F.col("_same"), F.lit(time)).cast("long").alias("valid_to")
        met.select("place", *cols, began, ended).write.mode("overwrite").partitionBy("place").parquet(f"{self.folder}/rows/{number}")
        differs = differs.select("place")
        places = self.places().join(differs, "place", "left_anti").unionByName(differs.withColumn("load", F.lit(number).cast("long")))
        written(places, "places").write.mode("overwrite").json(f"{self.folder}/lists/{number}")
        return differs.count()

    def _single(self, rows: DataFrame) -> DataFrame:
        """rows, of those with one key the largest; only keys that have several rows are grouped with their values."""
        twice = written(rows.groupBy(*self.keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)]), "repeated-keys")
        if twice.isEmpty():
            return rows
        alike = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(self.keys)])
        value = F.struct(*[c for c in rows.columns if c not in self.keys])
        largest = rows.join(twice, alike, "left_semi").groupBy(*self.keys).agg(F.max(value).alias("_max")).select(*self.keys, "_max.*")
        return written(rows.join(twice, alike, "left_anti").unionByName(largest), "incoming")


def versioned_table(like: DataFrame, keys: tuple[str, ...], section: str, folder: str | None = None) -> VersionedTable:
    """A table for rows like these, in a folder that may be new."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    return VersionedTable(like.sparkSession, folder or f"{work_folder(like.sparkSession)}-history", keys, section, kinds)
