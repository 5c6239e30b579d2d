"""The driver's tables in the roles of records, deliveries, turns and events, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("lang").alias("type"), F.col("source").alias("project"), F.col("text").alias("content"), F.substring_index("text", " ", 2).alias("topic"),
        ((i * 37) % 100 / 100.0).alias("confidence"), F.timestamp_seconds(1704067200 + i * 420).alias("updated_at"), (i % 50).alias("session_id"),
        F.when(i % 11 == 0, F.concat(F.lit("superseded by #"), (i + 1).cast("string"))).when(i % 13 == 0, "").alias("archived_reason"),
        F.when(i % 17 == 0, F.lit("2024-06-01").cast("timestamp")).alias("deleted_at"),
    )


RECORDS = """records AS (SELECT doc_id AS id, lang AS type, source AS project, text AS content,
    array_to_string(string_split(text, ' ')[1:2], ' ') AS topic, ((doc_id * 37) % 100) / 100.0::DOUBLE AS confidence,
    1704067200 + doc_id * 420 AS updated_s, doc_id % 50 AS session_id,
    CASE WHEN doc_id % 11 = 0 THEN 'superseded by #' || CAST(doc_id + 1 AS VARCHAR) WHEN doc_id % 13 = 0 THEN '' END AS archived_reason,
    doc_id % 17 = 0 AS deleted FROM documents)"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    method = F.element_at(F.array(*map(F.lit, ("lexical", "semantic", "backfill"))), (i % 3 + 1).cast("int"))
    rows = rows.withColumn("method", method)
    engaged = F.when(F.col("method") == "backfill", F.when(F.col("quality") == 1, 1)).when(i % 7 != 0, F.col("quality"))
    return rows.select(
        i.alias("id"), (i % 400).alias("memory_id"), F.expr("doc_id div 12").alias("session_id"), F.expr("doc_id div 4 % 3").alias("turn_index"), (i % 4).alias("served_rank"), "method",
        engaged.alias("engaged"), F.when(i % 5 == 0, -1.0).otherwise(i % 100 / 100.0).alias("engaged_score"), F.when(i % 2 == 0, F.greatest(F.col("quality") * 3 - F.col("toxic"), F.lit(0))).alias("grade"),
        F.col("lang").alias("layer"), F.col("source").alias("version"), F.element_at(F.array(*map(F.lit, ("fact", "correction", "person", "decision"))), (i % 40 % 4 + 1).cast("int")).alias("kind"),
        (F.col("n_chars") % 1000 / 1000.0).alias("score"), "quality", "toxic",
    )


DELIVERIES = """deliveries AS (SELECT id, memory_id, session_id, turn_index, served_rank, method,
    CASE WHEN method = 'backfill' THEN CASE WHEN quality = 1 THEN 1 END WHEN id % 7 <> 0 THEN quality END AS engaged,
    CASE WHEN id % 5 = 0 THEN -1.0 ELSE (id % 100) / 100.0::DOUBLE END AS engaged_score,
    CASE WHEN id % 2 = 0 THEN greatest(quality * 3 - toxic, 0) END AS grade, layer, version, kind, score, quality, toxic
    FROM (SELECT doc_id AS id, doc_id % 400 AS memory_id, doc_id // 12 AS session_id, doc_id // 4 % 3 AS turn_index, doc_id % 4 AS served_rank,
        ['lexical', 'semantic', 'backfill'][doc_id % 3 + 1] AS method, lang AS layer, source AS version,
        ['fact', 'correction', 'person', 'decision'][doc_id % 40 % 4 + 1] AS kind, (n_chars % 1000) / 1000.0::DOUBLE AS score, quality, toxic
        FROM labels JOIN documents USING (doc_id)))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that name their suppliers, and suppliers that name a supplier in turn: a derived graph (source, target)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    s = F.col("l_suppkey")
    up = li.filter("l_suppkey % 3 <> 0").select("l_suppkey").distinct().select(F.concat(F.lit("s"), s.cast("string")).alias("source"), F.concat(F.lit("s"), F.expr("l_suppkey div 3 + 1").cast("string")).alias("target"))
    return li.distinct().select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), s.cast("string")).alias("target")).union(up)  # distinct by their numbers, and a part is no supplier


EDGES = "edges AS (SELECT DISTINCT 'p' || l_partkey AS source, 's' || l_suppkey AS target FROM lineitem UNION SELECT 's' || l_suppkey, 's' || (l_suppkey // 3 + 1) FROM lineitem WHERE l_suppkey % 3 <> 0)"
