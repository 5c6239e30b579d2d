"""A corpus pipeline: toxicity, line dedup, near-dedup, mixing, token encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.bpe import bpe_encode
from memlake.llm.line_dedup import line_dedup
from memlake.llm.mixing import entropy_mix, word_count
from memlake.llm.queries import vocabulary_path
from memlake.llm.shared import documents, keep
from memlake.llm.simhash import one_of_each
from memlake.llm.toxicity import clean_documents, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, fitted on the labelled ones, does not call toxic."""
    return clean_documents(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one, with their new lengths."""
    done = line_dedup(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows go, stay or come twice."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = entropy_mix(rows).filter("mix.copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("mix.copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every text taken."""
    return bpe_encode(docs, vocabulary_path())


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("simhash near-dedup", near_dedup), ("mixing", mixing), ("bpe", encode)]

#: SQL can't express learned scores, signatures, connected components and token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's result is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
