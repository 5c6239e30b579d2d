from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "row", "size", "key", "fp", "utf8", "gone", "mix", "digest", "path", "blob", "on", "score", "sha", "least")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty, white and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(7)
    base, passage = words(rng, 300), " ".join(words(rng, 70))
    near = base.copy()
    near[150] = "changed"
    texts = [" ".join(base), " ".join(base), " ".join(near), " ".join(base).upper(), None, "", " \n\t ", "one", "one two", "ONE two", "x " * 2000, " ".join(words(rng, 20_000)), "Ünï cödé ß ñ 漢字   end", "line a is here for all\nline b is here for all\n\nline a is here for all", "word_" * 3000]
    texts += [" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 30)) for _ in range(4)]
    texts += [f"password = abcdef{i}ghijkl0123456789abcdef AKIA{'Q' * 16}" for i in range(3)]
    rows = [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t) if t else None) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[5], (None, "no id here at all", None, None, None), (None, " ".join(base), "en", "a", 1), (1, " ".join(base), "en", "a", 5)]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Odd rows with extra columns whose names operators might use, as a written table."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
