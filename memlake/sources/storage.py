"""Where written intermediate state goes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The fresh folder of each local application without spark.checkpoint.dir, which can't be set in a running session.
_LOCAL: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; in local mode under a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="memlake-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/memlake/{uuid.uuid4().hex}-stream"


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df written once under the work folder and read again, where several plans start from it."""
    path = f"{work_folder(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
