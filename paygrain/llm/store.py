"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

# Rows of an Arrow batch of texts.
BATCH_ROWS = 512
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on, at most BATCH_ROWS rows go to a Python worker at a time.

    By default it is 10,000. With texts, an executor keeps the direct memory that its
    largest batches took, and so do the workers. Spark has this as a setting of the
    session only. A smaller setting of the caller's stays.
    """
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or one of our own if that is unset.

    Only a session without the setting (a test on one machine) gets a folder made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="paygrain-checkpoint-")
    return "file://" + _own[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return it read back.

    This cuts the lineage: a lost executor costs no upstream work, and the sizes of
    what follows are known to the planner.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/paygrain/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
