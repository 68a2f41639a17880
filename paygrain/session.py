"""Session settings the jobs are written for."""

from __future__ import annotations

from math import ceil

from pyspark.sql import SparkSession

# Only settings that hold at any cluster size. Executor memory, cores and the
# shuffle width belong to the submitting environment; AQE merges the shuffle
# partitions that turn out small and splits the ones that turn out skewed.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

PARTITION_BYTES = 256 * 1024 * 1024


def settings_for(shuffled_bytes: int) -> dict[str, str]:
    """Partition settings for jobs whose largest shuffle moves this many bytes.

    The shuffle starts with enough partitions that each fits an executor core's
    share of memory; AQE then merges small ones up to the advisory size and
    splits skewed ones at a few times that size.
    """
    wanted = max(1, ceil(shuffled_bytes / PARTITION_BYTES))
    size = str(PARTITION_BYTES)
    return {
        "spark.sql.shuffle.partitions": str(wanted),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(
            2 * PARTITION_BYTES
        ),
    }


def build_session(
    app_name: str = "paygrain",
    master: str | None = None,
    shuffled_bytes: int | None = None,
    **settings: str,
) -> SparkSession:
    """Get or create a session; ``settings`` use ``__`` for dots in key names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    sized = settings_for(shuffled_bytes) if shuffled_bytes else {}
    for key, value in {**DEFAULTS, **sized}.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
