"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# A shuffle partition of this size sorts and aggregates in an executor's memory.
PARTITION_BYTES = 256 * 1024 * 1024


def sized_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for an input of this size: enough shuffle partitions to keep each
    near PARTITION_BYTES, at least one per core. Adaptive execution merges the ones
    a smaller shuffle does not need and splits the skewed ones of a join."""
    partitions = max(cores, -(-input_bytes // PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
    }


def build_session(app: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
