"""Session construction for local runs; on a cluster, use the session that is already there."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .cluster import local_scratch

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def local_session(
    name: str = "treeledger", cpus: int | str | None = None, partitions: int | str | None = None
) -> SparkSession:
    """A local session with UTC time and adaptive execution, for tests and the benchmark."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "8"
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", local_scratch("checkpoints"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
