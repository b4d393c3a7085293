"""Session settings the engine is written for. On a cluster, pass them to spark-submit."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

# Broadcast joins, coalescing and skew splits are left to adaptive execution and its measured
# sizes; nothing in the engine forces a plan.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(
    cores: int | None = None, app: str = "kermesse", extra: Mapping[str, str] | None = None
) -> SparkSession:
    """Session for tests and benches on one machine."""
    cores = cores or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
