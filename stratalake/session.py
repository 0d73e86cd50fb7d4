"""Session settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),  # of file contents that go to a Python worker at once
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions are left to it and to the cluster's own settings."""
    builder = SparkSession.builder.appName("stratalake")
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
