"""Session defaults for the library; every setting can be overridden by the caller."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session that is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("barloom")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
