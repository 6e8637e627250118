"""A local session for tests and the bench; a cluster brings its own.

`ENGINE_CONF` is worth setting on a cluster too.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM never compiles methods above 8000 bytes: fall back to split expressions
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # quantile aggregates keep hashing with this many groups per task before they sort
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def local_session(cores: int | str = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    """`scratch`: folder of intermediate tables (`spark.checkpoint.dir`), else the warehouse's."""
    builder = SparkSession.builder
    if scratch is not None:
        builder = builder.config("spark.checkpoint.dir", scratch)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("runlens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
