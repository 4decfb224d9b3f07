"""Session settings the library expects; a cluster's own settings win where they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on (UTC) or that every plan here is written for (adaptive execution).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    build = SparkSession.builder.master(f"local[{cores}]").appName("cairnfield")
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    return (
        build.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
