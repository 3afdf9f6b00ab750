"""Session factory shared by tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "assaykit", cores: int | None = None, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC; on a cluster use the one that spark-submit configures."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or '*'}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
