"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "freshet", **settings) -> SparkSession:
    """UTC, ANSI and adaptive execution on; ``settings`` override (dots as double underscores)."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # whole texts pass through Arrow: small batches bound what a task holds at once
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    } | {k.replace("__", "."): str(v) for k, v in settings.items()}
    builder = SparkSession.builder.appName(app)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
