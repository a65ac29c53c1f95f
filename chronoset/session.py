"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "chronoset", **options: str) -> SparkSession:
    """A session with the library's defaults; options come on top of them."""
    builder = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | options).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
