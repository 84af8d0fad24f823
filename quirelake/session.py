"""A session set up for these plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quirelake", **conf: str) -> SparkSession:
    """Adaptive execution with skew joins; UTC, so that dates agree between engines. conf: further settings, _ for dots."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=base | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
