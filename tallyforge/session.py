"""The session that operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyforge", **conf) -> SparkSession:
    """UTC, adaptive execution with skew joins. Master, memory and shuffle partitions are the cluster's to say."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()
