"""Session settings that the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; settings that are given, or set by spark-submit, win over ours."""
    builder = SparkSession.builder.appName("tidemill").config(map={k: v for k, v in SETTINGS.items()} | settings)
    return (builder.master(master) if master else builder).getOrCreate()
