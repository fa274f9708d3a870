"""Spark session with the settings that the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "ratewright", **settings: str) -> SparkSession:
    """A session; ``settings`` come over :data:`SETTINGS`, the master comes from the launcher."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()
