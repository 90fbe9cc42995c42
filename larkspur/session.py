"""Spark sessions as the engine wants them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; anything else stays as the cluster sets it."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
