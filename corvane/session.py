"""The session that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corvane", **conf: str) -> SparkSession:
    """UTC, ANSI mode and adaptive execution on; cluster settings such as spark.checkpoint.dir are left to the caller."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()
