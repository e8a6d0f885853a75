"""The session settings that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "hitlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution with skew joins on; conf overrides (dots as __)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
