"""Session defaults: UTC, adaptive plans, Arrow; settings that a cluster has made stay."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "stopwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; conf overrides them (dots as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
