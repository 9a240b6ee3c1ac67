"""The session that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "oxbow", **conf: str) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution; conf: further settings, dots written as double underscores."""
    b = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
