"""The session that the engine's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "seriatim", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` and further settings only where given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
