"""Sessions for jobs of this library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str, shared: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings that the plans expect: adaptive execution
    with skewed joins split, UTC, and the folder that driver and executors
    share. What the cluster or `settings` say comes first."""
    builder = SparkSession.builder.appName(name)
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    wanted |= {"spark.checkpoint.dir": shared} if shared else {}
    for key, value in (wanted | (settings or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
