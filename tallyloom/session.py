"""A session with the settings that the operators' semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",  # money must raise on overflow, not wrap
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",  # a repeated key: the last one counts
}


def session(app: str = "tallyloom", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
