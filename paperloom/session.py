"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Base64 without line breaks, zone-free results, and run-time planning.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
}


def build_session(name: str = "paperloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
