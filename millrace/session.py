"""The Spark session with the engine's defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Timestamps have no zone, identifiers fold case, overwriting a partitioned table replaces the partitions given.
CONF = {
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.orc.filterPushdown": "true",
    "spark.sql.cbo.enabled": "true",
}


def session(app: str = "millrace", **more: str) -> SparkSession:
    """A session with CONF; settings in ``more`` (dots as double underscores) win."""
    conf = CONF | {k.replace("__", "."): v for k, v in more.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Set CONF on a session that exists."""
    for k, v in CONF.items():
        spark.conf.set(k, v)
    return spark
