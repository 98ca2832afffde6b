"""Spark sessions as the engine expects them: UTC, ANSI, adaptive plans, partition overwrite by partition."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemill.errors import ConfigError
from tidemill.plans.project import Target

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def open_session(target: Target | None = None, **conf: str) -> SparkSession:
    """A session for a target: local or clustered by ``master``, remote by ``connect_url``."""
    target = target or Target("dev", master="local[*]")
    builder = SparkSession.builder.appName("tidemill")
    if target.type == "connect":
        if not target.connect_url:
            raise ConfigError(f"target {target.name!r}: connect_url is missing")
        builder = builder.remote(target.connect_url)
    elif target.master:
        builder = builder.master(target.master)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if target.catalog:
        spark.catalog.setCurrentCatalog(target.catalog)
    return spark
