"""Run history: one small Parquet file for each run, and the trend of each model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.runner import Result

SCHEMA = "run_id string, model string, kind string, seconds double, n_rows long"


def record(spark: SparkSession, path: str, run_id: str, results: list[Result]) -> None:
    rows = [(run_id, r.model, r.kind, r.seconds, r.rows) for r in results]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def trend(spark: SparkSession, path: str) -> DataFrame:
    """Runs, average and longest time, and last known rows of each model."""
    return spark.read.parquet(path).groupBy("model").agg(F.count("*").alias("runs"), F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"), F.max_by("n_rows", "run_id").alias("last_rows"))
