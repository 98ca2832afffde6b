"""Streams: session and time windows with watermarks, and sinks that upsert by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_time(stream: DataFrame, time: str, late: str) -> DataFrame:
    """A stream whose time column bears a watermark; the column becomes a zoned timestamp, as Spark asks for."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def sessions(stream: DataFrame, keys: list[str], time: str, aggregates: list, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = F.session_window(time, gap)
    return event_time(stream, time, late).groupBy(*keys, w.alias("w")).agg(*aggregates).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *_names(aggregates))


def windows(stream: DataFrame, keys: list[str], time: str, aggregates: list, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling windows, or sliding ones with ``slide``."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return event_time(stream, time, late).groupBy(*keys, w.alias("w")).agg(*aggregates).select(*keys, F.col("w.start").alias("window_start"), *_names(aggregates))


def deduplicate(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    return event_time(stream, time, late).dropDuplicatesWithinWatermark(keys)


def _names(aggregates: list) -> list:
    return [F.col(a._jc.toString().rpartition(" AS ")[2].strip("`")) for a in aggregates]


def upsert_sink(stream: DataFrame, path: str, key: list[str], time: str, checkpoint: str) -> StreamingQuery:
    """Keeps what ``latest`` needs to tell the newest row of each key. A batch writes only its own newest rows, in a folder named by the batch, so a batch that runs
    again gives the same files and the cost of a batch doesn't grow with the table."""

    def put(batch: DataFrame, number: int) -> None:
        _newest(batch, key, [time]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def _newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in the order; of rows equal in it the one that is last by its other columns."""
    others = [c for c in rows.columns if c not in order and c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(*order, *others)).alias("r")).select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in rows.columns])


def latest(spark: SparkSession, path: str, key: list[str], time: str) -> DataFrame:
    """The newest row of each key that a sink has seen; of equal times that of the later batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return _newest(rows, key, [time, "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, to: str, key: list[str], time: str) -> None:
    """Writes the newest rows as batch -1 of a new folder, for a sink that has been stopped."""
    latest(spark, path, key, time).write.mode("overwrite").parquet(f"{to}/batch=-1")
