"""Buckets of time, which spread the rows of one key over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

DAY = 86_400


def bucket(df: DataFrame, time: str, days: int) -> Column:
    """The number of the period of ``days`` days that a time falls into, never smaller for a later time; null times are in the first one of all.
    Times of other types than dates and timestamps are all in one."""
    kind = df.schema[time].dataType
    if isinstance(kind, TimestampType):
        number = F.floor(F.unix_seconds(F.col(time)) / (DAY * days))
    elif isinstance(kind, (TimestampNTZType, DateType)):
        number = F.floor(F.unix_date(F.to_date(F.col(time))) / days)
    else:
        number = F.when(F.col(time).isNotNull(), F.lit(0).cast("long"))
    return F.coalesce(number, F.lit(-(1 << 62)))
