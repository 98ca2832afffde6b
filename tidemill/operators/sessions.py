"""Sessions by gaps: a row begins a session if there is no earlier one of its key or it is more than the gap after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.buckets import bucket


def sessionize(df: DataFrame, keys: list[str], time: str, gap: str = "30 minutes", name: str = "session_id", days: int = 1) -> DataFrame:
    """All rows with the number of their session within their key. Rows of equal time share a session; null keys are a key; each row without a time
    begins a session, before all others.

    Rows are shuffled by key and period of ``days`` days, so a key with many rows is many tasks. Only a row for each key and period
    is ordered by key alone: it says whether the period's first row goes on with a session, and how many sessions came before."""
    rows = df.withColumns({"__k": F.struct(*keys), "__b": bucket(df, time, days)})
    numbered = _begins(rows, time, gap).withColumn("__n", F.sum("__begins").over(Window.partitionBy("__k", "__b").orderBy(time)))
    period = _begins(rows.select("__k", "__b", time), time, gap).groupBy("__k", "__b").agg(F.min(time).alias("__low"), F.max(time).alias("__high"), F.sum("__begins").alias("__all"))
    by_key = Window.partitionBy("__k").orderBy("__b")
    last = F.lag("__high").over(by_key)
    new = F.when(F.col("__low").isNotNull() & (last.isNull() | (F.col("__low") - last > F.expr(f"interval {gap}"))), 1).otherwise(0)
    earlier = period.withColumn("__new", new).select("__k", "__b", (F.sum(F.col("__all") + F.col("__new")).over(by_key) - F.col("__all")).alias("__base"))
    return numbered.join(earlier, ["__k", "__b"]).select(*df.columns, (F.col("__base") + F.col("__n")).cast("bigint").alias(name))


def _begins(rows: DataFrame, time: str, gap: str) -> DataFrame:
    """1 where a session begins within a period; the first row of a period has 0, unless it has no time."""
    before = F.lag(time).over(Window.partitionBy("__k", "__b").orderBy(time))
    return rows.withColumn("__begins", F.when(F.col(time).isNull() | (F.col(time) - before > F.expr(f"interval {gap}")), 1).otherwise(0))


def session_rows(df: DataFrame, keys: list[str], time: str, aggregates: list, gap: str = "30 minutes") -> DataFrame:
    """One row for each session, by Spark's own session windows: keys, session_start, and the aggregates. Null times have no session. A row
    exactly one gap later is in the same session."""
    ltz = df.filter(F.col(time).isNotNull()).withColumn("__t", F.col(time).cast("timestamp"))
    width = F.session_window("__t", F.lit(gap))
    return ltz.groupBy(*keys, width.alias("__w")).agg(F.min(time).alias("session_start"), *aggregates).drop("__w")


def session_summary(events: DataFrame, user: str, time: str, dimension: str, value: str, gap: str = "30 minutes", days: int = 1) -> DataFrame:
    """The aggregate that several session models share: one row for each user and session, with every dimension any of them needs. Sessions are those of
    ``sessionize``, rows without a time one session.

    The input is read once and shuffled by user and period of ``days`` days; each period's sessions are aggregated there, and only these pieces are ordered by user
    alone. A user has at most as many as gaps and periods fit into the time, whatever the number of rows."""
    rows = events.withColumns({"__k": F.col(user), "__b": bucket(events, time, days)})
    numbered = _begins(rows, time, gap).withColumn("__n", F.sum("__begins").over(Window.partitionBy("__k", "__b").orderBy(time)))
    pieces = numbered.groupBy("__k", "__b", "__n").agg(
        F.min(time).alias("__low"),
        F.max(time).alias("__high"),
        F.min_by(dimension, time).alias("__first"),
        F.count("*").alias("__rows"),
        F.sum(F.col(value).cast("decimal(18,2)")).alias("__total"),
    )
    by_user = Window.partitionBy("__k").orderBy("__low")
    last = F.lag("__high").over(by_user)
    new = F.when(F.col("__low").isNull(), F.col("__rows")).when(last.isNull() | (F.col("__low") - last > F.expr(f"interval {gap}")), 1).otherwise(0)
    joined = pieces.withColumn("__new", new).withColumn("session_id", F.sum("__new").over(by_user))
    return joined.groupBy(F.col("__k").alias(user), "session_id").agg(
        F.min("__low").alias("session_start"),
        F.to_date(F.min("__low")).alias("opened_on"),
        F.hour(F.min("__low")).alias("opened_hour"),
        F.min_by("__first", "__low").alias("first_dimension"),
        F.sum("__rows").alias("n_rows"),
        F.sum("__total").cast("decimal(28,2)").alias("total"),
    )
