"""As-of and range joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.buckets import bucket


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, right_key: str, right_time: str, payload: list[str], days: int = 1) -> DataFrame:
    """Every left row with the payload of the latest right row of its key that isn't later (nulls without one, and for null keys and times). Of right rows of
    equal time it is the one whose payload is last in order.

    Both sides are merged by time in one shuffle by key and period of ``days`` days, and the last right row seen is carried on; no pairs are made and a key with
    many rows is many tasks. Only the last right row of each key and period is ordered by key alone, for periods that begin without one."""
    row = F.struct(F.col(right_time).alias("__at"), *payload)
    l = left.select(F.col(key).alias("__k"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    r = right.select(F.col(right_key).alias("__k"), F.col(right_time).cast(left.schema[time].dataType).alias("__t"), F.lit(0).alias("__side"), row.alias("__r"))
    both = l.unionByName(r.filter("__k is not null and __t is not null"), allowMissingColumns=True)
    both = both.withColumn("__b", bucket(both, "__t", days))
    within = Window.partitionBy("__k", "__b").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__r", ignorenulls=True).over(within)).filter("__side = 1")
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.filter("__k is not null and __t is not null").groupBy("__k", "__b").agg(F.max("__r").alias("__r"))
    carried = ends.select("__k", "__b", F.last("__r", ignorenulls=True).over(before).alias("__carried"))
    found = seen.join(carried, ["__k", "__b"], "left").withColumn("__seen", F.coalesce("__seen", "__carried"))
    return found.select("__l.*", *[F.col(f"__seen.{p}").alias(p) for p in payload])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= at < high, by an equi-join on buckets of ``width``: a range meets only the buckets that it touches."""
    bucket: Column = F.floor(F.col(at) / width)
    p = points.withColumn("__b", bucket)
    r = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, (p["__b"] == r["__b"]) & (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__b")
