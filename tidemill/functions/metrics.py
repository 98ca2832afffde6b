"""Metrics: named measures that expand to aggregate expressions, per grain or over a trailing period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.errors import CompilationError

#: Aggregates whose partial results can be merged, and those that can't.
DECOMPOSABLE = frozenset({"sum", "count", "min", "max", "avg"})
HOLISTIC = frozenset({"median", "percentile", "string_agg", "array_agg", "count_distinct", "mode"})
GRAINS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year", "hourly": "hour"}


@dataclass(frozen=True)
class Metric:
    name: str
    measure: str  # sum, count, count_distinct, avg, min, max
    column: str
    entity: str = ""
    time: str | None = None

    @property
    def decomposable(self) -> bool:
        return self.measure in DECOMPOSABLE

    def sql(self, approximate: bool = False) -> str:
        if self.measure == "count_distinct":
            return f"approx_count_distinct({self.column})" if approximate else f"count(DISTINCT {self.column})"
        if self.measure not in DECOMPOSABLE | {"median"}:
            raise CompilationError(f"metric {self.name!r}: {self.measure!r} is no measure")
        return f"{self.measure}({self.column})"


class Metrics(dict):
    """Metrics by name."""

    def define(self, name: str, measure: str, column: str, entity: str = "", time: str | None = None) -> Metric:
        self[name] = Metric(name, measure, column, entity, time)
        return self[name]

    def expression(self, name: str, params: dict[str, str]) -> str:
        """The aggregate that ``metric('name', ...)`` stands for in a select list."""
        if name not in self:
            raise CompilationError(f"there is no metric {name!r}")
        if held := sorted({"at", "grain"} & set(params)):
            raise CompilationError(f"metric('{name}'): {', '.join(held)} can't be said in a select list; group by the period, or use metrics.by_grain")
        unknown = set(params) - {"for", "allow_approximate"}
        if unknown:
            raise CompilationError(f"metric('{name}'): unknown parameter {', '.join(sorted(unknown))}")
        sql = self[name].sql(params.get("allow_approximate", "").lower() == "true")
        return f"{sql} FILTER (WHERE {params['for']})" if "for" in params else sql


def by_grain(df: DataFrame, metric: Metric, grain: str = "daily", dims: tuple[str, ...] = ()) -> DataFrame:
    """The metric for each period and combination of dimensions."""
    if grain not in GRAINS:
        raise CompilationError(f"{grain!r} is no grain; there are {', '.join(GRAINS)}")
    period = F.date_trunc(GRAINS[grain], metric.time)
    period = period.cast("timestamp_ntz") if grain == "hourly" else period.cast("date")
    return df.groupBy(period.alias("period"), *dims).agg(F.expr(metric.sql()).alias(metric.name))


def trailing(df: DataFrame, metric: Metric, days: int) -> DataFrame:
    """The metric over the ``days`` days that end with each day that has rows.

    Decomposable sums and counts go through daily partial results and a range window; distinct counts spread each (day, entity) once over
    the days that see it, after duplicates within a day are gone."""
    day = F.to_date(F.col(metric.time))
    days_seen = df.select(day.alias("day")).filter("day is not null").distinct()
    if metric.measure in ("sum", "count"):
        daily = df.filter(day.isNotNull()).groupBy(day.alias("day")).agg(F.expr(metric.sql()).alias("v"))
        near = daily.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("k"), "day", "v").select(F.date_add("day", F.col("k")).alias("day"), "v")
        return near.join(days_seen, "day", "left_semi").groupBy("day").agg(F.sum("v").alias(metric.name))
    if metric.measure != "count_distinct":
        raise CompilationError(f"{metric.measure} has no trailing form")
    daily = df.filter(day.isNotNull()).select(day.alias("day"), F.col(metric.column).alias("e")).distinct()
    near = daily.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("k"), "day", "e").select(F.date_add("day", F.col("k")).alias("day"), "e")
    return near.join(days_seen, "day", "left_semi").groupBy("day").agg(F.count_distinct("e").alias(metric.name))


def first_touch(touches: DataFrame, conversions: DataFrame, key: str, touch_time: str, conversion_time: str, days: int = 30) -> DataFrame:
    """Every conversion with the earliest touch within ``days`` days before it (null if there is none). Equal conversions stay as many rows as they are.

    Touches and conversions meet by key and by buckets of ``days`` days, so a key with many rows is spread over its buckets."""
    width = days * 86_400
    c = conversions.groupBy(*conversions.columns).agg(F.count("*").alias("__n")).withColumn("__b", F.floor(F.unix_timestamp(F.col(conversion_time).cast("timestamp")) / width))
    seconds = F.unix_timestamp(F.col(touch_time).cast("timestamp"))
    t = touches.withColumn("__t", F.explode(F.array(F.floor(seconds / width), F.floor(seconds / width) + 1)))
    t = t.select(F.col(key).alias("__k"), "__t", F.struct(touch_time, *[x for x in touches.columns if x != touch_time]).alias("touch"))
    before = (F.col(f"touch.{touch_time}") <= F.col(conversion_time)) & (F.col(f"touch.{touch_time}") >= F.col(conversion_time) - F.expr(f"interval {days} days"))
    met = c.join(t, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__t")) & before, "left")
    found = met.groupBy(*conversions.columns, "__n").agg(F.min("touch").alias("first_touch"))
    return found.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).drop("__n", "__k")
