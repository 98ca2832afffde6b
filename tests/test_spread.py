"""Sessions and as-of joins, whose rows are spread over periods, against brute force; range joins."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators.joins import asof_join, range_join
from tidemill.operators.sessions import session_summary, sessionize

START = datetime(1969, 12, 28)


def moments(n, seed, kind):
    """One key has most rows, some rows have no key or no time, many times are equal, and some days have no rows."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        key = r.choice([1, 1, 1, 1, 2, 3, None])
        at = START + timedelta(days=r.choice([0, 0, 1, 1, 2, 7, 8]), minutes=r.choice([0, 15, 60, 1430, 1439, r.randrange(1440)]))
        rows.append((i, key, None if r.random() < 0.05 else at if kind != "date" else at.date()))
    return rows


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("days", [1, 3])
def test_sessions_across_periods(spark, kind, days):
    rows = moments(300, 1, kind)
    got = {r["i"]: r["session_id"] for r in sessionize(spark.createDataFrame(rows, f"i int, k int, t {kind}"), ["k"], "t", days=days).collect()}
    want = {}
    for key in {k for _, k, _ in rows}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] is not None, r[2] or START))
        number, last = sum(r[2] is None for r in mine), None
        for i, _, t in mine:
            if t is not None and (last is None or t - last > timedelta(minutes=30)):
                number += 1
            last = t
            want[i] = number
    assert got == want


@pytest.mark.parametrize("days", [1, 3])
def test_summary_is_that_of_numbered_rows(spark, days):
    rows = [(i, k, t, f"d{t}" if t else "x", i / 4) for i, k, t in moments(300, 5, "timestamp_ntz")]
    e = spark.createDataFrame(rows, "i int, k int, t timestamp_ntz, d string, v double")
    want = sessionize(e, ["k"], "t").groupBy("k", "session_id").agg(F.min("t"), F.to_date(F.min("t")), F.hour(F.min("t")), F.min_by("d", "t"), F.count("*"), F.sum(F.col("v").cast("decimal(18,2)")))
    got = session_summary(e, "k", "t", "d", "v", days=days)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert got.schema["total"].dataType.simpleString() == "decimal(28,2)"


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_asof_across_periods(spark, kind):
    left, right = moments(200, 2, kind), moments(60, 3, kind)
    l, r = spark.createDataFrame(left, f"i int, k int, t {kind}"), spark.createDataFrame(right, f"j int, rk int, rt {kind}")
    got = {x["i"]: x["j"] for x in asof_join(l, r, "k", "t", "rk", "rt", ["j"]).collect()}
    want = {}
    for i, k, t in left:
        fit = [(rt, j) for j, rk, rt in right if None not in (k, t, rk, rt) and rk == k and rt <= t]
        want[i] = max(fit)[1] if fit else None
    assert got == want
    assert asof_join(l, r.limit(0), "k", "t", "rk", "rt", ["j"]).filter("j is null").count() == 200
    assert asof_join(l.limit(0), r, "k", "t", "rk", "rt", ["j"]).count() == 0


def test_asof_by_numbers(spark):
    l = spark.createDataFrame([(1, 5), (1, 9), (2, 5)], "k int, t int")
    r = spark.createDataFrame([(1, 4, "a"), (1, 9, "b"), (1, 9, "c"), (2, 6, "d")], "rk int, rt int, v string")
    assert sorted(map(tuple, asof_join(l, r, "k", "t", "rk", "rt", ["v"]).fillna("-").collect())) == [(1, 5, "a"), (1, 9, "c"), (2, 5, "-")]


def test_one_key_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        e = spark.range(4000).select(F.lit(1).alias("k"), (F.lit(START) + F.make_dt_interval(mins=F.col("id") * 30)).alias("t"))
        for df in (sessionize(e, ["k"], "t"), asof_join(e, e.withColumnRenamed("t", "u"), "k", "t", "k", "u", ["u"])):
            held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert len(held) == 4 and sum(held) == 4000 and max(held) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_range_join(spark):
    r = random.Random(4)
    points = [(i, r.uniform(-50, 50)) for i in range(80)] + [(80, None), (81, 10.0)]
    ranges = [(i, low, low + r.choice([0.0, 3.0, 40.0])) for i, low in enumerate([r.uniform(-60, 50) for _ in range(30)] + [10.0])] + [(40, None, 5.0), (41, 5.0, None)]
    found = range_join(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(ranges, "q int, low double, high double"), "at", "low", "high", 10.0)
    want = sorted((p, q) for p, at in points for q, low, high in ranges if None not in (at, low, high) and low <= at < high)
    assert sorted((x["p"], x["q"]) for x in found.collect()) == want
