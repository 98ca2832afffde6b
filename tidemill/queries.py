"""Registry of the engine's queries, with the SQL that gives the same rows.

Most queries are projects of one model or more, compiled and resolved by the engine over the given tables. ``{events}`` stands
for ``mill.ref('events')`` in a model and for the table itself in the SQL beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import metrics
from tidemill.functions.udfs import Functions
from tidemill.operators import incremental, joins, sessions
from tidemill.plans import project as projects
from tidemill.plans import rules
from tidemill.runner import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NOTE = "-- @allow_rewrite: qualify\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str, models: dict[str, str], **rest) -> Session:
    """A project of texts over the tables of a folder."""
    refs = {t: f"mill.ref('{t}')" for t in TABLES}
    texts = {n: s.format(**refs) for n, s in models.items()}
    sources = {f"raw.{t}": projects.SourceTable("raw", t) for t in TABLES}
    project = projects.from_sql(texts, sources=sources)
    used = {r.name for m in project.models.values() for r in m.refs}
    return Session(spark, project, {t: table(spark, sf_dir, t) for t in TABLES if t in used}, **rest)


MONEY = "cast(sum(cast({0} as decimal(18,2))) as double)"
VALUE = MONEY.format("value")
SESSIONS = """
select user_id, ts, event_type, value, cast(sum(begins) over (partition by user_id order by ts) as bigint) as session_id
from (select *, case when prev is null or ts - prev > interval '30' minute then 1 else 0 end as begins
      from (select *, lag(ts) over (partition by user_id order by ts) as prev from {events}) a) b"""
SUMMARY = (
    "select user_id, session_id, cast(min(ts) as date) as opened_on, cast(extract(hour from min(ts)) as int) as opened_hour, "
    "min_by(event_type, ts) as first_type, count(*) as n, sum(cast(value as decimal(18,2))) as revenue from (" + SESSIONS + ") s group by user_id, session_id"
)

#: The same text in both engines.
PORTABLE: dict[str, str] = {
    "user_activity_comma_join": "select c.c_custkey, c.c_name, count(o.o_orderkey) as total from {customer} c, {orders} o where c.c_custkey = o.o_custkey group by c.c_custkey, c.c_name",
    "explicit_inner_join": "select o.o_orderkey, c.c_name from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_totalprice > 100000",
    "left_join_counts": "select c.c_custkey, count(o.o_orderkey) as n from {customer} c left join (select * from {orders} where o_orderpriority = '1-URGENT') o on c.c_custkey = o.o_custkey group by c.c_custkey",
    "right_join": "select n.n_name, count(s.s_suppkey) as n from {supplier} s right join {nation} n on s.s_nationkey = n.n_nationkey group by n.n_name",
    "full_join": "select a.k as a, b.k as b from (select distinct o_custkey as k from {orders} where o_orderpriority = '1-URGENT') a full join (select distinct o_custkey as k from {orders} where o_orderpriority = '5-LOW') b on a.k = b.k",
    "cross_join_dims": "select r.r_name, n.n_name from {region} r cross join {nation} n",
    "semi_join_active": "select c_custkey from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')",
    "anti_join_inactive": "select c_custkey from {customer} c where not exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')",
    "project_alias": "select e.event_id as id, e.user_id u, e.event_type as kind from {events} as e",
    "project_star": "select * from {nation}",
    "filter_and_or": "select event_id from {events} where event_type = 'click' and value > 50 or not event_type <> 'signup' and value <= 10",
    "filter_in_between_like": "select event_id from {events} where event_type in ('view', 'click') and value between 10 and 20 and event_type like 'v%'",
    "arithmetic_mod": "select l_orderkey, l_linenumber, l_quantity * 2 + l_linenumber as a, l_linenumber / 2 as half, l_orderkey % 10 as m from {lineitem} where (l_linenumber + 1) * 2 > 6",
    "case_searched": "select event_id, case when value > 100 then 'high' when value is null then 'none' else 'low' end as band from {events}",
    "case_simple": "select event_id, case (event_id % 3) when 0 then 'page_view' when 1 then 'click' else 'scroll' end as kind from {events}",
    "is_null_coalesce": "select event_id, coalesce(nullif(event_type, 'error'), 'none') as kind, event_type is null as missing from {events}",
    "scalar_subquery_cardinalities": "select (select count(distinct user_id) from {events}) as users, (select count(distinct event_type) from {events}) as types, (select count(distinct user_id) from {events}) * (select count(distinct event_type) from {events}) as product",
    "derived_table_group_count": "select count(*) as n from (select user_id, event_type from {events} group by user_id, event_type) t",
    "cte_chain": "with a as (select user_id, value from {events} where value > 10), b as (select user_id, count(*) as n from a group by user_id), c as (select n, count(*) as users from b group by n) select * from c",
    "correlated_scalar_subquery": "select c_custkey, (select max(o_totalprice) from {orders} o where o.o_custkey = c.c_custkey) as top from {customer} c",
    "count_distinct_multi": "select event_type, count(distinct user_id) as users, count(distinct cast(ts as date)) as days, count(*) as n from {events} group by event_type",
    "global_agg": "select count(*) as n, count(distinct user_id) as users, min(ts) as first_ts, max(ts) as last_ts, " + VALUE + " as total from {events}",
    "distinct_keys": "select distinct user_id, event_type from {events}",
    "group_by_ordinal": "select event_type, cast(ts as date) as day, count(*) as n from {events} group by 1, 2",
    "group_by_alias": "select user_id, cast(ts as date) as day_of, count(*) as n from {events} where event_type = 'view' group by user_id, day_of",
    "having_filter": "select user_id, count(*) as n from {events} group by user_id having count(*) > 60",
    "avg_by_type": "select event_type, " + VALUE + " / count(value) as mean from {events} group by event_type",
    "min_max_stats": "select l_returnflag, min(l_quantity) as low, max(l_quantity) as high, count(l_tax) as n from {lineitem} group by l_returnflag",
    "sessionize_window": SESSIONS,
    "daily_sessions_by_user": "select opened_on, user_id, count(*) as sessions, cast(sum(n) as bigint) as events, cast(sum(revenue) as double) as revenue from (" + SUMMARY + ") x group by opened_on, user_id",
    "sessions_by_first_type": "select first_type, count(*) as sessions, cast(sum(n) as bigint) as events, cast(sum(revenue) as double) as revenue, cast(sum(revenue) as double) / count(*) as mean from (" + SUMMARY + ") x group by first_type",
    "revenue_by_session_hour": "select opened_hour, count(*) as sessions, cast(sum(revenue) as double) as revenue from (" + SUMMARY + ") x group by opened_hour",
    "four_dim_group_topk": "select user_id, event_type, cast(ts as date) as day, cast(extract(hour from ts) as int) as hour, count(*) as n, " + VALUE + " as total from {events} group by user_id, event_type, cast(ts as date), cast(extract(hour from ts) as int) order by n desc, user_id, event_type, day, hour limit 20",
    "dimension_split_union": "select 'user' as dimension, cast(user_id as string) as key, count(*) as n, " + VALUE + " as total from {events} group by user_id union all select 'type', event_type, count(*), " + VALUE + " from {events} group by event_type",
    "row_number_dedupe": "select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id) as k from {events}) t where k = 1",
    "rank_frames": "select event_id, cast(rank() over (partition by user_id order by event_type) as bigint) as r, cast(dense_rank() over (partition by user_id order by event_type) as bigint) as d, cast(ntile(4) over (partition by user_id order by ts, event_id) as bigint) as q from {events}",
    "lag_lead": "select event_id, lag(event_type) over (partition by user_id order by ts, event_id) as before, lead(event_type, 2) over (partition by user_id order by ts, event_id) as later from {events}",
    "running_total_rows": "select event_id, cast(sum(cast(value as decimal(18,2))) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as double) as s from {events}",
    "order_limit_topk": "select o_orderkey, o_totalprice from {orders} order by o_totalprice desc, o_orderkey limit 25",
    "order_offset": "select o_orderkey from {orders} order by o_orderkey limit 10 offset 5",
    "union_all_topk": "select * from (select user_id as k, count(*) as n from {events} group by user_id union all select o_custkey, count(*) from {orders} group by o_custkey) t order by n desc, k limit 30",
    "union_distinct": "select n_regionkey as k from {nation} union select r_regionkey from {region}",
    "intersect_q": "select user_id from {events} where event_type = 'view' intersect select user_id from {events} where event_type = 'click'",
    "except_q": "select c_custkey as k from {customer} except select o_custkey from {orders} where o_orderpriority = '1-URGENT'",
    "date_trunc_day": "select event_id, cast(date_trunc('day', ts) as date) as day from {events}",
    "extract_hour": "select event_id, cast(extract(hour from ts) as int) as hour from {events}",
    "interval_compare": "select event_id from {events} where ts > timestamp '2024-01-15 00:00:00' + interval '36' hour",
    "concat_op": "select n_nationkey, n_name || '-' || cast(n_regionkey as string) as label from {nation}",
    "cube_q": "select event_type, cast(extract(hour from ts) as int) as hour, count(*) as n from {events} group by cube (event_type, cast(extract(hour from ts) as int))",
    "rollup_q": "select r_name, n_name, count(*) as n from {nation} n join {region} r on n.n_regionkey = r.r_regionkey group by rollup (r_name, n_name)",
    "grouping_sets_q": "select user_id, event_type, count(*) as n from {events} group by grouping sets ((user_id), (event_type))",
    "recursive_cte": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 5) select n from t",
    "from_less_select": "select 1 as id, 'test' as name",
    "avg_quantity_by_flag": "select l_returnflag, l_linestatus, avg(l_quantity) as mean, avg(case when l_linenumber > 4 then l_quantity end) as late from {lineitem} group by l_returnflag, l_linestatus",
    "four_dim_avg": "select l_returnflag, l_linestatus, l_linenumber, cast(extract(year from l_shipdate) as int) as y, count(*) as n, avg(l_quantity) as mean from {lineitem} group by l_returnflag, l_linestatus, l_linenumber, cast(extract(year from l_shipdate) as int)",
    "spread_by_flag": "select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sp, round(var_samp(l_quantity), 4) as vs, round(var_pop(l_quantity), 4) as vp from {lineitem} group by l_returnflag",
    "first_active_day": "select user_id, cast(date_trunc('day', min(ts)) as date) as first_day, cast(date_trunc('month', max(ts)) as date) as last_month from {events} group by user_id",
    "four_way_product": "select r.r_name, n.n_name, s.s_suppkey, e.kind from {region} r, {nation} n, (select s_suppkey from {supplier} where s_suppkey <= 4) s, (select distinct event_type as kind from {events}) e where (r.r_regionkey * 7 + n.n_nationkey * 3 + s.s_suppkey) % 11 = 0 order by r.r_name, n.n_name, s.s_suppkey, e.kind limit 200",
    "lateral_join": "select n.n_name, t.k, t.twice from {nation} n, lateral (select n.n_regionkey + 1 as k, n.n_nationkey * 2 as twice) t",
    "intersect_all_q": "select event_type, user_id from {events} where value > 50 intersect all select event_type, user_id from {events} where value < 200",
    "except_all_q": "select event_type, user_id from {events} except all select event_type, user_id from {events} where value < 100",
    "range_frames": "select event_id, cast(sum(event_id) over (partition by event_type order by event_id range between 100 preceding and 50 following) as bigint) as s, count(*) over (partition by event_type order by event_id range between unbounded preceding and current row) as n from {events}",
    "rank_values": "select event_id, percent_rank() over (partition by user_id order by ts, event_id) as p, cume_dist() over (partition by user_id order by ts, event_id) as c, first_value(event_type) over (partition by user_id order by ts, event_id) as f, last_value(event_type) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as l, nth_value(event_type, 2) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as second from {events}",
    "limit_unordered": "select count(*) as n from (select event_id from {events} limit 100) t",
    "today_q": "select current_date >= date '2024-01-01' as later",
    "string_functions": "select n_nationkey, upper(n_name) as u, lower(n_name) as l, length(n_name) as n, substring(n_name, 2, 3) as s, replace(n_name, 'A', 'x') as r, trim('  ' || n_name || ' ') as t, lpad(n_name, 12, '.') as p, reverse(n_name) as b, instr(n_name, 'A') as i from {nation}",
    "math_functions": "select l_orderkey, l_linenumber, abs(l_quantity - 25) as a, cast(ceil(l_extendedprice) as bigint) as c, cast(floor(l_extendedprice) as bigint) as f, round(sqrt(l_quantity), 6) as r, power(l_quantity, 2) as p, sign(l_quantity - 25) as s, greatest(l_linenumber, 3) as g, least(l_linenumber, 3) as e from {lineitem}",
    "theta_range_join": "select e.event_id, count(*) as n from {events} e join {orders} o on e.user_id = o.o_custkey and o.o_totalprice > e.value * 1000 group by e.event_id",
}

#: Foreign texts that the engine rewrites: (model, SQL in DuckDB's dialect).
REWRITTEN: dict[str, tuple[str, str]] = {
    "first_by_order": ("select user_id, first(event_type order by ts) as kind from {events} group by user_id",) * 2,
    "last_by_order": ("select user_id, last(event_type order by ts) as kind from {events} group by user_id",) * 2,
    "row_number_bare": ("select max(k) as last, count(distinct k) as n from (select row_number() over () as k from {events}) t", "select cast(max(k) as int) as last, count(distinct k) as n from (select row_number() over () as k from {events}) t"),
    "ref_limit": ("select count(*) as n from mill.ref('events', limit => 50)", "select 50 as n"),
    "map_values": ("select event_id, map('kind', event_type, 'user', cast(user_id as string))['kind'] as kind, size(split(event_type, 'i')) as parts from {events}", "select event_id, event_type as kind, len(string_split(event_type, 'i')) as parts from {events}"),
    "cast_double_colon": ("select event_id::varchar as id, value::decimal(10,2)::double as v, null::varchar as none from {events}",) * 2,
    "qualify_rewrite": (
        NOTE + "select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as k from {events} qualify k <= 2",
        "select user_id, event_id, cast(row_number() over (partition by user_id order by value desc, event_id) as int) as k from {events} qualify k <= 2",
    ),
    "unnest_range": ("select unnest(range(1, 1001)) as n", "select cast(unnest(range(1, 1001)) as int) as n"),
    "generate_series_rows": ("select unnest(generate_series(1, 100)) as n", "select cast(unnest(generate_series(1, 100)) as int) as n"),
    "unnest_list": ("select unnest(['US', 'UK', 'CA']) as country",) * 2,
    "date_add_days": ("select event_id, cast(cast(ts as date) + interval (event_id % 7) day as date) as d from {events}", "select event_id, cast(cast(ts as date) + interval (event_id % 7) day as date) as d from {events}"),
    "timestamp_add_hours": ("select event_id, timestamp_ntz '2024-01-01 00:00:00' + interval (event_id) hour as t from {events}", "select event_id, timestamp '2024-01-01 00:00:00' + interval (event_id) hour as t from {events}"),
    "ref_filter": ("select event_id, value from mill.ref('events', filter => event_type = 'click' and value > 100)", "select event_id, value from events where event_type = 'click' and value > 100"),
    "ref_partitions": ("select user_id, count(*) as n from mill.ref('events', partitions => event_type in ['view', 'click']) group by user_id", "select user_id, count(*) as n from events where event_type in ('view', 'click') group by user_id"),
    "ref_inline": ("select count(*) as n from mill.ref('orders', inline => true)", "select count(*) as n from orders"),
    "ref_in_join": ("select c.c_custkey, o.o_orderkey from mill.ref(\"customer\") c join mill.ref('orders', filter => o_totalprice > 200000) o on c.c_custkey = o.o_custkey", "select c.c_custkey, o.o_orderkey from customer c join orders o on c.c_custkey = o.o_custkey where o_totalprice > 200000"),
    "pivot_q": ("select * from (select user_id, event_type from {events}) pivot (count(*) for event_type in ('view' as v, 'click' as c))", "select user_id, count(*) filter (event_type = 'view') as v, count(*) filter (event_type = 'click') as c from {events} group by user_id"),
    "json_props": ("select event_id, cast(get_json_object(props, '$.k') as bigint) as k from {events}", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from {events}"),
    "string_aggregates": ("select r_name, array_join(sort_array(collect_list(n_name)), ',') as names from {nation} n join {region} r on n_regionkey = r_regionkey group by r_name", "select r_name, string_agg(n_name, ',' order by n_name) as names from {nation} n join {region} r on n_regionkey = r_regionkey group by r_name"),
}

CHAIN = {
    "user_day": "select user_id, cast(date_trunc('day', ts) as date) as session_id, count(*) as n from {events} where event_type = 'view' group by user_id, session_id",
    "user_stats": "select user_id, count(*) as sessions, cast(sum(n) as bigint) as total_events from mill.ref('user_day') group by user_id",
}


def _model(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir, {"q": sql}).frame("q")


def model_chain_user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, CHAIN).frame("user_stats")


def asof_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, o = table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    found = joins.asof_join(e, o.withColumn("order_ts", F.col("o_orderdate")), "user_id", "ts", "o_custkey", "o_orderdate", ["order_ts"])
    return found.select("event_id", F.col("order_ts").alias("last_order"))


def sessionize_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    found = sessions.session_rows(e, ["user_id"], "ts", [F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("revenue")])
    return found.select("user_id", "session_start", "n", F.col("revenue").cast("double").alias("revenue"))


def _shared(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A session model over the one aggregate that all session models share."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = sessions.session_summary(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "value")
        money = F.sum("total").cast("double")
        if name == "daily_sessions_by_user":
            return s.groupBy("opened_on", "user_id").agg(F.count("*").alias("sessions"), F.sum("n_rows").alias("events"), money.alias("revenue"))
        if name == "sessions_by_first_type":
            return s.groupBy(F.col("first_dimension").alias("first_type")).agg(F.count("*").alias("sessions"), F.sum("n_rows").alias("events"), money.alias("revenue"), (money / F.count("*")).alias("mean"))
        return s.groupBy("opened_hour").agg(F.count("*").alias("sessions"), money.alias("revenue"))

    return query


def dimension_split_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "user", "event_type": "type"})
    split = rules.split_dimensions(e, ["user", "type"], {"n": "count(*)", "total": "sum(cast(value as decimal(18,2)))"})
    return split.withColumn("total", F.col("total").cast("double"))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    a = r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return a.unionByName(n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("parent")), allowMissingColumns=True)


def unpivot_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "what", "share")


def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0))
    return incremental.merged(c, new, ["c_custkey"])


def metric_revenue_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.Metric("revenue", "sum", "cast(value as decimal(18,2))", time="ts")
    return metrics.by_grain(table(spark, sf_dir, "events"), m).select("period", F.col("revenue").cast("double").alias("revenue"))


def metric_mau_trailing28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trailing(table(spark, sf_dir, "events"), metrics.Metric("users", "count_distinct", "user_id", time="ts"), 28)


def metric_in_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = metrics.Metrics()
    known.define("buyers", "count_distinct", "user_id", time="ts")
    return session(spark, sf_dir, {"q": "select event_type, mill.metric('buyers', for => value > 50) as buyers from {events} group by event_type"}, metrics=known).frame("q")


def first_touch_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    touches = e.filter("event_type = 'click'").select(F.col("user_id").alias("t_user"), F.col("ts").alias("t_ts"))
    found = metrics.first_touch(touches.withColumnRenamed("t_user", "user_id"), buys, "user_id", "t_ts", "ts")
    return found.select("event_id", F.col("first_touch.t_ts").alias("touch_ts"))


def first_touch_equal_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions without an id: several of a user and day are equal rows, and stay as many."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    buys = e.filter("event_type = 'purchase'").select("user_id", (day + F.expr("interval 1 day")).alias("bought"))
    touches = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("t_ts"))
    found = metrics.first_touch(touches, buys, "user_id", "t_ts", "bought", 3)
    return found.select("user_id", "bought", F.col("first_touch.t_ts").alias("touch_ts"))


def range_join_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(60).select(F.col("id").alias("band"), (F.col("id") * 10.0).alias("low"), (F.col("id") * 10.0 + 15.0).alias("high"))
    found = joins.range_join(table(spark, sf_dir, "events").select("event_id", "value"), bands, "value", "low", "high", 10.0)
    return found.select("event_id", "band")


def udf_in_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = Functions()
    known.define("mill_score", lambda v, n: v * 2 + n, "double")
    return session(spark, sf_dir, {"q": "select event_id, mill_score(value, cast(user_id as double)) as score from {events}"}, functions=known).frame("q")


def inline_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = CHAIN | {"user_stats": CHAIN["user_stats"].replace("mill.ref('user_day')", "mill.ref('user_day', inline => true)")}
    return session(spark, sf_dir, chain).frame("user_stats")


def approx_distinct_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.008).alias("users"))


def ref_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir, {"q": "select event_id from mill.ref('events', sample => 0.1)"}).frame("q")


def inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS t(id, name)")


SESSION_ROWS_SQL = "select user_id, min(ts) as session_start, count(*) as n, " + VALUE + " as revenue from (" + SESSIONS + ") s group by user_id, session_id"
PLAIN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "model_chain_user_stats": (model_chain_user_stats, "select user_id, count(*) as sessions, cast(sum(n) as bigint) as total_events from (select user_id, cast(ts as date) as d, count(*) as n from {events} where event_type = 'view' group by 1, 2) t group by user_id"),
    "asof_join_events": (asof_join_events, "select e.event_id, max(o.o_orderdate) as last_order from {events} e left join {orders} o on e.user_id = o.o_custkey and o.o_orderdate <= e.ts group by e.event_id"),
    "sessionize_native": (sessionize_native, SESSION_ROWS_SQL),
    "shared_daily_sessions_by_user": (_shared("daily_sessions_by_user"), PORTABLE["daily_sessions_by_user"]),
    "shared_sessions_by_first_type": (_shared("sessions_by_first_type"), PORTABLE["sessions_by_first_type"]),
    "shared_revenue_by_session_hour": (_shared("revenue_by_session_hour"), PORTABLE["revenue_by_session_hour"]),
    "dimension_split_grouping_sets": (dimension_split_grouping_sets, PORTABLE["dimension_split_union"]),
    "union_by_name": (union_by_name, "select r_regionkey as k, r_name as name, cast(null as int) as parent from {region} union all select n_nationkey, n_name, n_regionkey from {nation}"),
    "unpivot_q": (unpivot_q, "select l_orderkey, l_linenumber, 'l_discount' as what, l_discount as share from {lineitem} union all select l_orderkey, l_linenumber, 'l_tax', l_tax from {lineitem}"),
    "incremental_upsert": (incremental_upsert, "select c_custkey, c_name, case when c_custkey % 10 = 0 then cast(0 as double) else c_acctbal end as c_acctbal from {customer}"),
    "metric_revenue_daily": (metric_revenue_daily, "select cast(ts as date) as period, " + VALUE + " as revenue from {events} group by 1"),
    "metric_mau_trailing28": (metric_mau_trailing28, "select d.day, count(distinct e.user_id) as users from (select distinct cast(ts as date) as day from {events}) d join {events} e on cast(e.ts as date) between d.day - interval '27' day and d.day group by d.day"),
    "metric_in_model": (metric_in_model, "select event_type, count(distinct user_id) filter (value > 50) as buyers from {events} group by event_type"),
    "first_touch_attribution": (first_touch_attribution, "select b.event_id, min(t.ts) as touch_ts from (select * from {events} where event_type = 'purchase') b left join (select * from {events} where event_type = 'click') t on t.user_id = b.user_id and t.ts <= b.ts and t.ts >= b.ts - interval '30' day group by b.event_id"),
    "first_touch_equal_conversions": (first_touch_equal_conversions, "select b.user_id, b.bought, (select min(t.ts) from {events} t where t.event_type = 'click' and t.user_id = b.user_id and t.ts <= b.bought and t.ts >= b.bought - interval '3' day) as touch_ts from (select user_id, date_trunc('day', ts)::timestamp + interval '1' day as bought from {events} where event_type = 'purchase') b"),
    "range_join_bands": (range_join_bands, "select event_id, band from {events} join (select i as band, i * 10.0::double as low, i * 10.0::double + 15 as high from range(60) t(i)) b on value >= low and value < high"),
    "udf_in_model": (udf_in_model, "select event_id, value * 2 + user_id as score from {events}"),
    "inline_hint": (inline_hint, "select user_id, count(*) as sessions, cast(sum(n) as bigint) as total_events from (select user_id, cast(ts as date) as d, count(*) as n from {events} where event_type = 'view' group by 1, 2) t group by user_id"),
    "approx_distinct_users": (approx_distinct_users, None),
    "ref_sample": (ref_sample, None),
    "inline_values": (inline_values, "select * from (values (1, 'a'), (2, 'b'), (3, 'c')) as t(id, name)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: _model(s) for n, s in PORTABLE.items()}
    found |= {n: _model(s) for n, (s, _) in REWRITTEN.items()}
    return found | {n: f for n, (f, _) in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    bare = {t: t for t in TABLES}
    found = dict(PORTABLE) | {n: s for n, (_, s) in REWRITTEN.items()} | {n: s for n, (_, s) in PLAIN.items() if s}
    return {n: s.format(**bare) for n, s in found.items()}
