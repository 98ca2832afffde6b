"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line; beside them, as a yardstick, the same rows by DuckDB on as many
threads. Each is run once, so Spark's times hold planning and compilation."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "model_chain_user_stats", "user_activity_comma_join", "sessionize_window", "daily_sessions_by_user", "shared_daily_sessions_by_user", "sessions_by_first_type", "four_dim_group_topk",
    "dimension_split_union", "dimension_split_grouping_sets", "asof_join_events", "cube_q", "metric_mau_trailing28", "min_max_stats", "running_total_rows",
)


def yardstick(sf_dir: str, cpus: str) -> dict[str, float]:
    """Seconds that DuckDB takes for the queries' SQL (nothing where it isn't installed)."""
    try:
        import duckdb
    except ModuleNotFoundError:
        return {}
    from tidemill.queries import TABLES, oracle_sql

    known, times = oracle_sql(), {}
    with duckdb.connect(config={"threads": int(cpus)}) as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        for name in HEADLINE:
            began = time.perf_counter()
            c.execute(known[name]).fetchall()
            times[name] = round(time.perf_counter() - began, 3)
    return times


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemill.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = queries(), {}
    known["model_chain_user_stats"](spark, sf_dir).count()
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name, "duckdb": yardstick(sf_dir, cpus)}))


if __name__ == "__main__":
    main()
