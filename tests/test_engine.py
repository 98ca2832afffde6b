"""Runs, rules, increments and streams on small projects."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemill import cli
from tidemill.errors import CompilationError
from tidemill.functions import metrics
from tidemill.operators import incremental
from tidemill.plans import dialect, rules
from tidemill.plans import project as projects
from tidemill.runner import Backend, Runner
from tidemill.sources import catalog
from tidemill.streaming import events


@pytest.fixture
def backend(spark):
    b = Backend(spark, "engine")
    b.ensure_schema()
    return b


def test_setup_script_and_inserts(spark, backend):
    backend.script("""
        DROP TABLE IF EXISTS engine.people; -- a comment; with a mark
        CREATE TABLE engine.people (id INTEGER, name VARCHAR, since DATE, at TIMESTAMP, paid DECIMAL(10, 2));
        INSERT INTO engine.people VALUES (1, 'a;b', DATE '2024-01-01', TIMESTAMP '2024-01-01 10:00:00', 1.5), (2, 'b', NULL, NULL, NULL);
        CREATE TABLE IF NOT EXISTS engine.people AS SELECT 9 AS id;
        CREATE OR REPLACE TABLE engine.names AS SELECT name::varchar AS name FROM engine.people;
        CREATE OR REPLACE TABLE engine.names AS SELECT name::varchar AS name FROM engine.people;
    """)
    backend.insert("people", "SELECT 3, 'c', NULL, NULL, 2.25")
    assert backend.count("people") == 3 and backend.count("names") == 2
    kinds = dict(spark.table("engine.people").dtypes)
    assert kinds == {"id": "int", "name": "string", "since": "date", "at": "timestamp_ntz", "paid": "decimal(10,2)"}
    assert backend.create_table_if_missing("people", "SELECT 1 AS x") is None and backend.count("people") == 3
    backend.drop("typed")
    backend.declare("typed", {"a": "VARCHAR", "d": "DATE"}, ["d"])
    backend.declare("typed", {"other": "INTEGER"}, if_missing=True)
    backend.insert("typed", "VALUES ('x', DATE '2024-01-02')")
    assert backend.count("typed") == 1
    backend.truncate("typed")
    assert backend.count("typed") == 0 and backend.exists("typed")
    backend.create_table("typed", "SELECT 1 AS a")
    backend.create_view("typed", "SELECT 2 AS a")
    assert backend.kind("typed") == "view"
    backend.create_table("typed", "SELECT 3 AS a UNION ALL SELECT 4")
    assert backend.kind("typed") == "table" and backend.preview("typed", 1).count() == 1


def test_dimensions_in_one_scan(spark, tmp_path):
    rows = [("a", None, 1.0), ("a", "x", 2.0), (None, "x", 4.0)]
    spark.createDataFrame(rows, "p string, q string, v double").write.parquet(str(tmp_path / "t"))
    split = rules.split_dimensions(spark.read.parquet(str(tmp_path / "t")), ["p", "q"], {"s": "sum(v)"})
    assert split._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Expand") == 1
    assert {tuple(r) for r in split.collect()} == {("p", "a", 3.0), ("p", None, 4.0), ("q", None, 1.0), ("q", "x", 6.0)}


def models(**sql):
    return projects.from_sql(sql, sources={"engine.facts": projects.SourceTable("engine", "facts")}, default_materialization="table")


def test_shared_subplans_are_computed_once(spark, backend, monkeypatch):
    backend.create_table("facts", "SELECT id % 5 AS k, id AS v FROM range(1000)")
    part = "(SELECT k, sum(v) AS s, count(*) AS n FROM mill.ref('engine.facts') GROUP BY k) t"
    project = models(one=f"SELECT max(s) AS top FROM {part}", two=f"SELECT min(n) AS low FROM {part}")
    kept, share = [], rules.share
    monkeypatch.setattr(rules, "share", lambda *a: kept.extend(x := share(*a)) or x)
    Runner(spark, project, "engine").run()
    assert len(kept) == 1 and not kept[0].is_cached
    assert spark.table("engine.one").first()[0] == sum(range(4, 1000, 5)) and spark.table("engine.two").first()[0] == 200
    kept.clear()
    Runner(spark, project, "engine", optimize=False).run()
    assert not kept


def test_only_changed_models_run(spark, backend):
    backend.create_table("facts", "SELECT id AS v FROM range(10)")
    texts = {"a": "SELECT v FROM mill.ref('engine.facts')", "b": "SELECT sum(v) AS s FROM mill.ref('a')", "c": "SELECT 1 AS x", "d": "SELECT current_date AS today"}
    run = lambda: {r.model for r in Runner(spark, models(**texts), "engine", changed_only=True).run()}
    assert run() == {"a", "b", "c", "d"}
    assert run() == {"d"}
    texts["c"] = "SELECT 2 AS x"
    assert run() == {"c", "d"}
    backend.insert("facts", "VALUES (100)")
    spark.catalog.refreshTable("engine.facts")
    assert run() == {"a", "b", "d"} and spark.table("engine.b").first()[0] == 145


def test_semantic_rules_need_consent(spark, backend):
    backend.create_table("facts", "SELECT id % 7 AS v FROM range(100)")
    text = "SELECT count(DISTINCT v) AS n FROM mill.ref('engine.facts')"
    project = models(exact=text, rough="-- @approve: approximate_distinct\n" + text)
    r = Runner(spark, project, "engine")
    assert "approx_count_distinct(v)" in r.compiled("rough").sql and "count(DISTINCT v)" in r.compiled("exact").sql


def test_equal_conversions_stay_apart(spark):
    c = spark.createDataFrame([(1, 10), (1, 10), (2, 10)], "u int, s long").select("u", F.timestamp_seconds("s").alias("ct"))
    t = spark.createDataFrame([(1, 5), (1, 7)], "u int, s long").select("u", F.timestamp_seconds("s").alias("tt"))
    got = metrics.first_touch(t, c, "u", "tt", "ct").selectExpr("u", "unix_timestamp(first_touch.tt)").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 5), (1, 5), (2, None)]


def test_metric_parameters_are_not_ignored():
    known = metrics.Metrics()
    known.define("n", "count", "*")
    for p in ("at", "grain"):
        with pytest.raises(CompilationError):
            known.expression("n", {p: "daily"})


def test_upsert_keeps_partitions_and_the_old_table(spark, backend):
    backend.create_table("parts", "SELECT id AS k, id % 3 AS p, 'old' AS w FROM range(9)", ["p"])
    new = spark.createDataFrame([(0, "new", 2), (50, "new", 1)], "k long, w string, p long")
    incremental.upsert(spark, "engine.parts", new, ["k"])
    assert [c.name for c in spark.catalog.listColumns("engine.parts") if c.isPartition] == ["p"]
    assert {(r.k, r.w, r.p) for r in spark.table("engine.parts").collect()} == {(0, "new", 2), (50, "new", 1)} | {(i, "old", i % 3) for i in range(1, 9)}
    with pytest.raises(Exception, match="(?i)not_found|cannot be found"):
        incremental.swap(spark, "engine.none_such", "engine.parts", "engine.parts_old", False)
    assert spark.table("engine.parts").count() == 10


def test_overwrite_touches_its_partitions_only(spark, backend):
    backend.create_table("days", "SELECT id AS v, id % 4 AS d FROM range(8)", ["d"])
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    new = [spark.createDataFrame([(100 + d, d)], "v long, d long") for d in (1, 3)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda x: incremental.overwrite_partitions("engine.days", x, ["d"]), new))
    spark.catalog.refreshTable("engine.days")
    assert {(r.v, r.d) for r in spark.table("engine.days").collect()} == {(0, 0), (4, 0), (101, 1), (2, 2), (6, 2), (103, 3)}
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_stream_keeps_the_latest_row(spark, tmp_path):
    schema = "k int, at long, w string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for n, rows in enumerate(([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], [(1, 7, "late"), (2, 3, "d"), (3, 1, "e")])):
        put(n, rows)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = events.upsert_sink(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
    want = {(1, 9, "b"), (2, 3, "d"), (3, 1, "e")}
    assert {tuple(r) for r in events.latest(spark, str(tmp_path / "out"), ["k"], "at").collect()} == want
    events.compact(spark, str(tmp_path / "out"), str(tmp_path / "new"), ["k"], "at")
    assert {tuple(r) for r in events.latest(spark, str(tmp_path / "new"), ["k"], "at").collect()} == want


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:01:00"), ("a", "2024-01-01 00:09:00"), ("a", "2024-01-01 00:11:00"), ("a", "2024-01-03 00:00:00")], "k string, at string").selectExpr("k", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k string, at timestamp").parquet(str(tmp_path / "in"))
    n = F.count("*").alias("n")
    for i, (df, want) in enumerate(((events.windows(stream(), ["k"], "at", [n], "10 minutes"), [1, 1, 2]), (events.windows(stream(), ["k"], "at", [n], "10 minutes", "5 minutes"), [1, 1, 1, 1, 2, 2]), (events.sessions(stream(), ["k"], "at", [n], "5 minutes"), [1, 1, 2]))):
        q = df.writeStream.outputMode("complete" if i < 2 else "append").format("memory").queryName(f"w{i}").option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        q.processAllAvailable()
        q.stop()
        got = sorted(r.n for r in spark.table(f"w{i}").collect())
        assert got == want if i < 2 else set(got) <= set(want)


def test_declared_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n1,a\n2,b\n")
    source = projects.SourceTable("engine", "listed", (projects.SourceColumn("id", "INTEGER", None), projects.SourceColumn("name", "VARCHAR", None)), None, str(tmp_path / "t.csv"), "csv")
    spark.sql("DROP TABLE IF EXISTS engine.listed")
    catalog.register(spark, source)
    assert [tuple(r) for r in spark.table("engine.listed").orderBy("id").collect()] == [(1, "a"), (2, "b")]
    assert catalog.read(spark, projects.SourceTable("engine", "other", source.columns, None, str(tmp_path / "t.csv"), "csv")).dtypes == [("id", "int"), ("name", "string")]


def test_new_project_seeds_and_runs(spark, tmp_path, capsys):
    at = str(tmp_path / "fresh")
    for verb in ("init", "seed", "run", "run"):
        assert cli.main([verb, "--project-dir", at, *(["--changed-only"] if verb == "run" else [])], spark) == 0
    assert "kinds" in capsys.readouterr().out and spark.table("main.kinds").count() == 2
    assert cli.main(["init", "--project-dir", at], spark) == 0


def test_rewrites():
    assert "ORDER BY 'any'" in dialect.rewrite("select row_number() over () from t")
    assert dialect.approximate("select count(distinct a), count(distinct a, b), count(a) from t") == "select approx_count_distinct(a), count(distinct a, b), count(a) from t"
