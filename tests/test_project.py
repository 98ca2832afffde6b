"""Projects, references, compilation, materialization, rules and diagnostics on small fixtures."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemill import diagnostics
from tidemill.cli import main
from tidemill.errors import CircularDependency, CompilationError, ConfigError, DiscoveryError, MissingSources, SyntaxProblem, UndefinedReference, UnsupportedFeature
from tidemill.functions.metrics import Metric, trailing
from tidemill.operators.incremental import batch_safety, merged
from tidemill.operators.sessions import session_rows, session_summary, sessionize
from tidemill.plans import evolve, lineage, rules
from tidemill.plans.compiler import compile_sql, qualified
from tidemill.plans.dialect import rewrite
from tidemill.plans.project import SourceTable, from_sql, load
from tidemill.plans.tokens import references, tokenize
from tidemill.runner import Backend, Runner, Session


@given(st.text(alphabet="ab'\"`-/*()[], \n=>1.é", max_size=40))
def test_tokens_keep_the_text(sql):
    assert "".join(t.text for t in tokenize(sql)) == sql


def test_references_anywhere():
    sql = """with é as (select * from Mill.ref("a")) -- mill.ref('no')
    select 'mill.ref(''no'')', case when x in (select y from mill.ref( 'b' , filter => f(x, ')') = 1)) then 1 end
    from é join mill.ref('c') on true"""
    found = references(sql)
    assert [r.name for r in found] == ["a", "b", "c"]
    assert found[1].params == {"filter": "f(x, ')') = 1"}
    with pytest.raises(SyntaxProblem):
        references("select * from mill.ref(a)")
    with pytest.raises(SyntaxProblem):
        references("select * from mill.ref('a'")


def test_graph():
    p = from_sql({"d": "select * from mill.ref('b') join mill.ref('c')", "b": "select * from mill.ref('a')", "c": "select * from mill.ref('a')", "a": "select 1 as x"})
    assert p.levels() == [["a"], ["b", "c"], ["d"]] and p.downstream("b") == ["d"]
    with pytest.raises(CircularDependency):
        from_sql({"a": "select * from mill.ref('b')", "b": "select * from mill.ref('a')"}).order()
    with pytest.raises(UndefinedReference, match="nonexistent"):
        from_sql({"a": "select * from mill.ref('nonexistent')"}).order()


def test_compile():
    p = from_sql({"a": "select 1 as x", "m": "select * from mill.ref('a', filter => x > 0, limit => 5) where x = 1", "s": "select * from mill.ref('events')", "v": "select * from mill.ref('a', as_of => 1)", "u": "select * from mill.ref('a', nope => 1)"}, sources={"raw.events": SourceTable("raw", "events")})
    names = qualified(p, "main")
    assert compile_sql(p, "m", names) == "select * from (SELECT * FROM main.a WHERE (x > 0) LIMIT 5) AS a where x = 1"
    assert compile_sql(p, "s", names) == "select * from raw.events"
    with pytest.raises(UnsupportedFeature):
        compile_sql(p, "v", names)
    with pytest.raises(CompilationError):
        compile_sql(p, "u", names)
    assert p.materialization("a") == "view"


def test_rewrites():
    assert rewrite("select x::varchar, y::varchar(3)") == "select x::STRING, y::varchar(3)"
    assert rewrite("select first(a order by b), first(a order by b desc)") == "select min_by(a, b), max_by(a, b)"
    assert rewrite("select [1, [2]], x[1]") == "select array(1, array(2)), x[1]"
    with pytest.raises(UnsupportedFeature):
        rewrite("select 1 qualify true")


def project(tmp_path, models, extra=""):
    (tmp_path / "models" / "deep").mkdir(parents=True)
    (tmp_path / "project.yml").write_text(f"name: t\nversion: 1\ntargets:\n  dev: {{type: spark, schema: {tmp_path.name.replace('-', '_')}}}\n{extra}")
    for n, s in models.items():
        (tmp_path / "models" / "deep" / f"{n}.sql").write_text(s)
    return tmp_path


def test_run(spark, tmp_path, capsys):
    schema = tmp_path.name
    spark.createDataFrame([(1, "Alice"), (2, "Bob"), (5, "Eve")], "user_id int, user_name string").write.parquet(str(tmp_path / "users"))
    spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "event_id int, user_id int").write.parquet(str(tmp_path / "ev"))
    root = project(tmp_path, {"users": "-- @materialize: table\nselect * from mill.ref('raw.users')", "activity": "select u.user_name, count(e.event_id) as n from mill.ref('users') u, mill.ref('ev') e where u.user_id = e.user_id group by u.user_name"}, "models:\n  activity: {materialization: Table}\n")
    (root / "sources.yml").write_text(f"version: 1\nsources:\n  raw:\n    tables:\n      users: {{path: {root}/users, columns: [{{name: user_id, type: INTEGER}}]}}\n      ev: {{path: {root}/ev}}\n")
    spark.sql("drop table if exists raw.users")
    spark.sql("drop table if exists raw.ev")
    assert main(["run", "--project-dir", str(root), "--show-results"], spark) == 0
    assert "activity: table" in capsys.readouterr().out
    assert sorted(map(tuple, spark.table(f"{schema}.activity").collect())) == [("Alice", 2), ("Bob", 1)]
    b = Backend(spark, schema)
    b.create_view("activity", "select 1 as x")
    assert b.kind("activity") == "view"
    assert b.create_table("activity", "select 1 as x union select 2") == 2 and b.kind("activity") == "table"
    with pytest.raises(Exception):
        b.create_table("activity", "select 1/0 as x from range(2) where id > raise_error('no')")
    assert b.count("activity") == 2
    assert main(["run", "--project-dir", str(root), "--dry-run"], spark) == 0
    assert main(["validate", "--project-dir", str(root)]) == 0
    assert main(["explain", "--project-dir", str(root)], spark) == 0
    bad = load(root)
    bad.sources["raw.users"] = SourceTable("raw", "users", bad.sources["raw.users"].columns, path=str(root / "gone"))
    with pytest.raises(MissingSources):
        from tidemill.sources.catalog import validate

        validate(spark, bad)


def test_incremental_table(spark):
    p = from_sql({"m": "-- @materialize: incremental\n-- @partition_by: d\nselect * from inc_source"})
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string").createOrReplaceTempView("inc_source")
    r = Runner(spark, p, "inc")
    r.run()
    spark.createDataFrame([(9, "b"), (3, "c")], "v int, d string").createOrReplaceTempView("inc_source")
    r.run()
    assert sorted(map(tuple, spark.table("inc.m").select("v", "d").collect())) == [(1, "a"), (3, "c"), (9, "b")]
    old, new = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string"), spark.createDataFrame([(None, "z"), (2, "w")], "k int, v string")
    assert sorted(map(str, merged(old, new, ["k"]).collect())) == sorted(map(str, [*new.collect(), old.collect()[0]]))
    assert not batch_safety(spark.sql("select sum(id) from range(3)"), "id").safe
    assert batch_safety(spark.sql("select id, count(*) from range(3) group by id"), "id").safe


def test_config_errors(tmp_path):
    with pytest.raises(ConfigError):
        load(tmp_path)
    root = project(tmp_path, {"a": "select 1"}, "default_materialization: heap\n")
    with pytest.raises(ConfigError, match="heap"):
        load(root)
    (root / "project.yml").write_text("name: x\n")
    (root / "models" / "a.sql").write_text("select 2")
    with pytest.raises(DiscoveryError, match="two models"):
        load(root)


def test_sessions(spark):
    rows = [(1, "2024-01-01 10:00:00", "US", 1.0), (1, "2024-01-01 10:30:00", "CA", 2.0), (1, "2024-01-01 11:00:00.000001", "CA", 4.0), (1, "2024-01-01 11:00:00.000001", "CA", 4.0), (2, None, "UK", 8.0)]
    e = spark.createDataFrame(rows, "u int, t string, c string, v double").withColumn("t", __import__("pyspark").sql.functions.col("t").cast("timestamp_ntz"))
    ids = [(r["u"], r["session_id"]) for r in sessionize(e, ["u"], "t").orderBy("u", "t").collect()]
    assert ids == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1)]
    assert session_rows(e, ["u"], "t", []).count() == 2
    got = session_summary(e, "u", "t", "c", "v").filter("u = 1").orderBy("session_id").collect()
    assert [(r["first_dimension"], r["n_rows"], float(r["total"])) for r in got] == [("US", 2, 3.0), ("CA", 2, 8.0)]


def test_rules(spark):
    e = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "p string, q string, v int")
    e.createOrReplaceTempView("re")
    both = rules.combine_dimensions(e, [rules.DimensionModel("p", "p"), rules.DimensionModel("q", "q")], {"s": "sum(v)"})
    assert sorted(map(str, both["p"].collect())) == sorted(map(str, e.groupBy("p").agg({"v": "sum"}).withColumnRenamed("sum(v)", "s").collect()))
    p = from_sql({"base": "select p, sum(v) as s from re group by p", "a": "select p from mill.ref('base')", "b": "select count(distinct s) as n from mill.ref('base')"})
    s = Session(spark, p)
    frames = {m: s.frame(m) for m in ("a", "b")}
    assert ("a", "b") in [m for _, m in rules.shared_subplans(frames)]
    kept = rules.share(spark, frames)
    assert frames["b"].collect()[0]["n"] == 2
    for k in kept:
        k.unpersist()
    found = {x.rule: x for x in rules.propose(frames)}
    assert found["shared_subplan"].allowed(set()) and not found["approximate_distinct"].allowed(set())
    assert rules.requirement(spark.sql("select row_number() over (partition by p order by v) from re")) == "requires_ordering"
    c = {x.name: x for x in lineage.columns(spark.sql("select t.p, t.v + 1 as w, 1 as one from re t"))}
    assert c["p"].origin == ("t.p",) and not c["p"].computed and c["w"].origin == ("t.v",) and c["w"].computed and c["one"].origin == ()


def test_diagnostics_and_evolution(spark):
    p = from_sql({"a": "select 1 as x", "b": "select id from mill.ref('missing')", "c": "select x from mill.ref('a') where x = null"})
    found = diagnostics.validate(p)
    assert [(d.line, d.column, d.end_column) for d in found if d.severity == "error"] == [(0, 24, 33)]
    assert any("NULL" in d.message for d in found)
    old = spark.sql("select 1 as a, 'x' as b")
    changes = evolve.diff(old.schema, spark.sql("select 1L as a, 2.0D as c").schema)
    assert {(c.kind, c.column) for c in changes} == {("widen", "a"), ("drop", "b"), ("add", "c")}
    assert evolve.migrate(old, spark.sql("select 1L as a, 2.0D as c").schema, {"c": "a * 2"}).collect()[0].asDict() == {"a": 1, "c": 2.0}
    assert evolve.impact(from_sql({"a": "select 1 as b", "z": "select b from mill.ref('a')"}), "a", changes) == {"z": ["b"]}
    days = spark.sql("select * from values (1, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2024-01-03 00:00:00') as t(u, ts)")
    assert [r["n"] for r in trailing(days, Metric("n", "count_distinct", "u", time="ts"), 3).orderBy("day").collect()] == [1, 2]


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemill.streaming import events as streams

    spark.sql("select 1 as u, timestamp'2024-01-01 00:00:00' as ts union all select 1, timestamp'2024-01-01 00:10:00' union all select 1, timestamp'2024-01-01 09:00:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u int, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.sessions(stream, ["u"], "ts", [F.count("*").alias("n")]).writeStream.format("memory").queryName("streamed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("streamed").collect()) == [1, 2]
