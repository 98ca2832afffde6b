"""row_number() over (): numbers from 1 without gaps or repeats, made by all tasks, whatever the SELECT looks like."""

import pytest
from pyspark.sql import functions as F

from tidemill.plans import project as projects
from tidemill.plans.dialect import rewrite, statements
from tidemill.runner import Runner

#: (text, rows without their number k). Where the number is computed on, k is taken back to it.
SPREAD = {
    "bare": ("select row_number() over () as k from nt", [()] * 700),
    "columns": ("select a, row_number() over () as k, b from nt", [(i, i % 7) for i in range(700)]),
    "star": ("select *, ROW_NUMBER ( ) OVER ( ) k from nt as x where x.a % 2 = 0", [(i, i % 7) for i in range(0, 700, 2)]),
    "star_of": ("select x.* except (b), row_number() over () as k from nt x", [(i,) for i in range(700)]),
    "star_of_a_struct": ("select s.*, row_number() over () as k from (select struct(a, b) as s from nt) x", [(i, i % 7) for i in range(700)]),
    "computed": ("select a, (cast(row_number() over () as bigint) - 1 + 1) as k, a + row_number() over () - row_number() over () as same from nt", [(i, i) for i in range(700)]),
    "derived": ("select k, a from (select a, row_number() over () as k from (select a from nt where b = 1) t order by a) u", [(i,) for i in range(1, 700, 7)]),
    "twice": ("select a, k from (select row_number() over () as k, a, j from (select a, row_number() over () as j from nt) t) u where j > 0", [(i,) for i in range(700)]),
    "cte": ("with x as (select a, row_number() over () as k from nt) select k, a from x", [(i,) for i in range(700)]),
    "joined": ("select x.a, y.b as c, row_number() over () as k from nt x join nt y on x.a = y.a + 1 where x.b > 0 order by x.a", [(i, (i - 1) % 7) for i in range(1, 700) if i % 7]),
    "joined_star": ("select x.*, row_number() over () as k from nt x, (select 1 as one) y where y.one = 1", [(i, i % 7) for i in range(700)]),
    "outer_joined": ("select x.a, y.a as c, row_number() over () as k from nt x left join nt as y on y.a = x.a and y.a < 5", [(i, i if i < 5 else None) for i in range(700)]),
    "joined_cases": ("select X.A, x.a as c, `y`.b, row_number() over () as k from nt x join nt Y using (a) where x.b = y.b", [(i, i, i % 7) for i in range(700)]),
    "distinct": ("select distinct k from (select row_number() over () as k from nt) t", [()] * 700),
    "grouped": ("select a as g, count(*) as n, row_number() over () as k, max(b) c from nt group by 1 having count(*) = 1 order by n, g", [(i, 1, i % 7) for i in range(700)]),
    "qualified": ("select a, row_number() over () as k from nt qualify row_number() over () <= 1000", [(i,) for i in range(700)]),
    "comments": ("select a, -- from here (\n row_number() over () as k from nt -- all\n", [(i,) for i in range(700)]),
    "windows": ("select a, row_number() over () as k, max(a) over (partition by b) >= a as low, count(*) over w - 100 as n from nt window w as (partition by b)", [(i, True, 0) for i in range(700)]),
    "unequal": ("select row_number() over () as k, a is distinct from b as other from nt where a in (select row_number() over () from nt)", [(i != i % 7,) for i in range(1, 700)]),
}
#: Left to one task.
WHOLE = {
    "limited": ("select a, row_number() over () as k from nt limit 5", 5),
    "no_relation": ("select row_number() over () as k", 1),
    "lateral": ("select x.a, k from nt x, lateral (select row_number() over () as k from (select x.a) t) y where k = 1 and x.a = 3", 1),
    "places": ("select spark_partition_id() as p, row_number() over () as k from nt", 700),
    "shadowed": ("select x.a, (select max(x.b) from nt x) as m, row_number() over () as k from nt x join nt y on x.a = y.a", 700),
    "global": ("select count(*) as n, row_number() over () as k from nt", 1),
    "two_groups": ("select row_number() over () as k from nt group by b union all select row_number() over () + count(*) - count(*) + 7 from nt group by b", 14),
}


@pytest.fixture
def nt(spark):
    """Rows in partitions of unequal size, two of them empty."""
    part = F.when(F.col("id") < 500, 0).when(F.col("id") < 501, 2).otherwise(5)
    spark.range(700).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), part.alias("p")).repartition(6, "p").drop("p").createOrReplaceTempView("nt")
    yield spark
    spark.catalog.dropTempView("nt")


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("name", sorted(SPREAD))
def test_numbers(nt, name, adaptive):
    text, want = SPREAD[name]
    nt.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = nt.sql(rewrite(text, {"qualify"}))
        assert dict(df.dtypes)["k"] == ("bigint" if name == "computed" else "int")
        got = df.collect()
    finally:
        nt.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(r["k"] for r in got) == list(range(1, len(want) + 1))
    others = [c for c in df.columns if c != "k"]
    assert sorted(tuple(repr(r[c]) for c in others) for r in got) == sorted(tuple(map(repr, w)) for w in want)


@pytest.mark.parametrize("name", sorted(SPREAD.keys() - {"unequal"}))
def test_no_task_has_all_rows(nt, name):
    text = rewrite(SPREAD[name][0], {"qualify"})
    assert "(ORDER BY 'any')" not in text
    df = nt.sql(text)
    if name == "columns":
        nt.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        finally:
            nt.conf.unset("spark.sql.adaptive.enabled")
        assert len(held) == 4 and sum(held) == 700 and max(held) < 300


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_numbers_of_other_forms(nt, name):
    text, n = WHOLE[name]
    assert sorted(r["k"] for r in nt.sql(rewrite(text)).collect()) == list(range(1, n + 1))


def test_unsteady_rows_are_numbered_once(nt):
    got = nt.sql(rewrite("select a, row_number() over () as k from (select a from nt where rand() < 0.5) t")).collect()
    assert sorted(r["k"] for r in got) == list(range(1, len(got) + 1)) and 200 < len(got) < 500


def test_numbers_in_views_and_tables(nt):
    nt.sql("create or replace temp view numbered as " + rewrite("select a, row_number() over () from nt"))
    assert nt.table("numbered").columns == ["a", "row_number() OVER ()"]
    assert nt.sql("select max(`row_number() OVER ()`) from numbered").first()[0] == 700
    nt.catalog.dropTempView("numbered")


def test_numbers_read_by_subqueries(nt):
    nt.sql(rewrite("select a, row_number() over () as k from nt")).createOrReplaceTempView("numbered")
    for text, want in (
        ("select count(*) from nt where exists (select 1 from numbered n where n.k = nt.a)", 699),
        ("select count(*) from nt where a in (select k from numbered)", 699),
        ("select max(b) from (select a - (select count(*) from numbered) as b from nt) t", -1),
        ("select sum(b) from (select (select max(k) from numbered n where n.a = nt.a) as b from nt) t", 245350),
        ("select max(a) - (select count(*) from numbered) from nt where a < (select max(k) - 1 from numbered)", -2),
        ("select count(*) from numbered x join numbered y on x.k = y.k + 1", 699),
        ("select count(distinct k) from (select k from numbered limit 10) t", 10),
    ):
        assert nt.sql(text).first()[0] == want, text
    nt.catalog.dropTempView("numbered")


def test_numbers_written_by_statements(nt):
    """Tables made and filled by SQL, from rows that are others each time they are read."""
    text = "select a, row_number() over () as k from (select a from nt where rand() < 0.5) t"
    nt.sql("drop table if exists numbers_made")
    for sql in statements(f"create table numbers_made as {text}; insert into numbers_made {text.replace('a,', 'a + 1000,', 1)}"):
        nt.sql(sql)
    for low in (0, 1000):
        got = sorted(r["k"] for r in nt.table("numbers_made").where(f"a >= {low} and a < {low} + 1000").collect())
        assert got == list(range(1, len(got) + 1)) and 200 < len(got) < 500
    nt.sql("drop table numbers_made")


def test_models_that_share_numbers(nt, tmp_path):
    """Subplans that tables of one level share are kept; those of numbers too."""
    nt.sql("create schema if not exists numbers")
    nt.sql("drop table if exists numbers.rows")
    nt.table("nt").write.mode("overwrite").option("path", str(tmp_path / "rows")).saveAsTable("numbers.rows")
    inner = "(select a, row_number() over () as k from mill.ref('rows') where a >= 0) t"
    for kind in ("table", "view", "inline"):
        texts = {
            "n": f"-- @materialize: {kind.replace('inline', 'view')}\nselect a, row_number() over () as k from mill.ref('rows')",
            "low": "-- @materialize: table\nselect max(k) as top, count(distinct k) as n, min(a) as a from " + (inner if kind == "inline" else "mill.ref('n')"),
            "high": "-- @materialize: table\nselect sum(k) as total, count(distinct k) as n, max(a) as a from " + (inner if kind == "inline" else "mill.ref('n')"),
        }
        project = projects.from_sql(texts, sources={"numbers.rows": projects.SourceTable("numbers", "rows")})
        runner = Runner(nt, project, "numbered_" + kind)
        runner.run()
        assert tuple(nt.table(f"numbered_{kind}.low").first()) == (700, 700, 0)
        assert tuple(nt.table(f"numbered_{kind}.high").first()) == (245350, 700, 699)
        runner.close()


def test_empty_and_one(nt):
    assert nt.sql(rewrite("select a, row_number() over () as k from nt where a < 0")).collect() == []
    assert [tuple(r) for r in nt.sql(rewrite("select a, row_number() over () as k from nt where a = 699")).collect()] == [(699, 1)]
