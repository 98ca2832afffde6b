"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Targets: the budget is shared by weight; a target stops at ``max_repeats`` times its source's size and what is
over is shared again by weight among the others (water-filling, in closed form over sources sorted by size to
weight). The documents of a source stand in an order shuffled by a keyed digest; a second pass over the source follows the first. They are
served in turns of at most ``QUANTUM`` words, and every turn gets a virtual finish time, the words of its source served up to its end
by the (whole) target. Turns that begin before virtual time 1 are range-sorted by it over all sources, and the queue is truncated at the budget by prefix sums:
over the totals of the ranges first, then over the rows of the one range that the budget ends in; the turn in service there gives what is left.

The prefix sums of a source run over buckets of the digest, as many as its rows ask for (``BUCKET_ROWS``), so that no task sorts more than
a bucket or a range; the rows of a hot source meet its target by a broadcast of the few hot sources.

Defined results: null text counts no words and takes none; null sources are one source, weighted last; repeated
rows are queued one by one; an empty table gives an empty result; equal ids are ordered by digest of the text. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, join_hot, stage

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
SEED = "mix-0-"
#: Words of one turn; rows of a bucket of a source, and of a range of the queue.
QUANTUM, BUCKET_ROWS, RANGE_ROWS = 256, 2_000, 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = BUDGET_SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size, ...): source_no, source, source_size, target, .... One row for each source."""
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    first = Window.orderBy("ratio", "source_no")
    before, after = first.rowsBetween(Window.unboundedPreceding, -1), first.rowsBetween(0, Window.unboundedFollowing)
    return (
        numbered.withColumn("w", weight)
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("w").over(after))
        .withColumn("full", F.col("level") >= F.col("ratio"))
        # The level is settled at the first source that isn't full; all later ones share it.
        .withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source_no", "source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"), *[c for c in sizes.columns if c not in ("source", "source_size")])
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = BUDGET_SHARE,
    repeats: int = MAX_REPEATS, carry_text: bool = False, bucket_rows: int = BUCKET_ROWS, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row for each document: id, size, source_size, target, taken, finish (virtual finish time of its last turn; null if
    nothing is taken); with ``carry_text`` also the text and all other columns of ``docs``, in a struct ``row``."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), digest.alias("order"),
        F.xxhash64(F.col(text_col)).alias("tie"), *([F.struct(*docs.columns).alias("row")] if carry_text else []),
    )
    rows = stage(rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn("rid", F.monotonically_increasing_id()), "mix")
    sizes = rows.groupBy("source", "key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = stage(targets(sizes, weights, share, repeats), "mix-targets").withColumn("buckets", F.ceil(F.col("n") / bucket_rows))
    total = plan.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget = int(share * total[1])

    slim = join_hot(rows.select("rid", "key", "id", "size", "order", "tie"), plan.drop("source"), "key", "n", total[0])
    slim = slim.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 12), 16, 10).cast("long") * F.col("buckets") / F.lit(1 << 48)))
    slim = stage(slim, "mix-line")
    totals = slim.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    begins = totals.withColumn("begin", F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("words")).drop("words")
    line = Window.partitionBy("source_no", "bucket").orderBy("order", "id", "size", "tie", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumn("upto", F.sum("size").over(line)).join(begins, ["source_no", "bucket"])
    first = F.col("begin") + F.col("upto") - F.col("size")  # words of the source before the document, in the first pass
    whole = F.floor("target").cast("long")
    queue = placed.filter("size > 0").select("rid", "source_no", "size", whole.alias("whole"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: first + k * F.col("source_size"))).alias("at"))
    queue = queue.filter("at < whole").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(QUANTUM).cast("long"))).alias("turn")).filter("at + turn < whole")
    words = F.least(F.lit(QUANTUM), F.col("size") - F.col("turn"))
    queue = queue.select("rid", "source_no", words.alias("words"), (F.col("at") + F.col("turn") + words).alias("served"), "whole").withColumn("finish", F.col("served") / F.col("whole"))

    ranges = max(1, (budget // QUANTUM + repeats * total[0]) // range_rows)
    by = ("finish", "source_no", "served")
    queue = stage(queue.repartitionByRange(ranges, *by).withColumn("range", F.spark_partition_id()), "mix-queue")
    sums = queue.groupBy("range").agg(F.sum("words").alias("words"))  # one row a range
    ends = stage(sums.withColumn("end", F.sum("words").over(Window.orderBy("range"))).withColumn("begin", F.col("end") - F.col("words")).drop("words"), "mix-ranges")
    served = queue.join(F.broadcast(ends.filter(F.col("end") <= budget).select("range")), "range").select("rid", "words", "finish")
    cut = queue.join(F.broadcast(ends.filter((F.col("begin") < budget) & (F.col("end") > budget)).select("range", "begin")), "range")  # one range
    running = F.col("begin") + F.sum("words").over(Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.select("rid", F.least(F.col("words"), F.lit(budget) - (running - F.col("words"))).alias("words"), "finish").filter("words > 0")
    taken = served.unionByName(cut).groupBy("rid").agg(F.sum("words").alias("taken"), F.max("finish").alias("finish"))
    out = slim.select("rid", "id", "size", "source_size", "target").join(taken, "rid", "left")
    if carry_text:
        out = out.join(rows.select("rid", "row"), "rid")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "finish", *(["row"] if carry_text else []))


#: DuckDB SQL for the mix of all documents, with the same digest order.
MIX_SQL = r"""
with recursive d as (
  select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size,
         md5(concat('mix-0-', coalesce(doc_id::varchar, 'null'))) as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as no from d group by source),
w as (
  select *, case (no - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, (2 * source_size)::double as cap from s),
fill(step, no, target, done) as (
  select 0, no, 0.0::double, false from w
  union all
  select f.step + 1, f.no,
         case when f.done then f.target
              else least(w.cap, w.w * (((select sum(source_size) * 1.5::double from w) - x.used) / x.open)) end,
         f.done or w.cap <= w.w * (((select sum(source_size) * 1.5::double from w) - x.used) / x.open)
  from (select *, coalesce(sum(case when done then target end) over (), 0) as used0,
               sum(case when done then 0 else (case (no - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end) end) over () as open0 from fill) f
  join w using (no), lateral (select f.used0 as used, case when f.open0 = 0 then 1 else f.open0 end as open) x
  where f.step < 60),
t as (select no, target from fill where step = 60),
q as (
  select d.doc_id, d.size, w.no, w.source_size, t.target, floor(t.target)::bigint as whole,
         sum(d.size) over (partition by w.no order by d.k, d.doc_id, d.size rows unbounded preceding) - d.size as first
  from d join w on d.source is not distinct from w.source join t using (no)),
turns as (
  select doc_id, no, whole, least(256, size - turn) as words, first + pass * source_size + turn + least(256, size - turn) as served
  from (select *, unnest(range(0, size, 256)) as turn from q, (values (0), (1)) p(pass) where size > 0) x
  where first + pass * source_size + turn < whole),
queue as (
  select doc_id, words, sum(words) over (order by served::double / whole::double, no, served rows unbounded preceding) as running from turns),
got as (
  select doc_id, sum(greatest(0, least(words, (select floor(1.5 * sum(source_size)) from w)::bigint - (running - words))))::bigint as taken from queue group by doc_id)
select q.doc_id, q.size, q.source_size, q.target, coalesce(got.taken, 0)::bigint as taken
from q left join got using (doc_id)
"""
