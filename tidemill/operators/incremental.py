"""Incremental materialization on plain Parquet tables: partition overwrite, keyed upsert, and checks that a model may be built by batches."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import CompilationError


def with_lookback(new: DataFrame, column: str, days: int | None, today: str | None = None) -> DataFrame:
    """Rows of the last ``days`` days only; a filter on a partition column, so Catalyst prunes the scan."""
    if days is None:
        return new
    end = F.to_date(F.lit(today)) if today else F.current_date()
    return new.filter(F.col(column) >= F.date_sub(end, days))


_LOCK, _RUNNING = threading.Lock(), {"n": 0, "before": ""}


@contextmanager
def _dynamic(spark: SparkSession) -> Iterator[None]:
    """Overwrites by partition while any such write runs: models that run at the same time share the session's setting, so the last one to end puts it back."""
    mode = "spark.sql.sources.partitionOverwriteMode"
    with _LOCK:
        if not _RUNNING["n"]:
            _RUNNING["before"] = spark.conf.get(mode)
            spark.conf.set(mode, "dynamic")
        _RUNNING["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _RUNNING["n"] -= 1
            if not _RUNNING["n"]:
                spark.conf.set(mode, _RUNNING["before"])


def overwrite_partitions(table: str, new: DataFrame, partition_by: list[str], lookback_days: int | None = None, today: str | None = None) -> None:
    """Replaces just the partitions that ``new`` has rows for."""
    if not partition_by:
        raise CompilationError(f"{table}: an incremental model needs partition_by or unique_key")
    spark = new.sparkSession
    new = with_lookback(new, partition_by[0], lookback_days, today)
    with _dynamic(spark):
        new.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What a MERGE by key gives: rows of ``new`` replace those of ``old``; null keys match null keys. Keys of ``new`` must be unique."""
    hit = F.lit(True)
    keys = new.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    for k in key:
        hit = hit & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return old.join(keys, hit, "left_anti").unionByName(new)


def upsert(spark: SparkSession, table: str, new: DataFrame, key: list[str]) -> None:
    """Keyed upsert into a table: anti join and union, written beside the old table with its partition columns, then swapped; the old table stays until the
    new one has its name."""
    repeated = new.groupBy(*key).count().filter("count > 1").limit(1).count()
    if repeated:
        raise CompilationError(f"{table}: the increment has more than one row for a key")
    old = spark.table(table)
    tag = uuid.uuid4().hex[:8]
    staged = f"{table}__up_{tag}"
    columns = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    writer = merged(old, new.select(*old.columns), key).write.format("parquet")
    (writer.partitionBy(*columns) if columns else writer).saveAsTable(staged)
    swap(spark, staged, table, f"{table}__old_{tag}", bool(columns))


def swap(spark: SparkSession, staged: str, table: str, backup: str, partitioned: bool) -> None:
    """Gives a written table another's name. The other is kept under a third name until then, and gets its own back if the swap fails."""
    before = spark.catalog.tableExists(table)
    if before:
        spark.sql(f"ALTER TABLE {table} RENAME TO {backup}")
    try:
        spark.sql(f"ALTER TABLE {staged} RENAME TO {table}")
        if partitioned:
            relocate(spark, table)
    except Exception:
        if before and not spark.catalog.tableExists(table):
            spark.sql(f"ALTER TABLE {backup} RENAME TO {table}")
            if partitioned:
                relocate(spark, table)
        raise
    if before:
        spark.sql(f"DROP TABLE {backup}")


def relocate(spark: SparkSession, table: str) -> None:
    """Partitions follow their renamed table: some catalogs go on naming the old folder."""
    home = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r["col_name"] == "Location")
    for r in spark.sql(f"SHOW PARTITIONS {table}").collect():
        parts = (x.partition("=") for x in r["partition"].split("/"))
        spec = ", ".join("{} = '{}'".format(k, unquote(v).replace("'", "\\'")) for k, _, v in parts)
        spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION '{home}/{r['partition']}'")


@dataclass(frozen=True)
class BatchSafety:
    safe: bool
    reasons: tuple[str, ...]


def _nodes(plan) -> list:
    out = [plan]
    children = plan.children()
    for i in range(children.size()):
        out += _nodes(children.apply(i))
    return out


def batch_safety(df: DataFrame, batch_key: str) -> BatchSafety:
    """Whether rows of one batch depend on that batch only: windows and aggregates must be partitioned by the batch key, and there
    must be no limit, sort-dependent or self join. Read off the analyzed plan."""
    reasons = []
    leaves: list[str] = []
    for node in _nodes(df._jdf.queryExecution().analyzed()):
        kind, text = node.nodeName(), node.simpleString(200)
        if kind == "Window" and not _names_key(str(node.partitionSpec().mkString(",")), batch_key):
            reasons.append(f"a window isn't partitioned by {batch_key}")
        elif kind == "Aggregate" and not _names_key(str(node.groupingExpressions().mkString(",")), batch_key):
            reasons.append(f"an aggregate isn't grouped by {batch_key}")
        elif kind in ("GlobalLimit", "LocalLimit"):
            reasons.append("a limit depends on all rows")
        elif kind in ("LogicalRelation", "Relation", "LogicalRDD", "LocalRelation"):
            leaves.append(text.split("[")[0] + str(node.output().mkString(",").split("#")[0]))
        elif kind == "Join" and len(leaves) != len(set(leaves)):
            reasons.append("a self join may cross batches")
    if len(leaves) != len(set(leaves)):
        reasons.append("a source is read more than once: a self join may cross batches")
    return BatchSafety(not reasons, tuple(dict.fromkeys(reasons)))


def _names_key(expressions: str, key: str) -> bool:
    return any(part.strip().split("#")[0].split(".")[-1] == key for part in expressions.replace("(", ",").replace(")", ",").split(","))
