"""Runs projects: catalog mode writes tables and views, session mode chains temporary views lazily."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemill.errors import ExecutionError
from tidemill.functions.metrics import Metrics
from tidemill.functions.udfs import Functions
from tidemill.operators.incremental import overwrite_partitions, relocate, swap, upsert
from tidemill.plans import rules
from tidemill.plans.compiler import CompiledModel, compile_model, compile_sql, qualified
from tidemill.plans.dialect import approximate, column_type, rewrite, statements
from tidemill.plans.project import Project
from tidemill.sources import catalog

PREVIEW_ROWS = 10
FINGERPRINT = "tidemill.fingerprint"
#: Functions that may give other rows for the same inputs.
UNSTEADY = re.compile(r"\b(current_date|current_timestamp|now|rand|randn|random|uuid)\b", re.IGNORECASE)


@dataclass(frozen=True)
class Result:
    model: str
    kind: str
    seconds: float
    rows: int | None
    preview: DataFrame | None = None


@dataclass
class Backend:
    """Statements on a Spark catalog."""

    spark: SparkSession
    schema: str = "main"

    def execute(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def ensure_schema(self) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.schema}")

    def name(self, table: str) -> str:
        return f"{self.schema}.{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def kind(self, table: str) -> str | None:
        """table, view, or None."""
        return ("view" if self.spark.catalog.getTable(self.name(table)).tableType == "VIEW" else "table") if self.exists(table) else None

    def drop(self, table: str) -> None:
        """Drops a table or view, whichever it is."""
        if kind := self.kind(table):
            self.spark.sql(f"DROP {kind.upper()} IF EXISTS {self.name(table)}")

    def create_view(self, table: str, sql: str) -> None:
        if self.kind(table) == "table":
            self.drop(table)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(table)} AS {sql}")

    def create_table(self, table: str, sql: str, partition_by: Iterable[str] = ()) -> int:
        """Writes beside the old table and then swaps, so a failed query leaves the old one. Rows are counted as they are written."""
        staged, seen = f"__stg_{table}_{uuid.uuid4().hex[:8]}", Observation()
        rows = self.spark.sql(sql).observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = rows.write.format("parquet")
        if columns := list(partition_by):
            writer = writer.partitionBy(*columns)
        try:
            writer.saveAsTable(self.name(staged))
        except Exception:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(staged)}")
            raise
        if self.kind(table) == "view":
            self.drop(table)
        swap(self.spark, self.name(staged), self.name(table), self.name(staged.replace("__stg_", "__old_", 1)), False)
        if columns:
            relocate(self.spark, self.name(table))
        return seen.get["rows"]

    def create_table_if_missing(self, table: str, sql: str, partition_by: Iterable[str] = ()) -> int | None:
        """The rows written, or None if there is such a table already."""
        return None if self.exists(table) else self.create_table(table, sql, partition_by)

    def declare(self, table: str, columns: dict[str, str], partition_by: Iterable[str] = (), if_missing: bool = False) -> None:
        """An empty table of declared types; these may be foreign ones, such as VARCHAR without a length."""
        if if_missing and self.exists(table):
            return
        spec = ", ".join(f"`{c}` {column_type(t)}" for c, t in columns.items())
        parts = ", ".join(partition_by)
        self.spark.sql(f"CREATE TABLE {self.name(table)} ({spec}) USING parquet" + (f" PARTITIONED BY ({parts})" if parts else ""))

    def insert(self, table: str, sql: str) -> None:
        """Appends the rows of a query, or of VALUES, column by column in order."""
        self.spark.sql(f"INSERT INTO {self.name(table)} {rewrite(sql)}")

    def script(self, text: str) -> None:
        """Statements of a setup script, foreign DDL among them."""
        for sql in statements(text):
            self.spark.sql(sql)

    def count(self, table: str) -> int:
        return self.spark.table(self.name(table)).count()

    def preview(self, table: str, limit: int = PREVIEW_ROWS) -> DataFrame:
        return self.spark.table(self.name(table)).limit(limit)

    def truncate(self, table: str) -> None:
        self.spark.sql(f"TRUNCATE TABLE {self.name(table)}")


@dataclass
class Runner:
    spark: SparkSession
    project: Project
    schema: str = "main"
    metrics: Metrics = field(default_factory=Metrics)
    parallel: int = 1
    #: Transparent rules apply: subplans that models of one level share are computed once.
    optimize: bool = True
    #: Models whose text and inputs are as they were when they were last built are left alone.
    changed_only: bool = False
    functions: Functions = field(default_factory=Functions)

    def __post_init__(self) -> None:
        self.backend = Backend(self.spark, self.schema)
        self.prints: dict[str, str | None] = {}
        self.kept: list[DataFrame] = []

    def approved(self, model: str) -> set[str]:
        """Semantic rules that the model's project entry or annotation consents to."""
        config, said = self.project.configs.get(model), self.project.models[model].notes.get("approve") or ""
        return set(config.approve if config else ()) | {x.strip() for x in said.split(",") if x.strip()}

    def compiled(self, model: str) -> CompiledModel:
        made = compile_model(self.project, model, qualified(self.project, self.schema), self.metrics)
        return replace(made, sql=approximate(made.sql)) if "approximate_distinct" in self.approved(model) else made

    def fingerprint(self, model: str) -> str | None:
        """Digest of a model's text, kind and inputs; None if these can't tell whether rows would be the same."""
        if model not in self.prints:
            made = self.compiled(model)
            parts: list[str | None] = [made.sql, made.materialization, self.project.models[model].notes.get("partition_by")]
            changing = made.materialization in ("incremental", "temp") or UNSTEADY.search(made.sql)
            parts += [self.fingerprint(d) if d in self.project.models else self._version(d) for d in self.project.dependencies(model)]
            known = not changing and all(p is not None for p in parts[3:])
            self.prints[model] = hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest() if known else None
        return self.prints[model]

    def _version(self, source: str) -> str | None:
        """What a source's files say of themselves: how many, how large, how new. None for anything but files."""
        try:
            rows = catalog.read(self.spark, self.project.source(source), str(self.project.root) if self.project.root else None)
            files = rows.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("double").alias("at")).distinct()
            return str(tuple(files.agg(F.count("*"), F.sum("file_size"), F.max("at")).first()))
        except AnalysisException:
            return None

    def unchanged(self, model: str) -> bool:
        mine = self.fingerprint(model)
        if mine is None or not self.backend.exists(model):
            return False
        said = {r[0]: r[1] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.backend.name(model)}").collect()}
        return said.get(FINGERPRINT) == mine

    def _shared(self, models: list[str]) -> list[DataFrame]:
        """Keeps the costly subplans that several tables of one level have in common, till the level is done."""
        made = [self.compiled(m) for m in models]
        frames = {c.name: self.spark.sql(c.sql) for c in made if c.materialization in ("table", "temp")}
        return rules.share(self.spark, frames) if len(frames) > 1 and hasattr(self.spark, "_jsparkSession") else []

    def close(self) -> None:
        """Releases the rows of temporary models."""
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def prepare(self) -> None:
        self.backend.ensure_schema()
        root = str(self.project.root) if self.project.root else None
        for s in self.project.sources.values():
            catalog.register(self.spark, s, root)
        catalog.validate(self.spark, self.project)

    def execute(self, compiled: CompiledModel, show: bool = False, count_views: bool = False) -> Result:
        """Materializes one model."""
        began = time.perf_counter()
        name, rows = compiled.name, None
        notes, config = self.project.models[name].notes, self.project.configs.get(name)
        partition_by = [x.strip() for x in (notes.get("partition_by") or "").split(",") if x.strip()] or list(config.partition_by if config else ())
        if compiled.materialization == "view":
            self.backend.create_view(name, compiled.sql)
            rows = self.backend.count(name) if count_views else None
        elif compiled.materialization == "temp":
            self.kept.append(self.spark.sql(compiled.sql).persist())
            self.kept[-1].createOrReplaceTempView(name)
        elif compiled.materialization == "incremental" and self.backend.kind(name) == "table":
            new = self.spark.sql(compiled.sql)
            key = [x.strip() for x in (notes.get("unique_key") or "").split(",") if x.strip()] or list(config.unique_key if config else ())
            days = notes.get("lookback_days") or (config.lookback_days if config else None)
            if key:
                upsert(self.spark, self.backend.name(name), new, key)
            else:
                overwrite_partitions(self.backend.name(name), new, partition_by, int(days) if days else None)
        else:
            rows = self.backend.create_table(name, compiled.sql, partition_by)
        if self.changed_only and (mine := self.fingerprint(name)) and (kind := self.backend.kind(name)):
            self.spark.sql(f"ALTER {kind.upper()} {self.backend.name(name)} SET TBLPROPERTIES ('{FINGERPRINT}' = '{mine}')")
        return Result(name, compiled.materialization, time.perf_counter() - began, rows, self.backend.preview(name) if show and compiled.materialization != "temp" else None)

    def run(self, select: Iterable[str] | None = None, show: bool = False, count_views: bool = False) -> list[Result]:
        """All models in order, or those selected; stops at the first that fails. Models of one level may run at once."""
        wanted = set(select) if select is not None else set(self.project.models)
        levels = self.project.levels()
        self.prepare()
        self.functions.register(self.spark)
        self.prints = {}
        out: list[Result] = []

        def one(model: str) -> Result:
            try:
                return self.execute(self.compiled(model), show, count_views)
            except Exception as e:
                raise ExecutionError(model, e) from e

        with ThreadPoolExecutor(max(1, self.parallel)) as pool:
            for level in levels:
                todo = [m for m in level if m in wanted and not (self.changed_only and self.unchanged(m))]
                kept = []
                try:
                    kept = self._shared(todo) if self.optimize and len(todo) > 1 else []
                    out += pool.map(one, todo)
                finally:
                    for df in kept:
                        df.unpersist()
        return out


class Session:
    """Session mode: models as lazy DataFrames; nothing is written, Catalyst sees the whole chain as one plan."""

    def __init__(self, spark: SparkSession, project: Project, tables: dict[str, DataFrame] | None = None, metrics: Metrics | None = None, functions: Functions | None = None) -> None:
        self.spark, self.project, self.metrics = spark, project, metrics or Metrics()
        self.tables, self.tag = dict(tables or {}), f"_tm{uuid.uuid4().hex[:10]}"
        self.frames: dict[str, DataFrame] = {}
        if functions:
            functions.register(spark)

    def view(self, name: str) -> str:
        view = f"{self.tag}_{name.replace('.', '__')}"
        if name in self.project.models:
            self.frame(name)
        elif not self.spark.catalog.tableExists(view):
            source = self.project.source(name)
            (self.tables[name] if name in self.tables else catalog.read(self.spark, source, str(self.project.root) if self.project.root else None)).createOrReplaceTempView(view)
        return view

    def frame(self, model: str) -> DataFrame:
        if model not in self.frames:
            sql = compile_sql(self.project, model, self.view, self.metrics)
            self.frames[model] = self.spark.sql(sql)
            self.frames[model].createOrReplaceTempView(f"{self.tag}_{model.replace('.', '__')}")
        return self.frames[model]

    def substitute(self, model: str, frame: DataFrame) -> None:
        """Puts another DataFrame in a model's place for all models built after it."""
        self.frames[model] = frame
        frame.createOrReplaceTempView(f"{self.tag}_{model}")
