"""Source tables: registration by path, checks of existence and columns, schemas from declared types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemill.errors import ConfigError, MissingSources
from tidemill.plans.dialect import rewrite
from tidemill.plans.project import Project, SourceTable


def declared_schema(source: SourceTable) -> StructType:
    """The schema that the declared types spell out."""
    out = StructType()
    for c in source.columns:
        kind = rewrite(f"x::{c.type}")[3:].strip()
        try:
            out = out.add(c.name, _ddl(kind))
        except Exception as e:
            raise ConfigError(f"source {source.qualified}: column {c.name!r} has the unknown type {c.type!r}") from e
    return out


def _ddl(kind: str):
    return StructType.fromDDL(f"c {'TIMESTAMP_NTZ' if kind.upper() == 'TIMESTAMP' else kind}")["c"].dataType


def read(spark: SparkSession, source: SourceTable, root: str | None = None) -> DataFrame:
    """A source's rows: its files if it has a path, its catalog table otherwise."""
    if source.path is None:
        return spark.table(source.qualified)
    reader = spark.read.format(source.format)
    if source.format in ("csv", "json") and source.columns:
        reader = reader.schema(declared_schema(source))
    if source.format == "csv":
        reader = reader.option("header", "true")
    return reader.load(resolve(source.path, root))


def resolve(path: str, root: str | None) -> str:
    return path if root is None or "://" in path or path.startswith("/") else f"{root}/{path}"


def register(spark: SparkSession, source: SourceTable, root: str | None = None) -> None:
    """Makes a source with a path a table of the catalog, over the files where they are."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {source.schema}")
    if source.path is not None:
        named = source.format in ("csv", "json") and source.columns
        columns = f" ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in declared_schema(source))})" if named else ""
        header = " OPTIONS (header 'true')" if source.format == "csv" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {source.qualified}{columns} USING {source.format}{header} LOCATION '{resolve(source.path, root)}'")


def validate(spark: SparkSession, project: Project) -> None:
    """All sources that are used must exist and have their declared columns; everything that is amiss is said at once."""
    used = {s.qualified for m in project.models for d in project.dependencies(m) if d not in project.models and (s := project.source(d))}
    wrong = []
    for name in sorted(used):
        source = project.sources[name]
        try:
            have = {c.lower() for c in read(spark, source, str(project.root) if project.root else None).columns}
        except Exception as e:
            wrong.append(f"source {name} can't be read: {str(e).splitlines()[0]}")
            continue
        if gone := [c.name for c in source.columns if c.name.lower() not in have]:
            wrong.append(f"source {name} has no column {', '.join(gone)}")
    if wrong:
        raise MissingSources("\n".join(wrong))
