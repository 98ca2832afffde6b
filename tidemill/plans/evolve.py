"""Schema changes between two versions of a model: what changed, how to migrate, what lies downstream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.plans.project import Project

#: Types that take all values of another one.
WIDER = {"tinyint": {"smallint", "int", "bigint"}, "smallint": {"int", "bigint"}, "int": {"bigint", "double"}, "float": {"double"}, "date": {"timestamp_ntz", "timestamp"}}


@dataclass(frozen=True)
class Change:
    kind: str  # add, drop, widen, retype
    column: str
    old: str | None = None
    new: str | None = None

    @property
    def breaking(self) -> bool:
        return self.kind in ("drop", "retype")


def diff(old: StructType, new: StructType) -> list[Change]:
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (old, new))
    out = [Change("drop", c, a[c]) for c in a if c not in b] + [Change("add", c, None, b[c]) for c in b if c not in a]
    for c in a:
        if c in b and a[c] != b[c]:
            out.append(Change("widen" if b[c] in WIDER.get(a[c], ()) else "retype", c, a[c], b[c]))
    return out


def migrate(old: DataFrame, new: StructType, backfill: dict[str, str] | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """Old rows in the new schema: renamed columns move, added ones are filled by expressions (else null), the rest is cast."""
    backfill, renamed = backfill or {}, renamed or {}
    back = {v: k for k, v in renamed.items()}
    out = []
    for f in new.fields:
        source = back.get(f.name, f.name)
        value = F.col(source) if source in old.columns else F.expr(backfill[f.name]) if f.name in backfill else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return old.select(*out)


def statements(table: str, changes: list[Change]) -> list[str]:
    """DDL for what a plain table can do in place; anything else needs a rewrite by ``migrate``."""
    added = [f"{c.column} {c.new}" for c in changes if c.kind == "add"]
    return [f"ALTER TABLE {table} ADD COLUMNS ({', '.join(added)})"] if added else []


def impact(project: Project, model: str, changes: list[Change]) -> dict[str, list[str]]:
    """Models downstream whose text names a column that is dropped or changes its type."""
    names = {c.column.lower() for c in changes if c.breaking}
    out = {}
    for m in project.downstream(model):
        words = {w.lower() for w in project.models[m].sql.replace(",", " ").replace("(", " ").replace(")", " ").replace(".", " ").split()}
        if hit := sorted(names & words):
            out[m] = hit
    return out
