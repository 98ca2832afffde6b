"""Models to Spark SQL: references become relations, their parameters become clauses that Catalyst pushes down."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from tidemill.errors import CompilationError, UnsupportedFeature
from tidemill.functions.metrics import Metrics
from tidemill.plans.dialect import rewrite
from tidemill.plans.project import Project
from tidemill.plans.tokens import Call, calls, replace_spans, significant, split_arguments, tokenize

#: Parameters of a reference that become clauses, hints that don't change rows, and those that need a table format with history.
CLAUSES = ("filter", "partitions", "sample", "limit")
HINTS = ("prefer_materialized", "inline", "allow_approximate")
HISTORY = ("as_of", "version", "max_staleness")


@dataclass(frozen=True)
class CompiledModel:
    name: str
    sql: str
    materialization: str


def relation(ref: Call, table: str) -> str:
    """The relation that stands for a reference."""
    unknown = set(ref.params) - set(CLAUSES) - set(HINTS) - set(HISTORY)
    if unknown:
        raise CompilationError(f"ref('{ref.name}'): unknown parameter {', '.join(sorted(unknown))}")
    for p in HISTORY:
        if p in ref.params:
            raise UnsupportedFeature(f"ref('{ref.name}', {p} => ...): plain tables keep no history; this needs a table format that does")
    where = [f"({ref.params['filter']})"] if "filter" in ref.params else []
    if "partitions" in ref.params:
        where.append(_partitions(ref))
    if not where and not {"sample", "limit"} & set(ref.params):
        return table
    source = table
    if "sample" in ref.params:
        try:
            share = float(ref.params["sample"])
        except ValueError:
            share = -1.0
        if not 0 <= share <= 1:
            raise CompilationError(f"ref('{ref.name}'): sample is a share from 0 to 1, not {ref.params['sample']}")
        source += f" TABLESAMPLE ({share * 100:g} PERCENT) REPEATABLE (1)"
    sql = f"SELECT * FROM {source}"
    if where:
        sql += f" WHERE {' AND '.join(where)}"
    if "limit" in ref.params:
        if not ref.params["limit"].isdigit():
            raise CompilationError(f"ref('{ref.name}'): limit is a whole number, not {ref.params['limit']}")
        sql += f" LIMIT {ref.params['limit']}"
    return f"({sql})"


def _partitions(ref: Call) -> str:
    """partitions => column IN [..] or column = value: a predicate on a partition column."""
    tokens = significant(tokenize(ref.params["partitions"]))
    if len(tokens) >= 3 and tokens[1].says("in") and tokens[2].text in ("[", "("):
        values = [" ".join(t.text for t in part) for part in split_arguments(tokens[3:-1])]
        return f"{tokens[0].text} IN ({', '.join(values)})" if values else "false"
    if len(tokens) >= 3 and tokens[1].text == "=":
        return f"({ref.params['partitions']})"
    raise CompilationError(f"ref('{ref.name}'): partitions => column IN [..] is expected")


def compile_sql(project: Project, name: str, table_of: Callable[[str], str], metrics: Metrics | None = None) -> str:
    """Spark SQL of one model. ``table_of`` names the relation of a model or source."""
    model = project.models[name]
    spans = []
    for call in calls(model.sql, project.namespace, str(model.path or name)):
        if call.function == "ref":
            # ``inline`` puts the model's text in the place of its table; the other hints ask for what a run does anyway.
            inline = call.params.get("inline", "").lower() == "true" and call.name in project.models
            at = relation(call, f"({compile_sql(project, call.name, table_of, metrics)})" if inline else table_of(call.name))
            spans.append((call.start, call.end, at if not at.startswith("(") or _aliased(model.sql, call.end) else f"{at} AS {call.name.rpartition('.')[2]}"))
        elif call.function == "metric" and metrics is not None:
            spans.append((call.start, call.end, metrics.expression(call.name, call.params)))
        else:
            raise CompilationError(f"model {name!r}: {project.namespace}.{call.function} is unknown")
    allow = frozenset(x.strip().lower() for x in (model.notes.get("allow_rewrite") or "").split(",") if x.strip())
    return rewrite(replace_spans(model.sql, spans), allow)


def _aliased(sql: str, at: int) -> bool:
    """Whether an alias follows."""
    rest = significant(tokenize(sql[at:]))
    stops = ("where", "group", "order", "having", "limit", "join", "inner", "left", "right", "full", "cross", "on", "union", "intersect", "except", "qualify", "lateral", "pivot", "unpivot", "natural", "semi", "anti", "tablesample", "window", "using")
    return bool(rest) and rest[0].kind in ("word", "quoted") and rest[0].text.lower() not in stops


def compile_model(project: Project, name: str, table_of: Callable[[str], str], metrics: Metrics | None = None) -> CompiledModel:
    return CompiledModel(name, compile_sql(project, name, table_of, metrics), project.materialization(name))


def qualified(project: Project, schema: str) -> Callable[[str], str]:
    """Names in a catalog: models in the target's schema, sources under their own names."""

    def table_of(name: str) -> str:
        if name in project.models:
            return f"{schema}.{name}"
        source = project.source(name)
        if source is None:
            raise CompilationError(f"{name!r} is neither a model nor a source")
        return source.qualified

    return table_of
