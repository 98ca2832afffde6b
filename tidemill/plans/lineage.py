"""Typed schemas and column lineage, read off Catalyst's analyzed plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemill.plans.project import Project


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    origin: tuple[str, ...]  # the columns it is made of, as relation.column; empty for constants
    computed: bool  # anything but a plain column

    @property
    def kind(self) -> str:
        return "computed" if self.computed else "column"


def _walk(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i))


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def columns(df: DataFrame) -> list[Column]:
    """Output columns with types and the relation columns they come from."""
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, object] = {}  # expression id: the expression that makes it
    base: dict[int, str] = {}
    for node in _walk(plan):
        kind = node.nodeName()
        lists = {"Project": ["projectList"], "Aggregate": ["aggregateExpressions"], "Window": ["windowExpressions"]}.get(kind, [])
        for name in lists:
            for e in _each(getattr(node, name)()):
                if e.getClass().getSimpleName() == "Alias":
                    made[e.exprId().id()] = e.child()
        if kind == "SubqueryAlias":
            for a in _each(node.output()):
                base.setdefault(a.exprId().id(), "")
                if not base[a.exprId().id()]:
                    base[a.exprId().id()] = f"{node.identifier().name()}.{a.name()}"
        elif node.children().size() == 0:
            for a in _each(node.output()):
                base.setdefault(a.exprId().id(), a.name())

    def origins(expr_id: int, name: str, seen: frozenset) -> set[str]:
        if expr_id in made and expr_id not in seen:
            out: set[str] = set()
            for r in _each(made[expr_id].references().toSeq()):
                out |= origins(r.exprId().id(), r.name(), seen | {expr_id})
            return out
        return {base.get(expr_id) or name}

    out = []
    for a, f in zip(_each(plan.output()), df.schema.fields, strict=True):
        i = a.exprId().id()
        plain = i not in made or made[i].getClass().getSimpleName() == "AttributeReference"
        out.append(Column(a.name(), f.dataType.simpleString(), tuple(sorted(origins(i, a.name(), frozenset()))), not plain))
    return out


def available_columns(project: Project, model: str, frame_of) -> dict[str, str]:
    """Columns of a model and of all it refers to, with types. ``frame_of`` gives the DataFrame of a name."""
    out = {f.name: f.dataType.simpleString() for f in frame_of(model).schema.fields}
    for d in project.model_dependencies(model):
        out |= {f.name: f.dataType.simpleString() for f in frame_of(d).schema.fields if f.name not in out}
    return out


def describe(project: Project, model: str, frame_of) -> str:
    """A model's schema as Markdown."""
    lines = [f"**{model}** ({project.materialization(model)})", "", "| column | type | from |", "|-|-|-|"]
    lines += [f"| {c.name} | {c.type} | {', '.join(c.origin) or 'constant'} |" for c in columns(frame_of(model))]
    return "\n".join(lines)
