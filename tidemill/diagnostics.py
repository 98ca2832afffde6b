"""Diagnostics of a project: broken references, unknown columns, and lints of risky SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tidemill.errors import CircularDependency, TidemillError, position
from tidemill.plans.project import Project
from tidemill.plans.tokens import references, significant, tokenize


@dataclass(frozen=True)
class Diagnostic:
    severity: str  # error or warning
    message: str
    model: str
    line: int
    column: int
    end_line: int
    end_column: int


def _at(severity: str, message: str, model: str, sql: str, start: int, end: int) -> Diagnostic:
    return Diagnostic(severity, message, model, *position(sql, start), *position(sql, end))


def validate(project: Project, frame_of=None) -> list[Diagnostic]:
    """All diagnostics. With ``frame_of`` (name to DataFrame) Spark analyzes each model too."""
    out: list[Diagnostic] = []
    broken = set()
    for name, r in project.undefined():
        broken.add(name)
        out.append(_at("error", f"'{r.name}' is neither a model nor a source", name, project.models[name].sql, r.name_start, r.name_end))
    if not out:
        try:
            project.levels()
        except CircularDependency as e:
            out.append(_at("error", str(e), min(project.models), "", 0, 0))
            return out
    for name, model in sorted(project.models.items()):
        if not significant(tokenize(model.sql)):
            out.append(_at("warning", "The file holds no query", name, model.sql, 0, 0))
            continue
        out += lint(name, model.sql)
        if frame_of is not None and not broken & {name, *project.dependencies(name)}:
            try:
                frame_of(name)
            except TidemillError as e:
                out.append(_at("error", str(e), name, model.sql, 0, 0))
            except Exception as e:
                out.append(_at("error", str(e).splitlines()[0], name, model.sql, *_span(e, model.sql)))
    return out


def _span(error: Exception, sql: str) -> tuple[int, int]:
    """The fragment that Spark names, if it stands in the model's own text."""
    try:
        fragment = error.getQueryContext()[0].fragment()
    except Exception:
        return 0, 0
    at = sql.find(fragment)
    return (at, at + len(fragment)) if fragment and at >= 0 else (0, 0)


def lint(name: str, sql: str) -> list[Diagnostic]:
    """Constructs that often go wrong. All are warnings."""
    t = significant(tokenize(sql))
    out = []
    depth, from_at, where = 0, None, any(x.says("where") for x in t)
    for i, x in enumerate(t):
        depth += (x.text == "(") - (x.text == ")")
        nxt = t[i + 1] if i + 1 < len(t) else None
        if x.text == "*" and i and t[i - 1].says("select"):
            out.append(_at("warning", "SELECT * changes with its source; name the columns", name, sql, x.start, x.end))
        if x.text in ("=", "<>", "!=") and nxt and nxt.says("null"):
            out.append(_at("warning", "A comparison with NULL is never true; use IS NULL", name, sql, x.start, nxt.end))
        if x.says("union") and nxt and not nxt.says("by"):
            out.append(_at("warning", "UNION goes by position, not by name", name, sql, x.start, x.end))
        if x.says("order") and depth > 0 and nxt and nxt.says("by") and not any(y.says("over") or y.text == "over" for y in t[max(0, i - 12) : i]):
            if not any(y.says("limit") for y in t[i : i + 40]) and any(y.says("select") for y in t[max(0, i - 60) : i]) and t[i - 1].text != "(":
                out.append(_at("warning", "ORDER BY in a subquery has no effect", name, sql, x.start, nxt.end))
        if x.says("from"):
            from_at = depth
        if x.text == "," and from_at == depth and not where and any(y.says("from") for y in t[max(0, i - 12) : i]) and not any(y.says(w) for w in ("group", "order", "select") for y in t[max(0, i - 12) : i] if y.start > _last(t, i, "from")):
            out.append(_at("warning", "Tables joined by a comma without WHERE: write CROSS JOIN", name, sql, x.start, x.end))
    return out


def _last(t: list, i: int, word: str) -> int:
    return max((y.start for y in t[:i] if y.says(word)), default=-1)


def complete(project: Project, model: str, at: int, frame_of=None) -> list[str]:
    """What may stand at a place in a model's text: names within ref('..'), columns elsewhere."""
    before = project.models[model].sql[:at]
    if re.search(rf"{re.escape(project.namespace)}\s*\.\s*ref\s*\(\s*['\"][^'\"]*$", before, re.IGNORECASE):
        return sorted({*project.models, *project.sources} - {model})
    if frame_of is None:
        return []
    return sorted({c for d in project.dependencies(model) for c in frame_of(d).columns})


def definition(project: Project, model: str, at: int):
    """The file or source that the reference at a place leads to."""
    for r in references(project.models[model].sql, project.namespace):
        if r.start <= at <= r.end:
            return project.models[r.name].path or r.name if r.name in project.models else project.source(r.name)
    return None
