"""Projects: ``project.yml`` and ``sources.yml``, models found in folders, and their dependency graph."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from tidemill.errors import CircularDependency, ConfigError, DiscoveryError, ProjectNotFound, UndefinedReference
from tidemill.plans.tokens import NAMESPACE, Annotations, Call, annotations, references

PROJECT_FILE, SOURCES_FILE, LEVELS_UP = "project.yml", "sources.yml", 5
KINDS = ("table", "view", "temp", "incremental")
TARGETS = ("spark", "connect")


@dataclass(frozen=True)
class Target:
    name: str
    type: str = "spark"
    schema: str = "main"
    master: str | None = None
    connect_url: str | None = None
    catalog: str | None = None


@dataclass(frozen=True)
class ModelConfig:
    materialization: str | None = None
    partition_by: tuple[str, ...] = ()
    lookback_days: int | None = None
    unique_key: tuple[str, ...] = ()
    approve: frozenset[str] = frozenset()


@dataclass(frozen=True)
class SourceColumn:
    name: str
    type: str
    description: str | None = None


@dataclass(frozen=True)
class SourceTable:
    schema: str
    name: str
    columns: tuple[SourceColumn, ...] = ()
    description: str | None = None
    path: str | None = None
    format: str = "parquet"

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}"


@dataclass(frozen=True)
class Model:
    name: str
    sql: str
    path: Path | None = None
    refs: tuple[Call, ...] = ()
    notes: Annotations = field(default_factory=Annotations)


@dataclass
class Project:
    name: str
    models: dict[str, Model]
    sources: dict[str, SourceTable] = field(default_factory=dict)
    targets: dict[str, Target] = field(default_factory=lambda: {"dev": Target("dev")})
    default_materialization: str = "view"
    configs: dict[str, ModelConfig] = field(default_factory=dict)
    namespace: str = NAMESPACE
    root: Path | None = None

    def materialization(self, model: str) -> str:
        """The annotation of the model, its entry in the project file, or the project's default."""
        said = self.models[model].notes.get("materialize") if model in self.models else None
        configured = self.configs[model].materialization if model in self.configs else None
        return kind_of(said) if said else configured or self.default_materialization

    def source(self, name: str) -> SourceTable | None:
        """A source by its qualified name, or by a bare name that only one source has."""
        if name in self.sources:
            return self.sources[name]
        fits = [s for s in self.sources.values() if s.name == name]
        if len(fits) > 1:
            raise ConfigError(f"{name!r} may be any of {', '.join(sorted(s.qualified for s in fits))}; write which")
        return fits[0] if fits else None

    def dependencies(self, model: str) -> list[str]:
        return list(dict.fromkeys(r.name for r in self.models[model].refs))

    def model_dependencies(self, model: str) -> list[str]:
        return [d for d in self.dependencies(model) if d in self.models]

    def undefined(self) -> list[tuple[str, Call]]:
        return [(m.name, r) for m in self.models.values() for r in m.refs if r.name not in self.models and self.source(r.name) is None]

    def levels(self) -> list[list[str]]:
        """Models by level: each depends on earlier levels only. Within a level they are sorted by name."""
        if missing := self.undefined():
            raise UndefinedReference("\n".join(f"model {m!r} refers to {r.name!r}, which is neither a model nor a source" for m, r in missing))
        waits = {m: set(self.model_dependencies(m)) for m in self.models}
        out: list[list[str]] = []
        while waits:
            ready = sorted(m for m, w in waits.items() if not w)
            if not ready:
                raise CircularDependency(f"models depend on one another: {', '.join(cycle(waits))}")
            out.append(ready)
            waits = {m: w - set(ready) for m, w in waits.items() if m not in ready}
        return out

    def order(self) -> list[str]:
        return [m for level in self.levels() for m in level]

    def downstream(self, model: str) -> list[str]:
        """All models that depend on one, directly or not, in order."""
        touched = {model}
        for m in self.order():
            if touched & set(self.model_dependencies(m)):
                touched.add(m)
        return [m for m in self.order() if m in touched and m != model]


def cycle(waits: dict[str, set[str]]) -> list[str]:
    """One cycle among the models that wait for one another."""
    at, seen = min(waits), []
    while at not in seen:
        seen.append(at)
        at = min(w for w in waits[at] if w in waits)
    return seen[seen.index(at) :] + [at]


def kind_of(text: str) -> str:
    if text.lower() not in KINDS:
        raise ConfigError(f"{text!r} is no materialization; there are {', '.join(KINDS)}")
    return text.lower()


def model(name: str, sql: str, path: Path | None = None, namespace: str = NAMESPACE) -> Model:
    return Model(name, sql, path, tuple(references(sql, namespace, str(path or name))), annotations(sql))


def from_sql(models: dict[str, str], **rest) -> Project:
    """A project of texts, without files."""
    namespace = rest.get("namespace", NAMESPACE)
    return Project(rest.pop("name", "inline"), {n: model(n, s, namespace=namespace) for n, s in models.items()}, **rest)


def discover(folders: Iterable[Path], namespace: str = NAMESPACE) -> dict[str, Model]:
    """All .sql files below the folders; a missing folder is passed over, two files of one name are an error."""
    found: dict[str, Model] = {}
    for folder in folders:
        for path in sorted(Path(folder).rglob("*.sql", recurse_symlinks=True)):
            if path.stem in found:
                raise DiscoveryError(f"two models are called {path.stem!r}: {found[path.stem].path} and {path}")
            found[path.stem] = model(path.stem, path.read_text(encoding="utf-8"), path, namespace)
    if not found:
        raise DiscoveryError(f"no models in {', '.join(map(str, folders)) or 'no folder'}")
    return found


def find_root(start: str | Path) -> Path:
    at = Path(start).resolve()
    for folder in [at, *at.parents][: LEVELS_UP + 1]:
        if (folder / PROJECT_FILE).is_file():
            return folder
    raise ProjectNotFound(f"no {PROJECT_FILE} in {at} or {LEVELS_UP} folders above")


def _yaml(path: Path) -> dict:
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: keys and values are expected")
    return data


def read_sources(path: Path) -> dict[str, SourceTable]:
    found = {}
    for schema, entry in (_yaml(path).get("sources") or {}).items():
        for table, spec in (entry.get("tables") or {}).items():
            spec = spec or {}
            columns = tuple(SourceColumn(c["name"], c["type"], c.get("description")) for c in spec.get("columns") or [])
            found[f"{schema}.{table}"] = SourceTable(schema, table, columns, spec.get("description"), spec.get("path"), spec.get("format", "parquet"))
    return found


def _names(value) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(value)


def load(folder: str | Path = ".") -> Project:
    """The project in a folder or above it."""
    root = find_root(folder)
    data = _yaml(root / PROJECT_FILE)
    try:
        targets = {}
        for n, t in (data.get("targets") or {"dev": {}}).items():
            t = t or {}
            kind = t.get("type", "spark")
            if kind not in TARGETS:
                raise ConfigError(f"target {n!r}: {kind!r} is no target type; there are {', '.join(TARGETS)}")
            targets[n] = Target(n, kind, t.get("schema", "main"), t.get("master"), t.get("connect_url"), t.get("catalog"))
        configs = {}
        for n, c in (data.get("models") or {}).items():
            c = c or {}
            kind = kind_of(c["materialization"]) if c.get("materialization") else None
            configs[n] = ModelConfig(kind, _names(c.get("partition_by")), c.get("lookback_days"), _names(c.get("unique_key")), frozenset(_names(c.get("approve"))))
        namespace = data.get("namespace", NAMESPACE)
        sources = read_sources(root / SOURCES_FILE) if (root / SOURCES_FILE).is_file() else {}
        models = discover([root / p for p in data.get("model_paths") or ["models"]], namespace)
        return Project(data["name"], models, sources, targets, kind_of(data.get("default_materialization") or "view"), configs, namespace, root)
    except (KeyError, TypeError, AttributeError) as e:
        raise ConfigError(f"{root / PROJECT_FILE}: {type(e).__name__} {e}") from e
