"""Errors of the engine. Messages name the model, the file and the line where there is one."""

from __future__ import annotations


class TidemillError(Exception):
    """Base of all errors raised by the engine."""


class ConfigError(TidemillError):
    """A project or source file that can't be read, or says something that isn't allowed."""


class ProjectNotFound(ConfigError):
    """No project file in the folder or its parents."""


class DiscoveryError(TidemillError):
    """No models, or two models of one name."""


class SyntaxProblem(TidemillError):
    """A reference that isn't written as one."""

    def __init__(self, message: str, sql: str = "", at: int = 0, file: str = "") -> None:
        line, column = position(sql, at)
        shown = sql.split("\n")[line] if sql else ""
        super().__init__(f"{file or 'model'}:{line + 1}:{column + 1}: {message}" + (f"\n  {shown}\n  {' ' * column}^" if shown else ""))
        self.line, self.column = line, column


class UndefinedReference(TidemillError):
    """Models that refer to what is neither a model nor a source; all of them at once."""


class CircularDependency(TidemillError):
    """Models that depend on one another."""


class CompilationError(TidemillError):
    """A model that can't be turned into Spark SQL."""


class UnsupportedFeature(CompilationError):
    """A construct that has no counterpart on the target, such as time travel on plain Parquet."""


class MissingSources(TidemillError):
    """Declared source tables that don't exist or lack declared columns."""


class ExecutionError(TidemillError):
    """A model that failed while it ran; what ran before stays."""

    def __init__(self, model: str, cause: Exception) -> None:
        super().__init__(f"model {model!r} failed: {str(cause).splitlines()[0] if str(cause) else type(cause).__name__}")
        self.model = model


def position(text: str, at: int) -> tuple[int, int]:
    """(line, column) of a character, both from 0."""
    before = text[:at]
    return before.count("\n"), at - (before.rfind("\n") + 1)
