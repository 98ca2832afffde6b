"""A small tokenizer for SQL text: enough to find references, their parameters and annotations anywhere.

It knows strings, quoted identifiers, comments and brackets; everything else is left to Spark's parser. References are written
``mill.ref('name', param => expression, ...)``; the namespace can be chosen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidemill.errors import SyntaxProblem

NAMESPACE = "mill"
_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
      | (?P<quoted>`(?:[^`]|``)*`)
      | (?P<number>\d+(?:\.\d+)?)
      | (?P<word>[^\W\d]\w*)
      | (?P<mark>=>|<=|>=|<>|!=|\|\||::|.)""",
    re.VERBOSE | re.DOTALL,
)
_OPEN, _CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    def says(self, word: str) -> bool:
        return self.kind == "word" and self.text.lower() == word.lower()


@dataclass(frozen=True)
class Call:
    """A namespaced call: ``ns.function('name', param => expression)``, with its span in the text."""

    function: str
    name: str
    params: dict[str, str]
    start: int
    end: int
    name_start: int
    name_end: int


@dataclass
class Annotations:
    """``-- @key: value`` lines before the statement."""

    values: dict[str, str] = field(default_factory=dict)

    def get(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key, default)


def tokenize(sql: str) -> list[Token]:
    """All tokens, space and comments included: their texts joined are the input."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


def significant(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind not in ("space", "comment")]


def unquote(literal: str) -> str:
    q, body = literal[0], literal[1:-1]
    return re.sub(r"\\(.)", r"\1", body.replace(q * 2, q))


def closing(tokens: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at ``at``; -1 if there is none."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "mark":
            depth += (tokens[i].text in _OPEN) - (tokens[i].text in _CLOSE)
            if depth == 0:
                return i
    return -1


def split_arguments(tokens: list[Token]) -> list[list[Token]]:
    """Tokens between brackets, split at the commas of the outermost level."""
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "mark":
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
            if t.text == "," and depth == 0:
                parts.append([])
                continue
        parts[-1].append(t)
    return [p for p in parts if p] if len(parts) == 1 else parts


def calls(sql: str, namespace: str = NAMESPACE, file: str = "") -> list[Call]:
    """All calls of the namespace, in order; those within comments and strings are none."""
    tokens = significant(tokenize(sql))
    found, i = [], 0
    while i + 3 < len(tokens):
        ns, dot, name, bracket = tokens[i : i + 4]
        if not (ns.says(namespace) and dot.text == "." and name.kind == "word" and bracket.text == "(") or (i and tokens[i - 1].text == "."):
            i += 1
            continue
        end = closing(tokens, i + 3)
        if end < 0:
            raise SyntaxProblem("the bracket isn't closed", sql, bracket.start, file)
        arguments = split_arguments(tokens[i + 4 : end])
        if not arguments or len(arguments[0]) != 1 or arguments[0][0].kind != "string":
            raise SyntaxProblem(f"{namespace}.{name.text} takes a quoted name first", sql, ns.start, file)
        params = {}
        for a in arguments[1:]:
            if len(a) < 3 or a[0].kind != "word" or a[1].text != "=>":
                raise SyntaxProblem("a parameter is written name => expression", sql, (a[0] if a else tokens[end]).start, file)
            if (key := a[0].text.lower()) in params:
                raise SyntaxProblem(f"the parameter {key} is given twice", sql, a[0].start, file)
            params[key] = sql[a[2].start : a[-1].end]
        first = arguments[0][0]
        found.append(Call(name.text.lower(), unquote(first.text), params, ns.start, tokens[end].end, first.start, first.end))
        i = end + 1
    return found


def references(sql: str, namespace: str = NAMESPACE, file: str = "") -> list[Call]:
    return [c for c in calls(sql, namespace, file) if c.function == "ref"]


def replace_spans(sql: str, spans: list[tuple[int, int, str]]) -> str:
    for start, end, text in sorted(spans, reverse=True):
        sql = sql[:start] + text + sql[end:]
    return sql


def annotations(sql: str) -> Annotations:
    """Annotations in the comments before the first other token."""
    found = Annotations()
    for t in tokenize(sql):
        if t.kind == "comment" and (m := re.match(r"--\s*@(\w+)\s*:\s*(.*)", t.text)):
            found.values[m[1].lower()] = m[2].strip()
        elif t.kind not in ("space", "comment"):
            break
    return found
