"""The query language: text and JSON forms, validation, and planning of backends."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields


class QueryError(Exception):
    kind = "error"

    def __init__(self, message: str, suggestion: str = "", **details):
        super().__init__(message)
        self.suggestion, self.details = suggestion, details


class ParseError(QueryError):
    kind = "parse_error"


class UnknownField(QueryError):
    kind = "unknown_field"


class RegexError(QueryError):
    kind = "regex_error"


class NotIndexable(QueryError):
    kind = "not_indexable"


_LISTS = {"repo": "repos", "-repo": "exclude_repos", "lang": "langs", "-lang": "exclude_langs", "path": "paths", "-path": "exclude_paths", "symbol": "symbols"}
_CHOICES = {
    "case": ("case", {"yes": "sensitive", "sensitive": "sensitive", "true": "sensitive", "no": "insensitive", "insensitive": "insensitive", "false": "insensitive"}, "use case:yes or case:no"),
    "scope": ("content_scope", {"def": "definition", "definition": "definition", "test": "test", "comment": "comment", "string": "string_literal", "any": "any"}, "use scope:def|test|comment|string|any"),
    "in": ("repo_scope", {"hotset": "hot_set", "local": "hot_set", "remote": "remote", "both": "both"}, "use in:hotset|remote|both"),
    "type": ("kind", {"regex": "regex", "literal": "literal"}, "use type:literal or type:regex"),
}
#: Constructs outside the linear-time dialect, and possessive quantifiers.
_NOT_RE2 = re.compile(r"\\[1-9]|\\k<|\(\?(?:=|!|<=|<!|>)|(?<!\\)[*+?}]\+")


@dataclass
class Query:
    pattern: str = ""
    kind: str = "literal"
    case: str = "insensitive"
    repos: list[str] = field(default_factory=list)
    exclude_repos: list[str] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)
    exclude_langs: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    exclude_paths: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    content_scope: str = "any"
    repo_scope: str = "both"

    @classmethod
    def from_text(cls, text: str) -> Query:
        """Words without a colon are the pattern; every word with one is a filter."""
        q, words = cls(), []
        for position, token in enumerate(text.split()):
            key, colon, value = token.partition(":")
            if not colon:
                words.append(token)
            elif key in _LISTS:
                getattr(q, _LISTS[key]).extend(v for v in value.split(",") if v)
            elif key in _CHOICES:
                name, known, hint = _CHOICES[key]
                if value not in known:
                    raise ParseError(f"invalid {key} value `{value}`", hint, input=text, position=position)
                setattr(q, name, known[value])
            else:
                raise UnknownField(f"unknown field `{key}`", "known: " + ", ".join([*_LISTS, *_CHOICES]), field=key)
        q.pattern = " ".join(words)
        return q

    def to_text(self) -> str:
        out = [self.pattern] + ["type:regex"] * (self.kind == "regex") + ["case:yes"] * (self.case == "sensitive")
        out += [f"{key}:{v}" for key, name in _LISTS.items() for v in getattr(self, name)]
        short = {"definition": "def", "string_literal": "string"}
        if self.content_scope != "any":
            out.append(f"scope:{short.get(self.content_scope, self.content_scope)}")
        if self.repo_scope != "both":
            out.append("in:" + {"hot_set": "hotset"}.get(self.repo_scope, self.repo_scope))
        return " ".join(out)

    @classmethod
    def from_json(cls, text: str) -> Query:
        try:
            value = json.loads(text)
        except ValueError as e:
            raise ParseError(f"invalid JSON: {e}", "pass a JSON object with a `pattern` string field", input=text[:200]) from e
        if not isinstance(value, dict) or not isinstance(value.get("pattern"), str):
            raise ParseError("`pattern` is missing or no string", "pass a JSON object with a `pattern` string field", input=text[:200])
        kinds = {f.name: f for f in fields(cls)}
        for name, v in value.items():
            if name not in kinds:
                raise UnknownField(f"unknown field `{name}`", "known: " + ", ".join(kinds), field=name)
            if isinstance(getattr(cls(), name), list) != isinstance(v, list):
                raise ParseError(f"`{name}` has the wrong type", "check field types", input=text[:200])
        return cls(**value)

    def validate(self) -> Query:
        if not self.pattern:
            raise ParseError("pattern must not be empty", "provide a literal or regex pattern", input="", position=0)
        if self.kind == "regex":
            if m := _NOT_RE2.search(re.sub(r"\\\\", "", self.pattern)):
                raise RegexError(f"`{m[0]}` is not supported: no backreferences or look-around", pattern=self.pattern)
            try:
                re.compile(self.pattern)
            except re.error as e:
                raise RegexError(str(e), pattern=self.pattern) from e
            if max(map(len, literal_runs(self.pattern)), default=0) < 3:
                raise NotIndexable(f"regex `{self.pattern}` has no literal substring of 3 characters or more")
        elif len(self.pattern.encode()) < 3:
            raise NotIndexable(f"`{self.pattern}` has fewer than 3 bytes")
        return self


def literal_runs(pattern: str) -> list[str]:
    """Literal stretches of a regex outside classes; groups, alternatives and quantified characters end a stretch."""
    runs, now, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        step, literal = 1, None
        if c == "\\" and i + 1 < len(pattern):
            step = 2
            literal = pattern[i + 1] if not pattern[i + 1].isalnum() else None
        elif c == "[":
            close = pattern.find("]", i + 2)
            step = (close if close > 0 else len(pattern)) - i + 1
        elif c not in ".^$|()?*+{":
            literal = c
        elif c == "{":
            step = max(1, pattern.find("}", i) - i + 1)
        following = pattern[i + step : i + step + 1]
        if literal is not None and following not in ("?", "*", "{"):
            now += literal
            if following == "+":
                runs.append(now)
                now = ""
        else:
            runs.append(now)
            now = ""
        i += step
    return [r for r in [*runs, now] if r]


def required_literals(q: Query) -> list[str]:
    """Strings that every match of the pattern contains. Alternatives, optional parts and classes require nothing."""
    if q.kind == "literal":
        return [q.pattern] if q.pattern else []
    runs: list[str] = [""]

    def walk(tokens) -> None:
        for op, arg in tokens:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(arg)
            elif name == "SUBPATTERN" and not arg[1] and not arg[2]:  # a group without flags of its own
                walk(arg[3])
            elif name == "MAX_REPEAT" and arg[0] > 0:
                walk(arg[2])
                runs.append("")
            else:
                runs.append("")

    parsed = re._parser.parse(q.pattern)
    if parsed.state.flags & ~re.UNICODE:  # flags inside the pattern change what literals mean
        return []
    walk(parsed)
    return [r for r in runs if r]


def plan(q: Query) -> list[tuple[str, list[str]]]:
    """The backends that a query goes to, in order, each with warnings."""
    q.validate()
    local = [("local_index", ["symbol filters are not applied"] * bool(q.symbols))]
    remote = []
    for backend in ("grep_app", "github", "sourcegraph"):
        notes = []
        if q.kind == "regex" and backend == "github":
            notes.append("regex is sent as a literal")
        if q.content_scope != "any" and backend != "sourcegraph":
            notes.append("content scope is not supported")
        remote.append((backend, notes))
    return {"hot_set": local, "remote": remote}.get(q.repo_scope, local + remote)
