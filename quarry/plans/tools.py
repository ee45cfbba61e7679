"""Tools: strict parameters, one envelope per call, sanitised and cut to a byte budget."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.plans.language import QueryError

BYTE_CAP = 25_000
#: Fixed values: (default, largest) limits.
LIMITS = {"repos": (10, 30), "code": (15, 40), "tree": (200, 500), "snippets": (2, 5)}
_ESCAPES = re.compile("\x1b\\[[0-?]*[ -/]*[@-~]?|\x1b[\\]P][^\x07\x1b]*(?:\x07|\x1b\\\\?)?")
_CONTROLS = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f]")
_BIDI = re.compile("[‪-‮⁦-⁩]")


class ToolError(Exception):
    """A call that cannot be served: a kind, a message, and how to correct it."""

    def __init__(self, kind: str, message: str, correction: str = ""):
        super().__init__(message)
        self.kind, self.correction = kind, correction


def clean(value):
    """Terminal escapes and controls removed, direction marks spelt out, long lines cut; through lists and objects."""
    if isinstance(value, str):
        text = _BIDI.sub(lambda m: f"<U+{ord(m[0]):04X}>", _CONTROLS.sub("", _ESCAPES.sub("", value)))
        return "\n".join(x if len(x) <= 500 else f"{x[:500]}…[+{len(x) - 500} chars truncated]" for x in text.split("\n"))
    if isinstance(value, list):
        return [clean(v) for v in value]
    return {k: clean(v) for k, v in value.items()} if isinstance(value, dict) else value


def envelope(rows: list[dict], total: int, has_more: bool, warnings: list[str], cap: int = BYTE_CAP) -> dict:
    """The largest prefix of rows whose envelope fits ``cap`` bytes; then warnings, then the note are given up."""

    def make(n: int, note: str | None, warn: list[str]) -> dict:
        cut = n < len(rows)
        out = {"results": rows[:n], "total": total, "has_more": has_more or cut, "truncated": cut, "warnings": warn}
        return out | ({"note": note} if note else {})

    size = lambda e: len(json.dumps(e, ensure_ascii=False, default=str).encode())
    full = make(len(rows), None, warnings)
    if size(full) <= cap:
        return full
    note = "results were cut to fit the byte budget; ask for the next page or fewer fields"
    lo, hi = 0, len(rows)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if size(make(mid, note, warnings)) <= cap else (lo, mid - 1)
    for n, own_note, warn in ((lo, note, warnings), (lo, note, []), (lo, None, [])):
        if size(out := make(n, own_note, warn)) <= cap:
            return out
    return make(0, None, [])


def cursor(value: str | None) -> int:
    """``off:N``; nothing is the start."""
    if value is None:
        return 0
    if not re.fullmatch(r"off:\d+", value):
        raise ToolError("bad_cursor", f"cursor `{value}` is malformed", "pass the cursor of the last page, like off:15")
    return int(value[4:])


def limit(kind: str, value: int | None) -> int:
    default, most = LIMITS[kind]
    if value is None:
        return default
    if not 1 <= value <= most:
        raise ToolError("bad_limit", f"limit {value} is out of range", f"pass 1 to {most}")
    return value


#: Parameters of each tool: name, JSON type, and whether it must be given.
PARAMETERS = {
    "search_code": [("probes", "array", True), ("limit", "integer", False), ("cursor", "string", False)],
    "list_repos": [("names", "string", False), ("limit", "integer", False), ("cursor", "string", False)],
    "repo_profile": [("repo", "string", True)],
    "repo_tree": [("repo", "string", True), ("prefix", "string", False), ("glob", "string", False), ("limit", "integer", False)],
    "fetch_file": [("repo", "string", True), ("path", "string", True), ("start", "integer", False), ("end", "integer", False)],
    "fetch_docs": [("repo", "string", True), ("probe", "string", True)],
    "guide": [],
}


def schemas() -> dict[str, dict]:
    """The JSON schema of each tool's arguments; unknown ones are refused."""
    return {
        name: {"type": "object", "additionalProperties": False, "properties": {p: {"type": kind} for p, kind, _ in params}, "required": [p for p, _, must in params if must]}
        for name, params in PARAMETERS.items()
    }


class Tools:
    """The engine behind tool calls, over a frame of documents (repo, path, content)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs

    def call(self, name: str, arguments: dict) -> dict:
        """Runs a tool; errors become an envelope with a kind, the input, and a correction."""
        try:
            if name not in PARAMETERS:
                raise ToolError("unknown_tool", f"unknown tool `{name}`", "known: " + ", ".join(PARAMETERS))
            run, fields = getattr(self, name), {p for p, _, _ in PARAMETERS[name]}
            if extra := sorted(set(arguments) - fields):
                raise ToolError("unknown_parameter", f"unknown parameter `{extra[0]}`", "known: " + ", ".join(sorted(fields)))
            return clean(run(**arguments))
        except (ToolError, QueryError, TypeError, ValueError) as e:
            return {"error": {"kind": getattr(e, "kind", "bad_parameter"), "message": str(e), "input": arguments, "correction": getattr(e, "correction", getattr(e, "suggestion", ""))}}

    def _page(self, rows: DataFrame, order: list, at: int, n: int) -> dict:
        rows = rows.persist()  # the page and the count read it
        try:
            got = [r.asDict(recursive=True) for r in rows.orderBy(*order).offset(at).limit(n + 1).collect()]
            out = envelope(got[:n], rows.count(), len(got) > n, [])
        finally:
            rows.unpersist()
        if out["has_more"]:
            out["cursor"] = f"off:{at + len(out['results'])}"
        return out

    def search_code(self, probes: list[str], limit: int | None = None, cursor: str | None = None) -> dict:
        n, at = globals()["limit"]("code", limit), globals()["cursor"](cursor)
        return self._page(search.roll_up(search.multi_probe(self.docs, probes, cap=None)), [F.desc("breadth"), F.desc("files"), "repo"], at, n)

    def list_repos(self, names: str = "", limit: int | None = None, cursor: str | None = None) -> dict:
        n, at = globals()["limit"]("repos", limit), globals()["cursor"](cursor)
        rows = search.repo_listing(self.docs)
        wanted = [p.strip().lower() for p in names.split(";") if p.strip()]
        if wanted:
            rows = rows.where(" OR ".join(f"contains(lower(repo), '{p.replace(chr(39), chr(39) * 2)}')" for p in wanted))
        return self._page(rows, [F.desc("files"), "repo"], at, n)

    def _repo(self, repo: str) -> str:
        """The exact name, else one that differs in case only."""
        found = search.find_repo(self.docs, repo).first()
        if found is None:
            raise ToolError("unknown_repo", f"no repo `{repo}`", "list_repos shows the names")
        return found.repo

    def repo_profile(self, repo: str) -> dict:
        name = self._repo(repo)
        return self._page(search.profiles(self.docs.where(F.col("repo") == name)), ["repo"], 0, 1)

    def repo_tree(self, repo: str, prefix: str = "", glob: str = "", limit: int | None = None) -> dict:
        n = globals()["limit"]("tree", limit)
        return self._page(search.tree(self.docs, self._repo(repo), prefix=prefix, glob=glob, limit=None), ["path"], 0, n)

    def fetch_file(self, repo: str, path: str, start: int = 1, end: int | None = None) -> dict:
        return self._page(search.fetch_file(self.docs, self._repo(repo), path, start, end), ["path"], 0, 1)

    def fetch_docs(self, repo: str, probe: str) -> dict:
        name = self._repo(repo)
        return self._page(search.grep_docs(self.docs.where(F.col("repo") == name), probe), ["path"], 0, 20)

    def guide(self) -> dict:
        return {"results": [{"query": "words are the pattern; key:value filters are repo, lang, path, case, scope, in, type; a leading - excludes", "probes": "1 to 5; /x/ is a regex, others are literals in any case"}], "total": 1, "has_more": False, "truncated": False, "warnings": []}
