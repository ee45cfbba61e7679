"""Scalar functions on columns; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by extension; others are ``text``.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "java": "java", "rb": "ruby", "md": "markdown", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "shell",
}
MAX_FILE_BYTES, NUL_WINDOW, MAX_ENTROPY, MAX_LINE = 1_048_576, 8192, 7.5, 500


def detect_lang(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.substring_index(path, ".", -1)), F.lit("text"))


def has_nul(content: Column) -> Column:
    return F.locate("\x00", F.substring(content, 1, NUL_WINDOW)) > 0


def admitted(content: Column) -> Column:
    """Index gate: at most 1 MiB, no NUL in the first 8192 bytes."""
    return (F.octet_length(content) <= MAX_FILE_BYTES) & ~has_nul(content)


def rejection(content: Column, entropy: Column) -> Column:
    """Corpus gate: the first reason that applies, or null."""
    return F.when(F.octet_length(content) > MAX_FILE_BYTES, "too_large").when(has_nul(content), "binary_nul").when(entropy > MAX_ENTROPY, "high_entropy")


def lines_of(content: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    kept = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.transform(F.array(F.split(content, "\r?\n", -1)), kept)[0]  # split once


def license_class(name: Column) -> Column:
    up = F.upper(name)
    permissive = [up.contains(x) for x in ("MIT", "APACHE", "BSD", "ISC", "ZPL", "0BSD")]
    any_of = permissive[0]
    for p in permissive[1:]:
        any_of = any_of | p
    return F.when(up.startswith("AGPL"), "AGPL").when(up.contains("GPL"), "copyleft").when(any_of, "permissive").otherwise("unknown")


def star_tier(stars: Column) -> Column:
    return F.when(stars >= 10_000, "high").when(stars >= 500, "medium").otherwise("low")


def activity(days: Column) -> Column:
    return F.when(days <= 30, "active").when(days <= 180, "steady").otherwise("stale")


def canonical_repo_url(url: Column) -> Column:
    """Lower-case scheme and host, https by default, no trailing slashes and one ``.git``; the path keeps its case."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", ""), "/+$", "")
    t = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    head = F.regexp_extract(t, "^([^/]*//[^/]*)", 1)
    return F.concat(F.lower(head), F.substring(t, F.length(head) + 1, F.length(t)))


def owner_name(url: Column) -> Column:
    """``owner/name`` of an address with exactly host, owner and name, else null."""
    t = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", "")
    hit = F.regexp_extract(t, r"^(?:[^:]*://)?[^/]*/([^/]+/[^/]+)$", 1)
    return F.when(hit != "", hit)


def split_repo(repo: Column) -> Column:
    """(owner, name) of ``owner/name``, else null."""
    return F.when(repo.rlike("^[^/]+/[^/]+$"), F.struct(F.substring_index(repo, "/", 1).alias("owner"), F.substring_index(repo, "/", -1).alias("name")))


def days_since(stamp: Column, as_of: Column) -> Column:
    """Whole days from the date prefix of a timestamp string; not negative, null if unparsable."""
    return F.greatest(F.datediff(as_of, F.substring(stamp, 1, 10).try_cast("date")), F.lit(0))


def format_wait(seconds: Column) -> Column:
    """``45s``, ``12m 30s``, ``1h 0m``; fractions round up."""
    s = F.ceil(seconds).cast("long")
    text = lambda x: x.cast("string")
    return F.when(s < 60, F.concat(text(s), F.lit("s"))).when(s < 3600, F.concat(text(F.floor(s / 60).cast("long")), F.lit("m "), text(s % 60), F.lit("s"))).otherwise(F.concat(text(F.floor(s / 3600).cast("long")), F.lit("h "), text(F.floor(s % 3600 / 60).cast("long")), F.lit("m")))


def log_saturate(v: Column, cap: float) -> Column:
    return F.when(v <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(v) / F.log1p(F.lit(float(cap)))))


def clamp(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def min_max(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi <= lo, 0.5).otherwise(clamp((v - lo) / F.nullif(hi - lo, F.lit(0.0))))


def bezier_score(x: Column, mean: Column) -> Column:
    """The cubic curve through (0,0), twice (mean, .75), (1,1) at abscissa x, by 64 bisections."""
    m, x = clamp(mean), clamp(x)
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) * 0.5
        at = m * mid * (1.0 - mid) * 3.0 + mid * mid * mid
        return F.struct(F.when(at < x, mid).otherwise(s["lo"]).alias("lo"), F.when(at < x, s["hi"]).otherwise(mid).alias("hi"))

    t = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda s: (s["lo"] + s["hi"]) * 0.5)
    return F.transform(F.array(t), lambda v: v * (1.0 - v) * 2.25 + v * v * v)[0]


def classify_query(text: Column) -> Column:
    """``identifier`` or ``natural_language`` by the shape of a query."""
    q = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    shaped = q.rlike(r"\p{Ll}\p{Lu}") | q.contains("::") | q.endswith("()") | q.startswith(".") | q.startswith("$") | q.rlike(r"(?U)(^|\s)(?=[\p{L}\p{N}_]*_)[\p{L}\p{N}_]{2,}(\s|$)")
    return F.when(q == "", "natural_language").when(~q.rlike(r"(?U)\s"), "identifier").when(shaped, "identifier").otherwise("natural_language")


def cap_line(line: Column) -> Column:
    extra = F.length(line) - MAX_LINE
    return F.when(extra > 0, F.concat(F.substring(line, 1, MAX_LINE), F.lit("…[+"), extra.cast("string"), F.lit(" chars truncated]"))).otherwise(line)


BIDI = "[‪-‮⁦-⁩]"
ESCAPES = "\x1b\\[[0-?]*[ -/]*[@-~]?|\x1b[\\]P][^\x07\x1b]*(?:\x07|\x1b\\\\?)?"
CONTROLS = "[\x00-\x08\x0b-\x1f\x7f-\x9f]"


def sanitize(text: Column) -> Column:
    """(text, bidi_escaped, controls_stripped): terminal escapes and controls go, direction marks become ``<U+XXXX>``."""
    plain = F.regexp_replace(F.regexp_replace(text, ESCAPES, ""), CONTROLS, "")
    for c in [*range(0x202A, 0x202F), *range(0x2066, 0x206A)]:
        plain = F.replace(plain, F.lit(chr(c)), F.lit(f"<U+{c:04X}>"))
    stripped = F.regexp_count(text, F.lit(ESCAPES)) + F.regexp_count(F.regexp_replace(text, ESCAPES, ""), F.lit(CONTROLS))
    return F.struct(plain.alias("text"), F.regexp_count(text, F.lit(BIDI)).cast("long").alias("bidi_escaped"), stripped.cast("long").alias("controls_stripped"))


def clean_snippet(html: Column) -> Column:
    """No ``<mark>`` tags; the five entities decoded, ``&amp;`` last."""
    out = F.regexp_replace(html, "</?mark>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def first_line(text: Column) -> Column:
    """The first line that is not blank, at most 200 characters."""
    return F.substring(F.coalesce(F.get(F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit("")), 1, 200)


def readme_digest(text: Column) -> Column:
    """The first six lines that are not blank, joined, at most 400 characters."""
    return F.substring(F.array_join(F.slice(F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x != ""), 1, 6), " "), 1, 400)


def spdx_tag(text: Column) -> Column:
    """The identifier of the first SPDX line in the first 8192 bytes, or null."""
    head = F.substring(text, 1, NUL_WINDOW)
    raw = F.regexp_extract(head, r"SPDX-License-Identifier:([^\r\n]*)", 1)
    tag = F.trim(F.regexp_replace(F.trim(raw), r"[\s*/]+$", ""))
    return F.when((tag != "") & (F.octet_length(tag) <= 128) & tag.rlike(r"^[A-Za-z0-9 .\-+(),]+$"), tag)
