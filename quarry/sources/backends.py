"""Remote search backends as data: capabilities, request strings, rate limits. No network access takes place here."""

from __future__ import annotations

from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_WAIT = 3600.0
#: Backend, regex, and filters by language, repo, organisation and path, auth needed, line numbers.
CAPABILITIES = [
    ("github", False, True, True, True, True, True, False),
    ("grep.app", True, True, True, False, True, False, False),
    ("sourcegraph", True, True, True, True, True, False, True),
    ("npms.io", False, False, False, False, False, False, False),
    ("ecosyste.ms", False, False, True, False, False, False, False),
    ("deps.dev", False, False, False, False, False, False, False),
]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "backend string, regex boolean, language_filter boolean, repo_filter boolean, org_filter boolean, path_filter boolean, auth_required boolean, line_numbers boolean")


def legs(spark: SparkSession, *, regex: bool = False, filters: tuple[str, ...] = ()) -> DataFrame:
    """Backends that can serve a request with these filters (language, repo, org, path)."""
    rows = capabilities(spark)
    for need in (["regex"] if regex else []) + [f"{f}_filter" for f in filters]:
        rows = rows.where(F.col(need))
    return rows.select("backend")


def qualifier_value(value: Column) -> Column:
    """Quoted where it has white space or quotes; inner quotes go."""
    v = F.trim(value)
    return F.when(v.rlike(r'(?U)[\s"]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit("")), F.lit('"'))).otherwise(v)


def repo_query(text: Column, language: Column, min_stars: Column, topic: Column) -> Column:
    """Free text with language, stars and topic qualifiers; null without text."""
    part = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:"), qualifier_value(c)))
    stars = F.when(min_stars > 0, F.concat(F.lit("stars:>="), min_stars.cast("string")))
    return F.when(F.trim(text) != "", F.concat_ws(" ", F.trim(text), part("language", language), stars, part("topic", topic)))


def strip_delimiters(probe: Column) -> Column:
    """(probe, regex): ``/x/`` without its slashes."""
    inner = F.regexp_extract(probe, "(?s)^/(.+)/$", 1)
    return F.when(inner != "", F.struct(inner.alias("probe"), F.lit(True).alias("regex"))).otherwise(F.struct(probe.alias("probe"), F.lit(False).alias("regex")))


def blob_url(line: Column) -> Column:
    """(repo, path, url) of a blob address, else null."""
    t = F.regexp_replace(F.trim(line), "/+$", "")
    pattern = r"^https://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/?(.*)$"
    g = [F.regexp_extract(t, pattern, i) for i in range(1, 5)]
    repo = F.concat(g[0], F.lit("/"), g[1])
    url = F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/"), g[2], F.lit("/"), g[3])
    return F.when(g[0] != "", F.struct(repo.alias("repo"), g[3].alias("path"), url.alias("url")))


def line_no(line: Column) -> Column:
    """The number that starts a line before a bar, colon, tab or space."""
    return F.regexp_extract(line, r"^\s*(\d+)[│|:\t ]", 1).try_cast("long")


def is_rate_limited(status: int, headers: dict[str, str]) -> bool:
    return status == 429 or status == 403 and (headers.get("x-ratelimit-remaining", "").strip() == "0" or "retry-after" in headers)


def rate_limit_wait(headers: dict[str, str], now: float) -> float | None:
    """Seconds that a server asks to wait, at most an hour: Retry-After, else the reset time when nothing remains."""
    after = headers.get("retry-after", "").strip()
    if after.isdigit():
        return min(float(after), MAX_WAIT)
    if after:
        try:
            return min(max(0.0, parsedate_to_datetime(after).timestamp() - now), MAX_WAIT)
        except (TypeError, ValueError):
            pass
    reset = headers.get("x-ratelimit-reset", "").strip()
    if headers.get("x-ratelimit-remaining", "0").strip() == "0" and reset.isdigit() and int(reset) > int(now):
        return min(float(int(reset) - int(now)), MAX_WAIT)
    return None


def wait_seconds(retry_after: Column, remaining: Column, reset: Column, now: Column) -> Column:
    """``rate_limit_wait`` on columns: header strings and the time in seconds."""
    after = F.trim(F.coalesce(retry_after, F.lit("")))
    date = F.try_to_timestamp(F.regexp_replace(after, r"^[A-Za-z]+,\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), date.cast("timestamp_ntz"))  # whatever the session's time zone
    dated = F.greatest(seconds.cast("double") - now, F.lit(0.0))
    until = F.trim(F.coalesce(reset, F.lit(""))).try_cast("long").cast("double")
    spent = F.trim(F.coalesce(remaining, F.lit("0"))) == "0"
    wait = F.when(after.rlike("^[0-9]+$"), after.try_cast("double")).when(date.isNotNull(), dated).when(spent & (until > F.floor(now)), until - F.floor(now))
    return F.when(wait.isNotNull(), F.least(wait, F.lit(MAX_WAIT)))


def rate_limited(status: Column, remaining: Column, retry_after: Column) -> Column:
    """``is_rate_limited`` on columns."""
    return (status == 429) | ((status == 403) & (F.coalesce(F.trim(remaining) == "0", F.lit(False)) | retry_after.isNotNull()))


def code_query(pattern: Column, *, repo: Column, org: Column, language: Column, path: Column) -> Column:
    """The request string of a code search: the pattern, quoted where it must be, and qualifiers; null without a pattern."""
    part = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{name}:"), qualifier_value(c)))
    return F.when(F.trim(pattern) != "", F.concat_ws(" ", F.trim(pattern), part("repo", repo), part("org", org), part("language", language), part("path", path)))


def page_of(offset: Column, per_page: int) -> Column:
    """The 1-based page that holds an offset."""
    return F.floor(offset / per_page).cast("long") + 1


def regex_escape(text: Column) -> Column:
    """The text with every character escaped that means something in a regex."""
    return F.regexp_replace(text, r"([\\.+*?()|\[\]{}^$#&~-])", r"\\$1")


def encode_segment(segment: Column) -> Column:
    """A path segment of an address: slashes are escaped."""
    return F.replace(segment, F.lit("/"), F.lit("%2F"))


def build_url(base: str, path: Column, params: dict[str, Column]) -> Column:
    """An address with form-encoded parameters."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items()]
    return F.concat(F.lit(base), path, F.lit("?"), F.concat_ws("&", *pairs))


def repo_name(url: Column) -> Column:
    """The last segment of an address, without ``.git``."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1), r"\.git$", "")
