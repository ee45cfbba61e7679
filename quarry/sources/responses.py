"""Parsers of remote responses: (id, body) frames to rows of hits, files, packages and repositories. No network access takes place here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.sources import backends

#: What npms.io serves at most, and when its analysis counts as old.
NPMS_MAX_SIZE, NPMS_MAX_FROM, STALE_DAYS = 250, 10_000, 90
#: Package systems by language.
SYSTEMS = {
    "cargo": ("rust", "cargo"), "npm": ("javascript", "js", "typescript", "ts", "npm"), "pypi": ("python", "py", "pypi"), "go": ("go", "golang"),
    "maven": ("java", "jvm", "maven"), "rubygems": ("ruby", "rubygems"), "nuget": ("c#", "csharp", "nuget", ".net"),
}


def _known(license_: Column) -> Column:
    return F.when(F.lower(license_) != "unknown", license_)


def _after(prefix: str) -> Column:
    return F.trim(F.substring("line", len(prefix) + 1, F.length("line")))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.posexplode(S.lines_of(F.col("text"))).alias("i", "line"))


def snippet_blocks(texts: DataFrame) -> DataFrame:
    """(id, block, repo, path, url, license, start, end, snippet) of texts (id, text) with ``Repository:`` blocks.

    What a line means depends on the lines before it in its response: the block, whether a snippet has begun, and where it starts
    are carried over the lines by windows. Header lines only count before the first snippet line.
    """
    lines = _lines(texts)
    response = Window.partitionBy("id").orderBy("i")
    repo = F.col("line").startswith("Repository: ")
    lines = lines.withColumn("block", F.count_if(repo).over(response))
    block = Window.partitionBy("id", "block").orderBy("i")
    mark = F.col("line").startswith("--- Snippet ") & F.col("line").contains("(Line ") & ~repo
    lines = lines.withColumn("mark", mark).withColumn("section", F.count_if("mark").over(block))
    at = F.when(F.col("mark"), F.coalesce(F.regexp_extract("line", r"\(Line\s*(\d+)\)*(?: ---)?\s*$", 1).try_cast("long"), F.lit(-1)))
    lines = lines.withColumn("at", F.last(at, ignorenulls=True).over(block)).where("block > 0")
    body = ~F.col("mark") & ~repo & (F.coalesce("at", F.lit(-1)) >= 0)
    begun = F.count_if(body).over(block.rowsBetween(Window.unboundedPreceding, -1))
    head = lambda p: F.when(~body & (F.coalesce(F.col("begun"), F.lit(0)) == 0) & F.col("line").startswith(p), _after(p))
    lines = lines.withColumn("begun", begun).withColumns({"repo": F.when(repo, _after("Repository: ")), "path": head("Path: "), "url": head("URL: "), "license": head("License: ")})
    size = F.count_if(body).over(Window.partitionBy("id", "block", "section"))
    lines = lines.withColumn("end", F.when(F.col("at") >= 0, F.col("at") + F.greatest(size - 1, F.lit(0))))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("i"))).alias(c)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(body, F.struct("i", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("id", "block").agg(*[last(c) for c in ("repo", "path", "url", "license")], F.min(F.when(F.col("at") >= 0, F.col("at"))).alias("start"), F.max("end").alias("end"), F.trim(text, F.lit(" \n\t\r")).alias("snippet"))
    url = F.coalesce("url", F.concat(F.lit("https://github.com/"), "repo", F.lit("/blob/HEAD/"), "path"))
    return out.where("repo IS NOT NULL AND path IS NOT NULL").select("id", "block", "repo", "path", url.alias("url"), _known(F.col("license")).alias("license"), "start", "end", "snippet")


def numbered_snippets(texts: DataFrame) -> DataFrame:
    """(id, block, repo, path, url, license, start, end, snippet) of texts (id, text) in which blob addresses head numbered lines; start and end unite the numbers."""
    lines = _lines(texts).withColumn("blob", backends.blob_url(F.col("line")))
    lines = lines.withColumn("block", F.count_if(F.col("blob").isNotNull()).over(Window.partitionBy("id").orderBy("i"))).where("block > 0")
    license_ = F.when(F.trim("line").startswith("License:"), F.trim(F.substring(F.trim("line"), 9, F.length("line"))))
    lines = lines.withColumn("license", license_)
    body = F.col("blob").isNull() & F.col("license").isNull() & (F.trim("line") != "")
    number = F.when(body, backends.line_no(F.col("line")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(body, F.struct("i", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("id", "block").agg(
        F.max("blob").alias("b"), F.max_by("license", F.when(F.col("license").isNotNull(), F.col("i"))).alias("license"), F.min(number).alias("start"), F.max(number).alias("end"), F.trim(text, F.lit(" \n\t\r")).alias("snippet"),
    )
    return out.select("id", "block", "b.repo", "b.path", "b.url", _known(F.col("license")).alias("license"), "start", "end", "snippet")


def legacy_hits(bodies: DataFrame, offset: int = 0) -> DataFrame:
    """(id, repo, path, snippet, license, score, total, has_more) of JSON search pages (id, body)."""
    kind = "hits struct<total: bigint, hits: array<struct<score: double, content: struct<repo: string, path: string, snippet: string, license: string>>>>"
    page = bodies.select("id", F.from_json("body", kind).alias("p"))
    more = F.coalesce(F.col("p.hits.total") > F.size("p.hits.hits") + offset, F.lit(False))
    each = page.select("id", F.col("p.hits.total").alias("total"), more.alias("has_more"), F.explode("p.hits.hits").alias("h"))
    return each.select("id", "h.content.repo", "h.content.path", S.clean_snippet(F.coalesce("h.content.snippet", F.lit(""))).alias("snippet"), "h.content.license", "h.score", "total", "has_more")


def stream_hits(events: DataFrame, base: str) -> DataFrame:
    """(request, repo, path, url, start, end, snippet) of the ``matches`` events (request, idx, event, data) of a stream."""
    kind = "array<struct<type: string, repository: string, path: string, commit: string, lineMatches: array<struct<line: string, lineNumber: bigint>>>>"
    each = events.where("event = 'matches'").select("request", F.explode(F.from_json("data", kind)).alias("m")).where("m.type IN ('content', 'path') AND m.repository IS NOT NULL AND m.path IS NOT NULL")
    hub = F.col("m.repository").startswith("github.com/")
    name = F.when(hub, F.substring("m.repository", 12, F.length("m.repository"))).otherwise(F.col("m.repository"))
    rev = F.when(F.coalesce(F.col("m.commit"), F.lit("")) != "", F.col("m.commit")).otherwise("HEAD")
    url = F.when(hub, F.concat(F.lit("https://github.com/"), name, F.lit("/blob/"), rev, F.lit("/"), "m.path")).otherwise(F.concat(F.lit(base + "/"), "m.repository", F.lit("/-/blob/"), "m.path"))
    numbers, found = F.transform("m.lineMatches", lambda x: x["lineNumber"]), F.transform("m.lineMatches", lambda x: F.rtrim(x["line"]))
    return each.select("request", name.alias("repo"), F.col("m.path").alias("path"), url.alias("url"), F.array_min(numbers).alias("start"), F.array_max(numbers).alias("end"), F.array_join(found, "\n").alias("snippet"))


def stream_states(events: DataFrame) -> DataFrame:
    """(request, done, match_limit, error, warnings) over the events of each request; the first error counts."""
    progress = F.from_json("data", "done boolean, skipped array<struct<reason: string>>")
    message = F.coalesce(F.get_json_object("data", "$.message"), F.col("data"))
    is_ = lambda name: F.col("event") == name
    rows = events.select("request", "idx", "event", progress.alias("p"), message.alias("message"))
    limited = F.coalesce(F.exists("p.skipped", lambda x: x["reason"].endswith("limit")), F.lit(False))
    return rows.groupBy("request").agg(
        F.bool_or(is_("done") | (is_("progress") & F.coalesce(F.col("p.done"), F.lit(False)))).alias("done"), F.bool_or(is_("progress") & limited).alias("match_limit"),
        F.min_by("message", F.when(is_("error"), F.col("idx"))).alias("error"), F.count_if(is_("alert")).alias("warnings"),
    )


def file_contents(bodies: DataFrame) -> DataFrame:
    """(id, path, text, size, encoding) of file responses (id, body); base64 may be broken over lines. A null body (not found) gives no row."""
    kind = "path string, size bigint, encoding string, content string"
    p = bodies.where("body IS NOT NULL").select("id", F.from_json("body", kind).alias("p")).select("id", "p.*")
    text = F.when(F.lower("encoding") == "base64", F.unbase64(F.regexp_replace("content", r"\s", "")).cast("string")).otherwise(F.coalesce("content", F.lit("")))
    return p.select("id", "path", text.alias("text"), F.coalesce("size", F.octet_length(text).cast("long")).alias("size"), "encoding")


def tree_entries(bodies: DataFrame) -> DataFrame:
    """(id, path, kind, size) of tree responses (id, body); entries without a path go, those without a type are blobs."""
    p = bodies.where("body IS NOT NULL").select("id", F.explode(F.from_json("body", "tree array<struct<path: string, type: string, size: bigint>>")["tree"]).alias("e"))
    return p.where("e.path IS NOT NULL").select("id", "e.path", F.coalesce("e.type", F.lit("blob")).alias("kind"), "e.size")


def package_hits(bodies: DataFrame, *, size: int = 25, offset: int = 0) -> DataFrame:
    """(id, name, url, snippet, license, score, total, has_more, capped) of package searches (id, body): the final score, else that of the search."""
    package = "package struct<name: string, description: string, license: string, links: struct<npm: string, repository: string>>"
    kind = f"total bigint, results array<struct<{package.replace(' struct', ': struct', 1)}, score: struct<final: double>, searchScore: double>>"
    page = bodies.select("id", F.from_json("body", kind).alias("p"))
    more = F.coalesce(F.col("p.total") > F.size("p.results") + min(offset, NPMS_MAX_FROM), F.lit(False))
    each = page.select("id", F.col("p.total").alias("total"), more.alias("has_more"), F.explode("p.results").alias("r"))
    capped = F.lit(size > NPMS_MAX_SIZE or offset > NPMS_MAX_FROM)
    return each.select(
        "id", "r.package.name", F.coalesce("r.package.links.npm", "r.package.links.repository").alias("url"), F.coalesce("r.package.description", F.lit("")).alias("snippet"), "r.package.license",
        F.coalesce("r.score.final", "r.searchScore").alias("score"), "total", "has_more", capped.alias("capped"),
    )


def is_stale(analyzed_at: Column, as_of: Column) -> Column:
    """Whether an analysis is over STALE_DAYS old; unknown dates are not."""
    return F.coalesce(days_old(analyzed_at, as_of) > STALE_DAYS, F.lit(False))


def days_old(stamp: Column, as_of: Column) -> Column:
    """Days since a timestamp with a ``T``; null without one or if it is no date. May be negative."""
    return F.when(stamp.contains("T"), F.datediff(as_of, F.substring_index(stamp, "T", 1).try_cast("date")))


_REPO = (
    "full_name string, description string, license string, stargazers_count bigint, forks_count bigint, open_issues_count bigint, pushed_at string, homepage string, "
    "repository_url string, html_url string, archived boolean, language string, topics array<string>"
)


def repositories(bodies: DataFrame) -> DataFrame:
    """Metadata rows of repository lookups (id, body); a null body (not found) gives no row."""
    return bodies.where("body IS NOT NULL").select("id", F.from_json("body", _REPO).alias("p")).select("id", "p.*")


def versions(bodies: DataFrame) -> DataFrame:
    """(id, system, name, version, is_default, is_deprecated, published_at) of package responses (id, body)."""
    one = "array<struct<versionKey: struct<system: string, name: string, version: string>, isDefault: boolean, isDeprecated: boolean, publishedAt: string>>"
    p = bodies.where("body IS NOT NULL").select("id", F.from_json("body", f"packageVersions {one}, versions {one}").alias("p"))
    none = F.array().cast(one)
    each = p.select("id", F.posexplode(F.concat(F.coalesce("p.packageVersions", none), F.coalesce("p.versions", none))).alias("i", "v"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return each.select("id", "i", "v.versionKey.system", "v.versionKey.name", "v.versionKey.version", flag("v.isDefault").alias("is_default"), flag("v.isDeprecated").alias("is_deprecated"), F.col("v.publishedAt").alias("published_at"))


def version_summary(rows: DataFrame) -> DataFrame:
    """Per id: versions_tracked, the first default version and when it was published, and whether any version is deprecated."""
    first = F.when(F.col("is_default"), F.col("i"))
    pick = lambda c: F.min_by(c, first)
    return rows.groupBy("id").agg(F.count("*").alias("versions_tracked"), pick("version").alias("default_version"), pick("published_at").alias("default_published_at"), F.bool_or("is_deprecated").alias("any_deprecated"))


def system_of(language: Column) -> Column:
    """The package system of a language (case ignored), or null."""
    known = F.create_map(*[F.lit(x) for system, names in SYSTEMS.items() for n in names for x in (n, system)])
    return F.try_element_at(known, F.lower(language))


def system_query(query: Column) -> Column:
    """(system, name) of ``system:name``; anything else is a name at npm."""
    system, name = F.lower(F.substring_index(query, ":", 1)), F.regexp_extract(query, "(?s)^[^:]*:(.*)$", 1)
    split = query.contains(":") & (system != "") & (name != "")
    return F.struct(F.when(split, system).otherwise("npm").alias("system"), F.when(split, name).otherwise(query).alias("name"))


def live_profile(repos: DataFrame, packages: DataFrame, as_of: Column) -> DataFrame:
    """Repository metadata with derived tiers, and the versions of the package of the same name: a left join on id."""
    days = S.days_since(F.col("pushed_at"), as_of)
    license_ = F.upper("license")
    rows = repos.join(packages, "id", "left")
    return rows.select(
        "id", F.col("full_name").alias("repo"), F.coalesce("stargazers_count", F.lit(0)).alias("stars"), S.star_tier(F.coalesce("stargazers_count", F.lit(0))).alias("star_tier"), F.coalesce("forks_count", F.lit(0)).alias("forks"),
        license_.alias("license"), F.when(license_.isNotNull(), S.license_class(license_)).alias("license_class"), F.coalesce("archived", F.lit(False)).alias("archived"), days.alias("days_since_activity"),
        F.when(days.isNotNull(), S.activity(days)).alias("activity"), F.coalesce("html_url", "repository_url").alias("url"), "versions_tracked", "default_version", "default_published_at", "any_deprecated",
    )


#: What an error of a client means for its backend.
ERRORS = {"timeout": "degraded", "transport": "degraded", "decode": "degraded", "backend": "degraded", "rate_limited": "unavailable", "invalid_query": "error"}


def response_status(http_status: Column, content_type: Column, failure: Column) -> Column:
    """(kind, status) of a response: ``failure`` is timeout or transport where there was none; markup instead of data is a bot challenge."""
    kind = F.when(failure.isNotNull(), failure).when(http_status == 429, "rate_limited").when(F.lower(content_type).contains("text/html"), "rate_limited")
    kind = kind.when((http_status < 200) | (http_status > 299), "backend").otherwise("ok")
    states = F.create_map(*[F.lit(x) for kv in ({"ok": "ok"} | ERRORS).items() for x in kv])
    return F.struct(kind.alias("kind"), states[kind].alias("status"))
