"""Queries over sources, remote responses, the query language and streams. Responses are built from the driver tables."""

from __future__ import annotations

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from quarry.plans import stages, tools
from quarry.plans.language import Query as TextQuery
from quarry.plans.language import QueryError, plan
from quarry.plans.registry import query
from quarry.sources import backends, responses
from quarry.sources.tables import canonical_repo, safe_tree_rows, table, walk
from quarry.streaming import reindex

AS_OF = "2000-01-01"


def work_folder(spark, what: str) -> str:
    """A new folder below the shared one; a local master without a shared folder gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{os.urandom(8).hex()}"


# -- files ----------------------------------------------------------------------------------------

_EXT = "(['py', 'rs', 'md', 'jsx', 'txt'])[CAST(n_regionkey + 1 AS INT)]"
_PLACE = "CASE WHEN n_nationkey % 7 = 0 THEN '.git/' WHEN n_nationkey % 5 = 0 THEN 'web/node_modules/' ELSE 'src/' END"
_FILES = f"files AS (SELECT {_PLACE} || lower(replace(n_name, ' ', '_')) || '.' || {_EXT} AS path, 'line of ' || n_name AS content, {_EXT} AS ext FROM nation)"


def _tree(spark, d) -> str:
    """``nation`` as a tree of files, one a row, written by Spark's text writer."""
    root = work_folder(spark, "tree")
    n = table(spark, d, "nation")
    ext = F.element_at(F.array(*map(F.lit, ["py", "rs", "md", "jsx", "txt"])), F.col("n_regionkey") + 1)
    folder = F.when(F.col("n_nationkey") % 7 == 0, ".git/").when(F.col("n_nationkey") % 5 == 0, "web/node_modules/").otherwise("src/")
    rows = n.select(F.concat(folder, F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")), F.lit("."), ext).alias("path"), F.concat(F.lit("line of "), "n_name").alias("content"))
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for r in rows.toLocalIterator():  # 25 fixture files
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.path}")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(r.content.encode()))
        out.close()
    return root


@query("src_walk", f"WITH {_FILES} SELECT path, CAST(strlen(content) AS BIGINT) AS size, content FROM files WHERE path NOT LIKE '.git/%'")
def _(spark, d):
    return walk(spark, _tree(spark, d)).select("path", "size", "content")


@query("src_walk_index", f"WITH {_FILES} SELECT path, content FROM files WHERE path LIKE 'src/%'")
def _(spark, d):
    return walk(spark, _tree(spark, d), index=True).select("path", "content")


@query("src_walk_sources", f"WITH {_FILES} SELECT path, content FROM files WHERE path NOT LIKE '.git/%' AND ext IN ('py', 'rs', 'jsx')")
def _(spark, d):
    return walk(spark, _tree(spark, d), extensions=["rs", "py", "pyi", "js", "mjs", "cjs", "jsx"]).select("path", "content")


_TREE = """t AS (SELECT p_partkey AS id, (['100644', '100755', '120000', '160000'])[CAST(p_partkey % 4 + 1 AS INT)] AS mode, CASE WHEN p_partkey % 9 = 0 THEN 'tree' ELSE 'blob' END AS kind,
  (['src/', '/abs/', '../up/', 'a/../b/', '.git/', 'ok/.github/', 'c\\\\d/'])[CAST(p_partkey % 7 + 1 AS INT)] || p_partkey || '.rs' AS path, CAST(p_size * 30000 AS BIGINT) AS size FROM part)""".replace("\\\\", "\\")


@query("flt_tree_rows", f"WITH {_TREE} SELECT id, path FROM t WHERE kind = 'blob' AND mode NOT IN ('120000', '160000') AND size <= 1048576 AND (path LIKE 'src/%' OR path LIKE 'ok/%')")
def _(spark, d):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % n + 1).cast("int"))
    path = F.concat(pick(["src/", "/abs/", "../up/", "a/../b/", ".git/", "ok/.github/", "c\\d/"], 7), F.col("p_partkey").cast("string"), F.lit(".rs"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(["100644", "100755", "120000", "160000"], 4).alias("mode"), F.when(F.col("p_partkey") % 9 == 0, "tree").otherwise("blob").alias("kind"), path.alias("path"), (F.col("p_size") * 30000).cast("long").alias("size"))
    return safe_tree_rows(rows).select("id", "path")


@query("cas_forks", "SELECT s.s_name AS repo, c.s_name AS canonical FROM supplier s LEFT JOIN supplier c ON c.s_suppkey * 2 = s.s_suppkey")
def _(spark, d):
    s = table(spark, d, "supplier")
    forks = s.select((F.col("s_suppkey") * 2).alias("k"), F.col("s_name").alias("canonical")).join(s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("fork")), "k").select("fork", "canonical")
    return canonical_repo(s.select(F.col("s_name").alias("repo")), forks)


@query("src_stages", "SELECT * FROM (VALUES (1, 'count', TRUE), (2, 'count', FALSE), (3, 'count', TRUE)) t(run, stage, ran)")
def _(spark, d):
    """A stage runs, is skipped while its inputs are the same, and runs again when they have changed."""
    root, region = work_folder(spark, "stages"), table(spark, d, "region")
    repos = [r.r_name for r in region.select("r_name").collect()]
    rows = []
    for run, inputs in enumerate((repos, list(reversed(repos)), repos[:-1]), 1):
        rows.append((run, "count", stages.run(spark, root, "count", inputs, lambda names=inputs: region.where(F.col("r_name").isin(names)))[1]))
    return spark.createDataFrame(rows, "run int, stage string, ran boolean")


# -- requests -------------------------------------------------------------------------------------


@query("src_code_query", """SELECT p_partkey, concat_ws(' ', p_name, 'repo:org/' || p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'language:' || CASE WHEN contains(p_type, ' ') THEN '"' || p_type || '"' ELSE p_type END END, 'path:src') AS q, CAST(p_partkey // 100 + 1 AS BIGINT) AS page FROM part""")
def _(spark, d):
    key = F.col("p_partkey")
    none = F.lit(None).cast("string")
    q = backends.code_query(F.col("p_name"), repo=F.concat(F.lit("org/"), key.cast("string")), org=none, language=F.when(key % 3 > 0, F.col("p_type")), path=F.lit("src"))
    return table(spark, d, "part").select("p_partkey", q.alias("q"), backends.page_of(key, 100).alias("page"))


@query("sc_addresses", r"""SELECT page_id, replace(url, '/', '%2F') AS segment, 'https://h/api/x?q=' || replace(url_encode(url), '%20', '+') || '&n=' || page_id AS address, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '\.git$', '') AS name,
  regexp_replace(url, '([\\.+*?()|\[\]{}^$#&~-])', '\\\1', 'g') AS escaped FROM pages""")
def _(spark, d):
    url, key = F.col("url"), F.col("page_id").cast("string")
    address = backends.build_url("https://h", F.lit("/api/x"), {"q": url, "n": key})
    return table(spark, d, "pages").select("page_id", backends.encode_segment(url).alias("segment"), address.alias("address"), backends.repo_name(url).alias("name"), backends.regex_escape(url).alias("escaped"))


_WAIT = """CASE WHEN event_id % 4 = 0 THEN least(event_id % 5000, 3600) WHEN event_id % 4 = 1 THEN least(greatest(epoch(date_trunc('second', ts)) - 1000000000.5, 0), 3600)
  WHEN event_id % 4 = 2 AND event_id % 8 = 2 AND 999999900 + event_id > 1000000000 THEN least(999999900 + event_id - 1000000000, 3600) END"""


@query("sc_rate_limits", f"SELECT event_id, CAST({_WAIT} AS DOUBLE) AS wait, event_id % 3 = 0 OR event_id % 3 = 1 AND (event_id % 8 = 2 OR event_id % 4 < 2) AS limited FROM events")
def _(spark, d):
    k = F.col("event_id")
    date = F.concat(F.lit("Thu, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    after = F.when(k % 4 == 0, (k % 5000).cast("string")).when(k % 4 == 1, date)
    remaining = F.when(k % 4 == 2, F.when(k % 8 == 2, "0").otherwise("5"))
    reset = F.when(k % 4 == 2, (k + 999999900).cast("string"))
    status = F.when(k % 3 == 0, 429).when(k % 3 == 1, 403).otherwise(500)
    return table(spark, d, "events").select("event_id", backends.wait_seconds(after, remaining, reset, F.lit(1000000000.5)).alias("wait"), backends.rate_limited(status, remaining, after).alias("limited"))


@query("sc_probes", "SELECT event_id, 'id ' || event_id AS probe, event_id % 2 = 0 AS regex, CASE WHEN event_id % 3 = 0 THEN event_id END AS line, CASE WHEN event_id % 2 = 0 THEN 'o/r' END AS repo, CASE WHEN event_id % 2 = 0 THEN 'a/' || event_id || '.rs' END AS path FROM events")
def _(spark, d):
    k, text = F.col("event_id"), F.col("event_id").cast("string")
    probe = backends.strip_delimiters(F.when(k % 2 == 0, F.concat(F.lit("/id "), text, F.lit("/"))).otherwise(F.concat(F.lit("id "), text)))
    line = backends.line_no(F.when(k % 3 == 0, F.concat(F.lit("  "), text, F.lit("│ x"))).otherwise(F.concat(text, F.lit("x"))))
    blob = backends.blob_url(F.when(k % 2 == 0, F.concat(F.lit(" https://github.com/o/r/blob/main/a/"), text, F.lit(".rs/"))).otherwise("https://github.com/o/r/tree/main"))
    return table(spark, d, "events").select("event_id", probe["probe"].alias("probe"), probe["regex"].alias("regex"), line.alias("line"), blob["repo"].alias("repo"), blob["path"].alias("path"))


# -- responses ------------------------------------------------------------------------------------


@query("src_snippet_blocks", """SELECT s_suppkey AS id, b AS block, 'org/' || s_name AS repo, 'src/' || b || '.rs' AS path, 'https://github.com/org/' || s_name || '/blob/HEAD/src/' || b || '.rs' AS url, CASE WHEN b = 1 THEN 'MIT' END AS license,
  CASE WHEN b = 1 THEN s_suppkey ELSE 7 END AS start, CASE WHEN b = 1 THEN s_suppkey + 20 ELSE 7 END AS "end", CASE WHEN b = 1 THEN 'one' || chr(10) || 'Path: two' || chr(10) || 'three' ELSE 'x' END AS snippet FROM supplier, (VALUES (1), (2)) t(b)""")
def _(spark, d):
    name, k = F.concat(F.lit("org/"), "s_name"), F.col("s_suppkey")
    first = ["Found 2\nRepository: ", name, "\nPath: src/1.rs\nLicense: MIT\nSnippets:\n--- Snippet 1 (Line ", k.cast("string"), ") ---\none\nPath: two\n--- Snippet 2 (Line ", (k + 20).cast("string"), ") ---\nthree\n"]
    second = ["Repository: ", name, "\nPath: src/2.rs\nLicense: Unknown\n--- Snippet 1 (Line 7) ---\nx\nRepository: no/path\n"]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in first + second])
    return responses.snippet_blocks(table(spark, d, "supplier").select(k.alias("id"), text.alias("text")))


@query("src_numbered_snippets", """SELECT s_suppkey AS id, b AS block, 'o/r' || b AS repo, 'f.rs' AS path, 'https://github.com/o/r' || b || '/blob/main/f.rs' AS url, CASE WHEN b = 1 THEN 'Apache-2.0' END AS license, CASE WHEN b = 1 THEN s_suppkey END AS start, CASE WHEN b = 1 THEN s_suppkey + 3 END AS "end",
  CASE WHEN b = 1 THEN (s_suppkey + 3) || ': b' || chr(10) || s_suppkey || '| a' || chr(10) || '9x' ELSE 'no number' END AS snippet FROM supplier, (VALUES (1), (2)) t(b)""")
def _(spark, d):
    k = F.col("s_suppkey")
    parts = ["lost\nhttps://github.com/o/r1/blob/main/f.rs\nLicense: Apache-2.0\n\n", (k + 3).cast("string"), ": b\n", k.cast("string"), "| a\n9x\nhttps://github.com/o/r2/blob/main/f.rs\nLicense: unknown\nno number\n"]
    return responses.numbered_snippets(table(spark, d, "supplier").select(k.alias("id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("text")))


@query("src_legacy_hits", """SELECT p_partkey AS id, 'org/' || p_name AS repo, 'a.rs' AS path, 'x < ' || p_size AS snippet, 'MIT' AS license, p_size * 0.5::DOUBLE AS score, CAST(p_size AS BIGINT) AS total, p_size > 3 AS has_more FROM part""")
def _(spark, d):
    content = F.struct(F.concat(F.lit("org/"), "p_name").alias("repo"), F.lit("a.rs").alias("path"), F.concat(F.lit("x <mark>&lt;</mark> "), F.col("p_size").cast("string")).alias("snippet"), F.lit("MIT").alias("license"))
    hits = F.struct(F.col("p_size").alias("total"), F.array(F.struct((F.col("p_size") * 0.5).alias("score"), content.alias("content"))).alias("hits"))
    return responses.legacy_hits(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(hits.alias("hits"))).alias("body")), offset=2)


_STREAM = """SELECT s_suppkey AS request, 'org/' || s_name AS repo, 'a.rs' AS path, 'https://github.com/org/' || s_name || '/blob/' || CASE WHEN s_suppkey % 2 = 0 THEN 'abc' ELSE 'HEAD' END || '/a.rs' AS url, s_suppkey AS start, s_suppkey + 5 AS "end", 'one' || chr(10) || 'two' AS snippet FROM supplier
UNION ALL SELECT s_suppkey, 'gitlab.com/x', 'b.rs', 'https://s/gitlab.com/x/-/blob/b.rs', NULL, NULL, '' FROM supplier"""


def _stream(spark, d):
    k = F.col("s_suppkey")
    line = lambda n, t: F.struct(F.lit(t).alias("line"), n.alias("lineNumber"))
    one = lambda kind, repo, path, commit, lines: F.struct(F.lit(kind).alias("type"), repo.alias("repository"), F.lit(path).alias("path"), commit.alias("commit"), lines.alias("lineMatches"))
    found = F.array(line(k, "one  "), line(k + 5, "two"))
    hub = F.concat(F.lit("github.com/org/"), "s_name")
    none = found.getItem(0)
    empty = F.filter(F.array(none), lambda x: F.lit(False))
    data = F.to_json(F.array(one("content", hub, "a.rs", F.when(k % 2 == 0, "abc").otherwise(""), found), one("symbol", hub, "s.rs", F.lit(""), empty), one("path", F.lit("gitlab.com/x"), "b.rs", F.lit(""), empty)))
    progress = F.when(k % 3 == 0, '{"done":false,"skipped":[{"reason":"shard-match-limit"}]}').otherwise('{"done":true,"skipped":[]}')
    body = F.concat(F.lit("event: matches\ndata: "), data, F.lit("\n\nevent: progress\ndata: "), progress, F.lit('\n\nevent: alert\r\ndata: {"message":"slow"}\r\n\r\nevent: error\ndata: {"message":"first"}\n\nevent: error\ndata: second\n\nevent: matches\ndata: [{"half'))
    cut = F.array(F.struct(F.lit(0).alias("seq"), F.left(body, F.lit(40)).alias("chunk")), F.struct(F.lit(1).alias("seq"), F.substring(body, F.lit(41), F.length(body)).alias("chunk")))
    return table(spark, d, "supplier").select(k.alias("request"), F.explode(cut).alias("x")).select("request", "x.seq", "x.chunk")


@query("src_stream_hits", _STREAM)
def _(spark, d):
    return responses.stream_hits(reindex.parse_events(_stream(spark, d)), "https://s")


@query("str_stream_state", "SELECT s_suppkey AS request, s_suppkey % 3 <> 0 AS done, s_suppkey % 3 = 0 AS match_limit, 'first' AS error, CAST(1 AS BIGINT) AS warnings FROM supplier")
def _(spark, d):
    return responses.stream_states(reindex.parse_events(_stream(spark, d)))


@query("src_contents", """SELECT doc_id AS id, 'p/' || doc_id AS path, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL""")
def _(spark, d):
    raw = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n")
    body = F.to_json(F.struct(F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.lit("base64").alias("encoding"), raw.alias("content")))
    out = responses.file_contents(table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), body.alias("body")))
    return out.select("id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "size")


@query("src_tree", "SELECT p_partkey AS id, 'f' || p_partkey AS path, 'blob' AS kind, CAST(p_size AS BIGINT) AS size FROM part UNION ALL SELECT p_partkey, 'd', 'tree', NULL FROM part")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit('{"sha":"x","tree":[{"path":"f'), k, F.lit('","size":'), F.col("p_size").cast("string"), F.lit('},{"path":"d","type":"tree"},{"type":"blob"}]}'))
    return responses.tree_entries(table(spark, d, "part").select(F.col("p_partkey").alias("id"), body.alias("body")))


@query("src_packages", """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'npm' ELSE 'git' END AS url, '' AS snippet, 'ISC' AS license, CASE WHEN p_size % 3 = 0 THEN 0.25 ELSE 7.5 END::DOUBLE AS score, CAST(p_size AS BIGINT) AS total, p_size > 1 AS has_more, FALSE AS capped FROM part""")
def _(spark, d):
    size = F.col("p_size")
    package = F.struct(F.col("p_name").alias("name"), F.lit("ISC").alias("license"), F.struct(F.when(size % 2 == 0, "npm").alias("npm"), F.lit("git").alias("repository")).alias("links"))
    one = F.struct(package.alias("package"), F.when(size % 3 == 0, F.struct(F.lit(0.25).alias("final"))).alias("score"), F.lit(7.5).alias("searchScore"))
    return responses.package_hits(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(size.alias("total"), F.array(one).alias("results"))).alias("body")))


@query("src_stale", f"SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}') AS INT) AS days, date_diff('day', CAST(l_shipdate AS DATE), DATE '{AS_OF}') > 90 AS stale FROM lineitem")
def _(spark, d):
    stamp, as_of = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(AS_OF).cast("date")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", responses.days_old(stamp, as_of).alias("days"), responses.is_stale(stamp, as_of).alias("stale"))


_LOOKUP = f"""r AS (SELECT p_partkey AS id, 'org/' || p_name AS full_name, CASE WHEN p_size % 4 > 0 THEN 'mit' END AS license, CASE WHEN p_size % 5 > 0 THEN CAST(p_size * 400 AS BIGINT) END AS stars, CAST(p_size AS BIGINT) AS forks, p_size % 10 = 0 AS archived, CAST(p_size * 7 AS INT) AS age FROM part)"""


def _lookups(spark, d):
    size = F.col("p_size")
    body = F.struct(
        F.concat(F.lit("org/"), "p_name").alias("full_name"), F.when(size % 4 > 0, "mit").alias("license"), F.when(size % 5 > 0, size * 400).alias("stargazers_count"), size.alias("forks_count"),
        F.when(size % 10 == 0, True).alias("archived"), F.concat(F.date_sub(F.lit(AS_OF).cast("date"), size * 7).cast("string"), F.lit("T00:00:00Z")).alias("pushed_at"), F.lit("u").alias("html_url"),
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 > 0, F.to_json(body)).alias("body"))


@query("src_repositories", f"WITH {_LOOKUP} SELECT id, full_name, license, stars AS stargazers_count, forks AS forks_count FROM r WHERE id % 11 > 0")
def _(spark, d):
    return responses.repositories(_lookups(spark, d)).select("id", "full_name", "license", "stargazers_count", "forks_count")


def _versions(spark, d):
    v = F.struct(F.struct(F.lit("NPM").alias("system"), F.col("p_name").alias("name"), F.col("l_orderkey").cast("string").alias("version")).alias("versionKey"), (F.col("l_orderkey") == F.col("newest")).alias("isDefault"), F.when(F.col("l_linenumber") == 7, True).alias("isDeprecated"))
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    newest = li.groupBy("l_partkey").agg(F.max("l_orderkey").alias("newest"))
    rows = li.join(newest, "l_partkey").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.groupBy(F.col("p_partkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(v).alias("versions"))).alias("body"))


_VERSIONS = "v AS (SELECT l_partkey AS id, count(*) AS tracked, CAST(max(l_orderkey) AS VARCHAR) AS newest, bool_or(l_linenumber = 7) AS deprecated FROM lineitem GROUP BY 1)"


@query("src_versions", f"WITH {_VERSIONS} SELECT id, tracked AS versions_tracked, newest AS default_version, deprecated AS any_deprecated FROM v")
def _(spark, d):
    return responses.version_summary(responses.versions(_versions(spark, d))).select("id", "versions_tracked", "default_version", "any_deprecated")


@query("txt_live_profile", f"""WITH {_LOOKUP}, {_VERSIONS} SELECT r.id, full_name AS repo, coalesce(stars, 0) AS stars, CASE WHEN coalesce(stars, 0) >= 10000 THEN 'high' WHEN coalesce(stars, 0) >= 500 THEN 'medium' ELSE 'low' END AS star_tier, upper(license) AS license,
  CASE WHEN license IS NOT NULL THEN 'permissive' END AS license_class, archived, age AS days_since_activity, CASE WHEN age <= 30 THEN 'active' WHEN age <= 180 THEN 'steady' ELSE 'stale' END AS activity, tracked AS versions_tracked, newest AS default_version, deprecated AS any_deprecated FROM r LEFT JOIN v USING (id) WHERE r.id % 11 > 0""")
def _(spark, d):
    out = responses.live_profile(responses.repositories(_lookups(spark, d)), responses.version_summary(responses.versions(_versions(spark, d))), F.lit(AS_OF).cast("date"))
    return out.drop("forks", "url", "default_published_at")


@query("src_systems", "SELECT p_partkey, (['cargo', 'npm', 'pypi', 'nuget', NULL])[CAST(p_partkey % 5 + 1 AS INT)] AS system, CASE WHEN p_partkey % 2 = 0 THEN 'pypi' ELSE 'npm' END AS asked, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE ':' || p_name END AS name FROM part")
def _(spark, d):
    language = F.element_at(F.array(*map(F.lit, ["Rust", "TypeScript", "py", "C#", "cobol"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    asked = responses.system_query(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("PyPI:"), "p_name")).otherwise(F.concat(F.lit(":"), "p_name")))
    return table(spark, d, "part").select("p_partkey", responses.system_of(language).alias("system"), asked["system"].alias("asked"), asked["name"].alias("name"))


@query("src_errors", "SELECT event_id, (['timeout', 'rate_limited', 'rate_limited', 'backend', 'ok'])[CAST(event_id % 5 + 1 AS INT)] AS kind, (['degraded', 'unavailable', 'unavailable', 'degraded', 'ok'])[CAST(event_id % 5 + 1 AS INT)] AS status FROM events")
def _(spark, d):
    k = F.col("event_id") % 5
    got = responses.response_status(F.when(k == 1, 429).when(k == 3, 503).otherwise(200), F.when(k == 2, "Text/HTML; charset=utf-8").otherwise("application/json"), F.when(k == 0, "timeout"))
    return table(spark, d, "events").select("event_id", got["kind"].alias("kind"), got["status"].alias("status"))


# -- the query language ---------------------------------------------------------------------------


def _language(rows, f, schema):
    """``f`` of each text of (key, text), by Arrow batches: a dict of the result columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([{"key": k, **f(t)} for k, t in zip(frame["key"], frame["text"], strict=True)], columns=["key", *names])

    return rows.mapInPandas(run, f"key long, {schema}")


@query("ql_parse", "SELECT p_partkey AS key, p_name AS pattern, 'org/' || p_size AS repos, CASE WHEN p_size % 2 = 0 THEN 'regex' ELSE 'literal' END AS kind, CASE WHEN p_size % 3 = 0 THEN 'sensitive' ELSE 'insensitive' END AS \"case\", 'rust,go' AS langs FROM part")
def _(spark, d):
    size = F.col("p_size")
    text = F.concat("p_name", F.lit(" repo:org/"), size.cast("string"), F.when(size % 2 == 0, " type:regex").otherwise(""), F.when(size % 3 == 0, " case:yes").otherwise(""), F.lit(" lang:rust,go"))

    def parse(t):
        q = TextQuery.from_text(t)
        return {"pattern": q.pattern, "repos": ",".join(q.repos), "kind": q.kind, "case": q.case, "langs": ",".join(q.langs)}

    return _language(table(spark, d, "part").select(F.col("p_partkey").alias("key"), text.alias("text")), parse, "pattern string, repos string, kind string, case string, langs string")


@query("ql_round_trip", "SELECT p_partkey AS key, p_name || ' type:regex repo:org/' || p_size || ' -lang:go scope:test in:remote' AS again, TRUE AS same_json FROM part")
def _(spark, d):
    text = F.concat("p_name", F.lit(" in:remote -lang:go repo:org/"), F.col("p_size").cast("string"), F.lit(" scope:test type:regex"))

    def again(t):
        q = TextQuery.from_text(t)
        return {"again": q.to_text(), "same_json": TextQuery.from_json(json.dumps(q.__dict__)) == TextQuery.from_text(q.to_text()) == q}

    return _language(table(spark, d, "part").select(F.col("p_partkey").alias("key"), text.alias("text")), again, "again string, same_json boolean")


@query("ql_validate", "SELECT p_partkey AS key, (['ok', 'regex_error', 'regex_error', 'not_indexable', 'unknown_field', 'parse_error', 'not_indexable'])[CAST(p_partkey % 7 + 1 AS INT)] AS outcome FROM part")
def _(spark, d):
    texts = ["fn part_\\w+ type:regex", "(part)\\1 type:regex", "pa(?=rt) type:regex", "a.b type:regex", "Vec::new", "part case:maybe", "ab"]
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 7 + 1).cast("int")).alias("text"))

    def check(t):
        try:
            TextQuery.from_text(t).validate()
        except QueryError as e:
            return {"outcome": e.kind}
        return {"outcome": "ok"}

    return _language(rows, check, "outcome string")


@query("ql_plan", "SELECT p_partkey AS key, (['local_index', 'grep_app,github,sourcegraph', 'local_index,grep_app,github,sourcegraph'])[CAST(p_partkey % 3 + 1 AS INT)] AS legs, CAST((['0', '1', '1'])[CAST(p_partkey % 3 + 1 AS INT)] AS BIGINT) AS warnings FROM part")
def _(spark, d):
    scope = F.element_at(F.array(*map(F.lit, ["hotset", "remote", "both"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("part_[0-9]+ type:regex in:"), scope).alias("text"))

    def legs(t):
        found = plan(TextQuery.from_text(t))
        return {"legs": ",".join(b for b, _ in found), "warnings": sum(len(w) for _, w in found)}

    return _language(rows, legs, "legs string, warnings long")


@query("ql_tool_schemas", "SELECT * FROM (VALUES ('fetch_docs', 2), ('fetch_file', 2), ('guide', 0), ('list_repos', 0), ('repo_profile', 1), ('repo_tree', 1), ('search_code', 1)) t(tool, required)")
def _(spark, d):
    rows = [(name, len(schema["required"])) for name, schema in tools.schemas().items()]
    return spark.createDataFrame(rows, "tool string, required int")


# -- streams --------------------------------------------------------------------------------------


def _seconds(col: str):
    """Seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(col)) / 1e6


def _batch(stream, spark, name: str):
    """The rows of a stream that has come to its end."""
    out = work_folder(spark, name)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("str_cooldowns", """WITH RECURSIVE e AS (SELECT event_type AS backend, epoch(ts) AS "at", CASE WHEN event_id % 3 = 0 THEN 60.0 ELSE least(value * 40, 3600.0) END AS wait, row_number() OVER (PARTITION BY event_type ORDER BY epoch(ts), event_id) AS i FROM events WHERE event_type <> 'none'),
s AS (SELECT backend, "at", i, "at" + wait AS until FROM e WHERE i = 1 UNION ALL SELECT e.backend, e."at", e.i, CASE WHEN s.until > e."at" THEN greatest(s.until, e."at" + e.wait) ELSE e."at" + e.wait END FROM s JOIN e ON e.backend = s.backend AND e.i = s.i + 1)
SELECT backend, round("at", 3) AS "at", round(until, 3) AS until FROM s""")
def _(spark, d):
    land = work_folder(spark, "limits")
    wait = F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("value") * 40)
    table(spark, d, "events").select(F.col("event_type").alias("backend"), _seconds("ts").alias("at"), wait.alias("wait")).write.parquet(land)
    stream = spark.readStream.schema("backend string, at double, wait double").parquet(land)
    return _batch(reindex.cooldowns(stream), spark, "cooldowns").select("backend", F.round("at", 3).alias("at"), F.round("until", 3).alias("until"))


@query("str_events", "SELECT s_suppkey AS request, count(*) AS events, string_agg(name, ',' ORDER BY i) AS names FROM supplier, (VALUES (0, 'matches'), (1, 'progress'), (2, 'alert'), (3, 'error'), (4, 'error')) t(i, name) GROUP BY 1")
def _(spark, d):
    land = work_folder(spark, "chunks")
    _stream(spark, d).write.parquet(land)
    stream = spark.readStream.schema("request long, seq int, chunk string").parquet(land)
    rows = _batch(reindex.parse_stream(stream), spark, "events")
    names = F.transform(F.sort_array(F.collect_list(F.struct("idx", "event"))), lambda x: x["event"])
    return rows.groupBy("request").agg(F.count("*").alias("events"), F.array_join(names, ",").alias("names"))


@query("str_permits", """SELECT event_type AS backend, event_id, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) < 60.0 / 0.01 - 1e-9, FALSE) AS early FROM events""")
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("backend"), _seconds("ts").alias("at"), "event_id")
    return reindex.permit_gaps(rows, 0.01, tie="event_id").select("backend", "event_id", "early")


_CHANGES = """c AS (SELECT 'org/' || source AS repo, 'f' || (doc_id // 3) AS path, doc_id AS seq, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS content FROM documents),
w AS (SELECT repo, path, max(seq) AS seq, arg_max(CASE WHEN content IS NULL OR strlen(content) > 1048576 THEN '' ELSE 'x' || content END, seq) AS v FROM c GROUP BY 1, 2)"""


@query("str_reindex", f"WITH {_CHANGES} SELECT repo, path, seq, md5(substr(v, 2)) AS digest FROM w WHERE v <> ''")
def _(spark, d):
    """Changes land in two files, the later half first: latest wins, and deletions last."""
    root = work_folder(spark, "reindex")
    docs = table(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("org/"), "source").alias("repo"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 3).cast("string")).alias("path"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("content"), F.col("doc_id").alias("seq"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    middle = docs.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY doc_id)")).first()[0]
    for part in (rows.where(F.col("seq") > middle), rows.where(F.col("seq") <= middle)):
        part.write.mode("append").parquet(f"{root}/land")
        reindex.reindex(spark, f"{root}/land", f"{root}/store", f"{root}/checkpoint", "repo string, path string, content string, seq long").awaitTermination()
    return reindex.read_store(spark, f"{root}/store").select("repo", "path", "seq", F.md5(F.col("content").cast("binary")).alias("digest"))
