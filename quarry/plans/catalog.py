"""The registry of queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import dedup, graph, rank, retrieval, search, semantic
from quarry.plans.language import Query as TextQuery
from quarry.plans.registry import QUERIES, SQL, Query
from quarry.plans.registry import query as _query
from quarry.sources import backends
from quarry.sources.tables import blobs, docs_view, last_wins, table

DOCS = """docs AS (
  SELECT doc_id, 'org/' || source AS repo,
    CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE 'src/' END || lang || '/doc_' || doc_id || '.' || (['rs', 'py', 'js', 'go', 'md', 'txt'])[CAST(doc_id % 6 + 1 AS INT)] AS path,
    text AS content FROM documents)"""
LINES = """lines AS (
  SELECT doc_id, repo, path, i AS line_no, parts[i] AS line FROM (
    SELECT doc_id, repo, path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id, repo, path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts FROM (SELECT *, string_split_regex(content, '\\r?\\n') AS p FROM docs))))""".replace("\\\\", "\\")
LANG = """CASE regexp_extract(path, '[^.]*$') WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown' ELSE 'text' END"""
PROBE, PROBES = "thtion", ["thtion", "erentan", "worthless"]


def _docs(spark, sf_dir):
    return docs_view(table(spark, sf_dir, "documents"))


def scored_sql(p: str, tag: str = "") -> str:
    """Scored literal matches of one probe, case-insensitive; CTEs need docs and lines."""
    word = f"regexp_extract_all(regexp_replace(lower(line), '([^A-Za-z0-9_])', '\\1\\1', 'g'), '(^|[^A-Za-z0-9_]){p}([^A-Za-z0-9_]|$)')"
    return f"""h{tag} AS (
  SELECT repo, path, line_no, line, (length(line) - length(replace(lower(line), '{p}', ''))) / {len(p)} AS n, len({word}) AS w FROM lines WHERE contains(lower(line), '{p}')
), s{tag} AS (
  SELECT repo, path, count(*) AS matched_lines, CASE WHEN bool_or(n = w) THEN 2.0 ELSE 0.0 END AS whole_word, min(line_no) AS first_line, arg_min(line, line_no) AS first_text FROM h{tag} GROUP BY repo, path
), sc{tag} AS (
  SELECT *, CASE WHEN path LIKE 'src/%' OR path LIKE '%/src/%' THEN 1.0 ELSE 0.0 END AS definition_path,
    CASE WHEN lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%' THEN -1.0 ELSE 0.0 END AS test_path,
    CASE WHEN contains(lower(split_part(split_part(path, '/', -1), '.', 1)), '{p}') THEN 2.0 ELSE 0.0 END AS filename_match,
    least(1.0::DOUBLE, 100.0::DOUBLE / (strlen(path) + 20)) AS path_length, ln(1 + matched_lines) AS density FROM s{tag}
)"""


TOTAL = "round(whole_word::DOUBLE + 0 + definition_path + test_path + filename_match + path_length + density, 6)"

# -- filters and scalars --------------------------------------------------------------------------


@_query("flt_filters", f"WITH {DOCS} SELECT doc_id, repo, path FROM docs WHERE (contains(repo, 'src1') OR contains(repo, 'src3')) AND NOT contains(repo, 'src13') AND {LANG} IN ('rust', 'python') AND NOT contains(path, 'tests/')")
def _(spark, d):
    return _docs(spark, d).where(search.allows(repos=["src1", "src3"], exclude_repos=["src13"], langs=["rust", "python"], exclude_paths=["tests/"])).select("doc_id", "repo", "path")


@_query("flt_lang", f"WITH {DOCS} SELECT {LANG} AS lang, count(*) AS n FROM docs GROUP BY 1")
def _(spark, d):
    return _docs(spark, d).groupBy(S.detect_lang(F.col("path")).alias("lang")).agg(F.count("*").alias("n"))


@_query("flt_admission", f"WITH {DOCS} SELECT doc_id, strlen(content) <= 1048576 AND NOT contains(left(content, 8192), chr(0)) AS admitted FROM docs")
def _(spark, d):
    return _docs(spark, d).select("doc_id", S.admitted(F.col("content")).alias("admitted"))


@_query("flt_repo_phrases", f"WITH {DOCS} SELECT doc_id, repo FROM docs WHERE contains(lower(repo), 'src1') OR contains(lower(repo), 'rc7')")
def _(spark, d):
    phrases = [p.strip().lower() for p in "SRC1; rc7".split(";")]
    return _docs(spark, d).where(F.lower("repo").contains(phrases[0]) | F.lower("repo").contains(phrases[1])).select("doc_id", "repo")


@_query("prj_derived", """SELECT p_partkey, CASE WHEN p_size * 500 >= 10000 THEN 'high' WHEN p_size * 500 >= 500 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN p_size * 10 <= 30 THEN 'active' WHEN p_size * 10 <= 180 THEN 'steady' ELSE 'stale' END AS activity, round(p_retailprice, 4) AS price FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.star_tier(F.col("p_size") * 500).alias("tier"), S.activity(F.col("p_size") * 10).alias("activity"), F.round("p_retailprice", 4).alias("price"))


@_query("sc_format_wait", """SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS wait FROM (SELECT event_id, CAST(ceil(abs(value) * 7.3) AS BIGINT) AS s FROM events)""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.format_wait(F.abs("value") * 7.3).alias("wait"))


@_query("sc_days_since", "SELECT l_orderkey, l_linenumber, CAST(greatest(date_diff('day', CAST(l_shipdate AS DATE), DATE '1998-01-01'), 0) AS INT) AS days FROM lineitem")
def _(spark, d):
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.days_since(stamp, F.lit("1998-01-01").cast("date")).alias("days"))


@_query("sc_license_class", "SELECT p_partkey, CASE WHEN starts_with(u, 'AGPL') THEN 'AGPL' WHEN contains(u, 'GPL') THEN 'copyleft' WHEN regexp_matches(u, 'MIT|APACHE|BSD|ISC|ZPL|0BSD') THEN 'permissive' ELSE 'unknown' END AS class FROM (SELECT p_partkey, upper((['mit', 'AGPL-3.0', 'LGPL-2.1', 'Apache-2.0', 'proprietary', 'ZPL-2.1'])[CAST(p_partkey % 6 + 1 AS INT)]) AS u FROM part)")
def _(spark, d):
    name = F.element_at(F.array(*map(F.lit, ["mit", "AGPL-3.0", "LGPL-2.1", "Apache-2.0", "proprietary", "ZPL-2.1"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", S.license_class(name).alias("class"))


@_query("sc_clean_snippet", """SELECT page_id, md5(replace(replace(replace(replace(replace(regexp_replace(html, '</?mark>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS digest FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(S.clean_snippet(F.col("html")).cast("binary")).alias("digest"))


@_query("sc_cap_line", f"WITH {DOCS} SELECT doc_id, CASE WHEN length(content) > 500 THEN left(content, 500) || '…[+' || (length(content) - 500) || ' chars truncated]' ELSE content END AS line FROM docs")
def _(spark, d):
    return _docs(spark, d).select("doc_id", S.cap_line(F.col("content")).alias("line"))


@_query("sh_sanitize", """WITH t AS (SELECT conv_id, turn, chr(27) || '[31m' || text || chr(27) || '[0m' || chr(8238) || 'x' || chr(7) AS s FROM conversations)
SELECT conv_id, turn, text, CAST(1 AS BIGINT) AS bidi_escaped, CAST(3 + len(regexp_extract_all(text0, '[\\x00-\\x08\\x0b-\\x1f\\x7f]|\\x{80}|[\\x{81}-\\x{9f}]')) AS BIGINT) AS controls_stripped FROM (
  SELECT t.conv_id, t.turn, c.text AS text0, regexp_replace(c.text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]|[\\x{80}-\\x{9f}]', '', 'g') || '<U+202E>x' AS text FROM t JOIN conversations c USING (conv_id, turn))""".replace("\\\\", "\\"))
def _(spark, d):
    wrapped = F.concat(F.lit("\x1b[31m"), "text", F.lit("\x1b[0m‮x\x07"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.sanitize(wrapped).alias("s")).select("conv_id", "turn", "s.text", "s.bidi_escaped", "s.controls_stripped")


@_query("hy_classify", r"""SELECT conv_id, turn, CASE WHEN q = '' THEN 'natural_language' WHEN NOT regexp_matches(q, '\s') THEN 'identifier'
  WHEN regexp_matches(q, '\p{Ll}\p{Lu}') OR contains(q, '::') OR q LIKE '%()' OR q LIKE '.%' OR q LIKE '$%' OR regexp_matches(q, '(^|\s)([\p{L}\p{N}]+_[\p{L}\p{N}_]*|_[\p{L}\p{N}_]+)(\s|$)') THEN 'identifier' ELSE 'natural_language' END AS kind
FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM conversations)""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.classify_query(F.col("text")).alias("kind"))


@_query("rk_canonical", r"""SELECT page_id, lower(regexp_extract(t, '^[^/]*//[^/]*')) || substr(t, length(regexp_extract(t, '^[^/]*//[^/]*')) + 1) AS url,
  nullif(regexp_extract(regexp_replace(regexp_replace(url, '/+$', ''), '\.git$', ''), '^(?:[^:]*://)?[^/]*/([^/]+/[^/]+)$', 1), '') AS owner_name
FROM (SELECT page_id, url, CASE WHEN contains(c, '://') THEN c ELSE 'https://' || c END AS t FROM (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(trim(url), '/+$', ''), '\.git$', ''), '/+$', '') AS c FROM pages))""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.canonical_repo_url(F.col("url")).alias("url"), S.owner_name(F.col("url")).alias("owner_name"))


@_query("rk_bezier", """SELECT p_partkey, round(CASE WHEN hi <= lo THEN 0.5 ELSE (p_retailprice - lo) / (hi - lo) END, 6) AS normalized FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""")
def _(spark, d):
    rows = table(spark, d, "part")
    agg = rows.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return rows.join(F.broadcast(agg)).select("p_partkey", F.round(S.min_max(F.col("p_retailprice"), F.col("lo"), F.col("hi")), 6).alias("normalized"))


@_query("sc_entropy", f"WITH {DOCS}, b AS (SELECT doc_id, h[2 * i + 1:2 * i + 2] AS c FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM (SELECT doc_id, hex(encode(content)) AS h FROM docs))), g AS (SELECT doc_id, c, count(*) AS k FROM b GROUP BY 1, 2), n AS (SELECT doc_id, k, sum(k) OVER (PARTITION BY doc_id) AS n FROM g) SELECT doc_id, round(-sum(k / n * log2(k / n)), 6) AS entropy FROM n GROUP BY doc_id")
def _(spark, d):
    return search.entropies(_docs(spark, d)).select("doc_id", F.round("entropy", 6).alias("entropy"))


# -- search ---------------------------------------------------------------------------------------


@_query("txt_literal_ci", f"WITH {DOCS}, {LINES} SELECT repo, path, CAST(line_no AS BIGINT) AS line_no, line FROM lines WHERE contains(lower(line), '{PROBE}')")
def _(spark, d):
    return search.line_matches(_docs(spark, d), TextQuery(PROBE)).select("repo", "path", "line_no", "line")


@_query("txt_literal_cs", f"WITH {DOCS}, {LINES} SELECT repo, path, CAST(line_no AS BIGINT) AS line_no, line FROM lines WHERE contains(line, 'Thtion')")
def _(spark, d):
    return search.line_matches(_docs(spark, d), TextQuery("Thtion", case="sensitive")).select("repo", "path", "line_no", "line")


@_query("txt_regex", f"WITH {DOCS}, {LINES} SELECT repo, path, CAST(line_no AS BIGINT) AS line_no, line FROM lines WHERE regexp_matches(line, 'th(tion|erent)[a-z]+ing')")
def _(spark, d):
    return search.line_matches(_docs(spark, d), TextQuery("th(tion|erent)[a-z]+ing", kind="regex", case="sensitive")).select("repo", "path", "line_no", "line")


for _name, _pattern in (("txt_regex_start", "^[A-Z][a-z]+ion "), ("txt_regex_end", "[a-z]+ing\\.$"), ("txt_regex_whole", "^[^ ]+tion [^.]+\\.$")):
    # anchors mean the ends of lines

    def _anchored(spark, d, pattern=_pattern):
        return search.line_matches(_docs(spark, d), TextQuery(pattern, kind="regex", case="sensitive")).select("repo", "path", "line_no", "line")

    _query(_name, f"WITH {DOCS}, {LINES} SELECT repo, path, CAST(line_no AS BIGINT) AS line_no, line FROM lines WHERE regexp_matches(line, '{_pattern}')")(_anchored)


@_query("txt_scored_topk", f"WITH {DOCS}, {LINES}, {scored_sql(PROBE)} SELECT repo, path, matched_lines, whole_word::DOUBLE AS whole_word, test_path::DOUBLE AS test_path, round(density, 6) AS density, {TOTAL} AS score FROM sc ORDER BY score DESC, path, repo LIMIT 50")
def _(spark, d):
    return search.top(search.scored(_docs(spark, d), TextQuery(PROBE))).select("repo", "path", "matched_lines", "whole_word", "test_path", "density", "score")


_MULTI = f"WITH {DOCS}, {LINES}, " + ", ".join(scored_sql(p, str(i)) for i, p in enumerate(PROBES)) + ", hits AS (" + " UNION ALL ".join(f"SELECT * FROM (SELECT {i} AS probe_idx, '{p}' AS probe, repo, path, {TOTAL} AS score, matched_lines, first_text FROM sc{i} ORDER BY score DESC, path, repo LIMIT 500)" for i, p in enumerate(PROBES)) + ")"


@_query("txt_multi_probe", f"{_MULTI} SELECT repo, path, string_agg(probe, ',' ORDER BY probe) AS probes, count(*) AS breadth, max(score) AS score FROM hits GROUP BY repo, path")
def _(spark, d):
    out = search.merge_probes(search.multi_probe(_docs(spark, d), PROBES))
    return out.select("repo", "path", F.array_join("probes", ",").alias("probes"), "breadth", "score")


@_query("txt_repo_rollup", f"{_MULTI} SELECT repo, count(DISTINCT probe) AS breadth, count(DISTINCT path) AS files, arg_min(left(first_text, 40), (probe_idx, path)) AS sample FROM hits GROUP BY repo")
def _(spark, d):
    out = search.roll_up(search.multi_probe(_docs(spark, d), PROBES))
    return out.select("repo", "breadth", "files", F.substring("sample", 1, 40).alias("sample"))


@_query("txt_snippets", f"""WITH {DOCS}, {LINES}, {scored_sql(PROBE)}, b AS (SELECT repo, path, first_line, row_number() OVER (PARTITION BY repo ORDER BY {TOTAL} DESC, path) AS rn FROM sc), n AS (SELECT repo, path, max(line_no) AS total FROM lines GROUP BY 1, 2)
SELECT b.repo, b.path, CAST(greatest(first_line - 5, 1) AS BIGINT) AS start_line, CAST(least(first_line + 5, total) AS BIGINT) AS end_line, CAST(first_line AS BIGINT) AS match_line, b.path || ':L' || greatest(first_line - 5, 1) || '-L' || least(first_line + 5, total) AS locator,
  (SELECT string_agg(CASE WHEN length(line) > 500 THEN left(line, 500) || '…[+' || (length(line) - 500) || ' chars truncated]' ELSE line END, chr(10) ORDER BY line_no) FROM lines l WHERE l.repo = b.repo AND l.path = b.path AND l.line_no BETWEEN greatest(first_line - 5, 1) AND least(first_line + 5, total)) AS body
FROM b JOIN n ON b.repo = n.repo AND b.path = n.path WHERE rn <= 2""")
def _(spark, d):
    docs = _docs(spark, d)
    return search.snippets(search.scored(docs, TextQuery(PROBE)), docs).withColumn("body", F.array_join("lines", "\n")).drop("lines")


@_query("txt_fetch_file", f"WITH {DOCS}, {LINES} SELECT repo, path, (SELECT max(line_no) FROM lines l WHERE l.path = docs.path AND l.repo = docs.repo) AS total_lines, (SELECT string_agg(line, chr(10) ORDER BY line_no) FROM lines l WHERE l.path = docs.path AND l.repo = docs.repo AND line_no BETWEEN 2 AND 4) AS text FROM docs WHERE doc_id = 7")
def _(spark, d):
    docs = _docs(spark, d)
    at = docs.where("doc_id = 7").select("repo", "path").first()
    return search.fetch_file(docs, at.repo, at.path, 2, 4)


@_query("txt_tree", f"WITH {DOCS} SELECT path, CAST(strlen(content) AS BIGINT) AS size FROM docs WHERE repo = 'org/src3' AND path LIKE 'src/%' AND path LIKE '%.py' ORDER BY path LIMIT 200")
def _(spark, d):
    return search.tree(_docs(spark, d), "org/src3", prefix="src/", glob="*.py")


@_query("txt_profile", f"""WITH {DOCS} SELECT repo, count(*) AS files, string_agg(DISTINCT {LANG}, ',' ORDER BY {LANG}) AS languages, string_agg(DISTINCT split_part(path, '/', 1), ',' ORDER BY split_part(path, '/', 1)) AS top_dirs,
  arg_min(left(array_to_string(list_filter(list_transform(string_split_regex(content, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')[1:6], ' '), 400), path) FILTER (WHERE path LIKE '%.md') AS digest FROM docs GROUP BY repo""")
def _(spark, d):
    return search.profiles(_docs(spark, d)).select("repo", "files", F.array_join("languages", ",").alias("languages"), F.array_join("top_dirs", ",").alias("top_dirs"), "digest")


@_query("txt_listing", f"WITH {DOCS} SELECT repo, count(*) AS files FROM docs GROUP BY repo")
def _(spark, d):
    return search.repo_listing(_docs(spark, d))


@_query("txt_docs_grep", f"WITH {DOCS}, {LINES} SELECT repo, path, count(*) AS n_lines, string_agg(line_no, ',' ORDER BY line_no) AS at FROM lines WHERE regexp_matches(path, '\\.(md|txt)$') AND contains(lower(line), '{PROBE}') GROUP BY repo, path")
def _(spark, d):
    out = search.grep_docs(_docs(spark, d), PROBE)
    return out.select("repo", "path", "n_lines", F.array_join(F.transform("lines", lambda x: x["line"].cast("string")), ",").alias("at"))


@_query("txt_postings", f"WITH {DOCS}, h AS (SELECT doc_id, hex(encode(content)) AS h FROM docs WHERE strlen(content) BETWEEN 3 AND 1048576), g AS (SELECT doc_id, substr(h, CAST(2 * o + 1 AS INT), 6) AS gram FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 2)) AS o FROM h)) SELECT CAST('0x' || gram AS INT) AS gram, count(*) AS postings, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram")
def _(spark, d):
    return search.trigrams(_docs(spark, d)).groupBy("gram").agg(F.sum(F.size("offsets")).alias("postings"), F.count("*").alias("docs"))


@_query("txt_planned", f"WITH {DOCS} SELECT doc_id FROM docs WHERE contains(content, 'tht') AND contains(content, 'hti') AND contains(content, 'tio') AND contains(content, 'ion')")
def _(spark, d):
    return search.planned_candidates(search.trigrams(_docs(spark, d)), search.gram_plan(TextQuery(PROBE, case="sensitive")))


@_query("txt_update", f"WITH {DOCS} SELECT doc_id, repo, path, md5(CASE WHEN doc_id % 10 = 0 THEN reverse(content) ELSE content END) AS digest FROM docs WHERE repo <> 'org/src4'")
def _(spark, d):
    docs = _docs(spark, d)
    out = search.remove_repo(search.update_docs(docs, docs.where("doc_id % 10 = 0").withColumn("content", F.reverse("content"))), "org/src4")
    return out.select("doc_id", "repo", "path", F.md5(F.col("content").cast("binary")).alias("digest"))


@_query("lm_page", f"WITH {DOCS}, {LINES}, {scored_sql(PROBE)} SELECT repo, path, {TOTAL} AS score FROM sc ORDER BY score DESC, path, repo LIMIT 10 OFFSET 5")
def _(spark, d):
    return search.page_of(search.scored(_docs(spark, d), TextQuery(PROBE)).select("repo", "path", "score"), [F.desc("score"), "path", "repo"], 5, 10)


@_query("lm_budget", """SELECT item_id, text FROM (SELECT *, sum(strlen('{"item_id":' || item_id || ',"text":' || to_json(text) || '}')) OVER (ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS b FROM benchmark) WHERE b <= 5000""")
def _(spark, d):
    return search.byte_budget(table(spark, d, "benchmark"), ["item_id"], 5000)


# -- dedup, corpus, licenses, chunks --------------------------------------------------------------

TOKENS = "list_transform(list_filter(string_split_regex(content, '[^A-Za-z0-9]+'), lambda t: t <> ''), lambda t: lower(t))"
TIERS = f"""{DOCS}, t AS (SELECT doc_id AS seq, sha256(content) AS hash, {TOKENS} AS toks FROM docs), x AS (
  SELECT *, min(seq) OVER (PARTITION BY hash) AS first, sha256(list_aggregate(list_transform(toks, lambda t: t || chr(31)), 'string_agg', '')) AS thash FROM t
), r AS (SELECT *, min(seq) OVER (PARTITION BY thash) AS tfirst, arg_min(hash, seq) OVER (PARTITION BY thash) AS thead FROM x WHERE seq = first), u AS (SELECT * FROM r WHERE seq = tfirst)"""


@_query("dd_tokens", f"WITH {DOCS} SELECT doc_id, CAST(len({TOKENS}) AS INT) AS n, sha256(coalesce(list_aggregate(list_transform({TOKENS}, lambda t: t || chr(31)), 'string_agg', ''), '')) AS hash FROM docs")
def _(spark, d):
    return dedup.token_rows(_docs(spark, d)).withColumnRenamed("seq", "doc_id")


_NEAR = f"""{TIERS}, w AS (SELECT DISTINCT seq, s FROM (SELECT seq, unnest(list_transform(range(1, greatest(len(toks) - 4, 1) + 1), lambda i: array_to_string(toks[i:i + 4], ' '))) AS s FROM u WHERE len(toks) >= 50)
), n AS (SELECT seq, count(*) AS k FROM w GROUP BY seq), p AS (SELECT a.seq, b.seq AS other, count(*) AS common FROM w a JOIN w b ON a.s = b.s AND b.seq < a.seq GROUP BY 1, 2
), nr AS (SELECT p.seq, other, common / (n1.k + n2.k - common) AS sim FROM p JOIN n n1 ON p.seq = n1.seq JOIN n n2 ON p.other = n2.seq WHERE common / (n1.k + n2.k - common) >= 0.85
), best AS (SELECT seq, arg_max(other, (sim, -other)) AS o, max(sim) AS sim FROM nr GROUP BY seq)"""
_VERDICTS = f"""WITH {_NEAR}, v AS (SELECT seq, 'exact' AS kind, hash AS "of", NULL::DOUBLE AS similarity FROM x WHERE seq > first
UNION ALL SELECT seq, 'token', thead, NULL FROM r WHERE seq > tfirst UNION ALL SELECT u.seq, CASE WHEN o IS NULL THEN 'unique' ELSE 'near' END, CAST(o AS VARCHAR), round(sim, 6) FROM u LEFT JOIN best ON u.seq = best.seq)"""


@_query("dd_classify", f'{_VERDICTS} SELECT seq, kind, "of", similarity FROM v')
def _(spark, d):
    return dedup.classify(_docs(spark, d)).withColumn("similarity", F.round("similarity", 6))


@_query("dd_counts", f"{_VERDICTS} SELECT kind, count(*) AS n FROM v GROUP BY kind")
def _(spark, d):
    return dedup.classify(_docs(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@_query("cas_stats", "SELECT count(*) AS blobs, CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum(offered) AS BIGINT) AS offered_bytes, round(sum(offered) / sum(raw), 6) AS ratio FROM (SELECT max(strlen(text)) AS raw, sum(strlen(text)) AS offered FROM documents GROUP BY text)")
def _(spark, d):
    return dedup.cas_stats(_docs(spark, d))


@_query("cas_blobs", "SELECT DISTINCT sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS raw_len FROM documents")
def _(spark, d):
    return blobs(_docs(spark, d)).select("hash", "raw_len")


@_query("cas_manifest", f"WITH {DOCS} SELECT repo, path, max(doc_id) AS doc_id FROM (SELECT doc_id, repo, regexp_replace(path, '[0-9]+', '') AS path FROM docs) GROUP BY repo, path")
def _(spark, d):
    rows = _docs(spark, d).select("doc_id", "repo", F.regexp_replace("path", "[0-9]+", "").alias("path"))
    return last_wins(rows, ["repo", "path"], "doc_id").select("repo", "path", "doc_id")


@_query("ag_totals", f"WITH {DOCS} SELECT coalesce({LANG}, 'total') AS lang, count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM docs GROUP BY {LANG} UNION ALL SELECT 'total', count(*), CAST(sum(strlen(content)) AS BIGINT) FROM docs")
def _(spark, d):
    return _docs(spark, d).rollup(S.detect_lang(F.col("path")).alias("lang")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes")).withColumn("lang", F.coalesce("lang", F.lit("total")))


@_query("ch_windows", f"""WITH {DOCS}, {LINES}, n AS (SELECT repo, path, max(line_no) AS total FROM lines GROUP BY 1, 2), a AS (SELECT repo, path, total, unnest(range(0, CAST(greatest(ceil((total - 60) / 50), 0) * 50 + 1 AS BIGINT), 50)) AS "at" FROM n)
SELECT a.repo || '/' || a.path || ':' || (a."at" + 1) || '-' || least(a."at" + 60, total) AS id, CAST(a."at" + 1 AS BIGINT) AS start_line, CAST(least(a."at" + 60, total) AS BIGINT) AS end_line, md5((SELECT string_agg(line, chr(10) ORDER BY line_no) FROM lines l WHERE l.repo = a.repo AND l.path = a.path AND line_no > a."at" AND line_no <= a."at" + 60)) AS digest FROM a""")
def _(spark, d):
    return dedup.window_chunks(_docs(spark, d)).select("id", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("digest"))


# -- vectors, fusion, evaluation ------------------------------------------------------------------

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _first_vector(spark, d):
    return list(table(spark, d, "embeddings").where("vec_id = 0").first().embedding)


@_query("ve_cosine", f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def _(spark, d):
    return retrieval.cosine_top_k(_vectors(spark, d), _first_vector(spark, d), 10).withColumn("score", F.round("score", 6))


@_query("ve_filtered", f"SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def _(spark, d):
    return retrieval.cosine_top_k(_vectors(spark, d), _first_vector(spark, d), 10, F.col("label") == 3).withColumn("score", F.round("score", 6))


@_query("hy_rrf", """WITH l AS (SELECT p_partkey AS id, 1.0 / (3 + row_number() OVER (ORDER BY p_size DESC, p_partkey)) AS lex FROM part), v AS (SELECT l_partkey AS id, 1.0 / (3 + row_number() OVER (ORDER BY q DESC, l_partkey)) AS dense FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 700))
SELECT coalesce(l.id, v.id) AS id, round(coalesce(lex, 0)::DOUBLE, 9) AS lex, round(coalesce(dense, 0)::DOUBLE, 9) AS dense, round((coalesce(lex, 0) + coalesce(dense, 0))::DOUBLE, 9) AS score FROM l FULL JOIN v ON l.id = v.id""")
def _(spark, d):
    lex = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    dense = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("score")).where("score > 700")
    return retrieval.rrf(lex, dense).select("id", *[F.round(c, 9).alias(c) for c in ("lex", "dense", "score")])


_RUN = """res AS (SELECT 'q' || (doc_id % 7) AS query_id, doc_id AS doc, row_number() OVER (PARTITION BY doc_id % 7 ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
q AS (SELECT 'q' || (doc_id % 7) AS query_id, doc_id AS doc, quality * 2 + (1 - toxic) AS gain FROM labels),
j AS (SELECT r.query_id, r.doc, r.rank, coalesce(gain, 0) AS gain FROM res r LEFT JOIN q ON r.query_id = q.query_id AND r.doc = q.doc),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS ideal FROM j WHERE rank <= 10),
p AS (SELECT query_id, sum((2.0 ** gain - 1) / log2(rank + 1)) AS dcg, sum((2.0 ** gain - 1) / log2(ideal + 1)) AS idcg, min(CASE WHEN gain >= 1 THEN rank END) AS first FROM t GROUP BY query_id),
ev AS (SELECT p.query_id, CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END AS ndcg, coalesce(1.0 / first, 0) AS mrr, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END AS hit,
  coalesce((SELECT count(*) FROM j WHERE j.query_id = p.query_id AND rank <= 50 AND gain >= 1) / nullif((SELECT count(*) FROM q WHERE q.query_id = p.query_id AND gain >= 1), 0), 1.0) AS recall FROM p)"""


def _run(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    key = F.concat(F.lit("q"), (F.col("doc_id") % 7).cast("string")).alias("query_id")
    res = table(spark, d, "documents").select(key, "doc_id", "n_chars").select("query_id", F.col("doc_id").alias("doc"), F.row_number().over(w).alias("rank"))
    qrels = table(spark, d, "labels").select(key, F.col("doc_id").alias("doc"), (F.col("quality") * 2 + 1 - F.col("toxic")).alias("gain"))
    return retrieval.evaluate(res, qrels)


@_query("ev_per_query", f"WITH {_RUN} SELECT query_id, round(ndcg, 6) AS ndcg, round(mrr::DOUBLE, 6) AS mrr, hit::DOUBLE AS hit, round(recall::DOUBLE, 6) AS recall FROM ev")
def _(spark, d):
    return _run(spark, d).select("query_id", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "hit", "recall")])


@_query("ev_means", f"WITH {_RUN} SELECT count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr::DOUBLE), 6) AS mrr, round(avg(hit::DOUBLE), 6) AS hit, round(avg(recall::DOUBLE), 6) AS recall FROM ev")
def _(spark, d):
    return retrieval.means(_run(spark, d)).select("queries", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "hit", "recall")])


# -- graph ----------------------------------------------------------------------------------------

_NODES = "SELECT p_partkey AS id FROM part"
_RAW = "SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem"
_EDGES = f"SELECT DISTINCT src, dst FROM ({_RAW}) WHERE dst IS NOT NULL AND src <> dst"


def _graph(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    raw = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst IS NOT NULL")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")), raw


@_query("gr_edges", f"SELECT count(*) AS given, count(*) FILTER (WHERE src = dst) AS self_loops, (SELECT count(*) FROM ({_EDGES})) AS kept, count(*) - count(*) FILTER (WHERE src = dst) - (SELECT count(*) FROM ({_EDGES})) AS duplicates FROM ({_RAW}) WHERE dst IS NOT NULL")
def _(spark, d):
    return graph.edge_counts(_graph(spark, d)[1])


@_query("gr_degree", f"SELECT id, count(dst) AS out_degree FROM ({_NODES}) LEFT JOIN ({_EDGES}) ON id = src GROUP BY id")
def _(spark, d):
    nodes, raw = _graph(spark, d)
    return graph.out_degrees(nodes, graph.clean_edges(raw))


@_query("gr_pagerank", graph.pagerank_sql(_NODES, _EDGES, 10))
def _(spark, d):
    nodes, raw = _graph(spark, d)
    return graph.pagerank(nodes, graph.clean_edges(raw))[0].select("id", F.round("r", 9).alias("rank"))


@_query("gr_ppr", graph.pagerank_sql(_NODES, _EDGES, 6, [1, 2, 3]))
def _(spark, d):
    nodes, raw = _graph(spark, d)
    return graph.pagerank(nodes, graph.clean_edges(raw), seeds=[1, 2, 3], iterations=6)[0].select("id", F.round("r", 9).alias("rank"))


# -- ranking and federation -----------------------------------------------------------------------

_SIGNALS = """sig AS (SELECT p_partkey, 'https://hub.example/org/part' || p_partkey AS repo_url, CAST(sum(l_quantity) AS BIGINT) AS stars, count(l_orderkey) AS forks, count(DISTINCT l_suppkey) AS dependents_count,
  date_diff('day', CAST(max(l_shipdate) AS DATE), DATE '2000-01-01') AS last_push_days_ago, p_size % 10 = 0 AS archived, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size / 3.0::DOUBLE END AS release_cadence,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 1.0::DOUBLE END AS issue_response_days, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 5.0::DOUBLE END AS openssf_score, p_size % 6 AS awesome, p_size * 2 AS hn, p_size % 2 = 0 AS lic, p_size % 7 = 0 AS tests
  FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_size)"""


def _signals(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("forks"), F.countDistinct("l_suppkey").alias("deps"), F.max("l_shipdate").alias("last"))
    p = table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left")
    size = F.col("p_size")
    return p.select(
        "p_partkey", F.concat(F.lit("https://hub.example/org/part"), F.col("p_partkey").cast("string")).alias("repo_url"), F.col("q").cast("long").alias("stars"), F.coalesce("forks", F.lit(0)).alias("forks"), F.coalesce("deps", F.lit(0)).alias("dependents_count"),
        F.datediff(F.lit("2000-01-01").cast("date"), F.col("last").cast("date")).alias("last_push_days_ago"), (size % 10 == 0).alias("archived"), F.when(size % 4 != 0, size / F.lit(3.0)).alias("release_cadence"),
        F.when(size % 5 != 0, size.cast("double")).alias("issue_response_days"), F.when(size % 3 != 0, size / F.lit(5.0)).alias("openssf_score"), (size % 6).alias("awesome_list_memberships"), (size * 2).alias("hn_mentions"),
        (size % 2 == 0).alias("license_present"), (size % 7 == 0).alias("has_tests_heuristic"), F.lit(None).cast("double").alias("centrality"),
    )


def _sat(v: str, cap: int) -> str:
    return f"CASE WHEN coalesce({v}, 0) <= 0 THEN 0.0 ELSE least(1.0, ln(1 + {v}) / ln(1 + {cap}.0)) END"


_SCORE = f"""WITH {_SIGNALS}, c AS (SELECT repo_url, last_push_days_ago AS days, archived, 0.20::DOUBLE * {_sat('dependents_count', 10000)} AS c_dependents, 0.15::DOUBLE * (0.7 * {_sat('stars', 30000)} + 0.3 * {_sat('forks', 5000)}) AS c_popularity,
  0.15::DOUBLE * (0.4 * CASE WHEN last_push_days_ago IS NULL THEN 0.5 ELSE 1 - greatest(0, least(1, last_push_days_ago / 730.0)) END + 0.3 * CASE WHEN release_cadence IS NULL THEN 0.5 ELSE least(1, release_cadence / 12) END + 0.3 * CASE WHEN issue_response_days IS NULL THEN 0.5 ELSE 1 - least(1, issue_response_days / 30) END) AS c_maintenance,
  0.10::DOUBLE * (0.5 * CASE WHEN openssf_score IS NULL THEN 0.5 ELSE least(1, openssf_score / 10) END + CASE WHEN lic THEN 0.25 ELSE 0 END + CASE WHEN tests THEN 0.25 ELSE 0 END) AS c_quality, 0.05::DOUBLE * least(1, awesome / 3.0) AS c_awesome_list, 0.05::DOUBLE * {_sat('hn', 50)} AS c_hn_mentions FROM sig),
s AS (SELECT *, c_dependents + c_popularity + c_maintenance + c_quality + c_awesome_list + c_hn_mentions AS base, CASE WHEN archived THEN 0.25 ELSE 1.0 END * CASE WHEN days > 730 THEN 0.5 ELSE 1.0 END AS gate FROM c)"""


@_query("rk_score", f"{_SCORE} SELECT repo_url, " + ", ".join(f"round(c_{k}, 6) AS c_{k}" for k in ("dependents", "popularity", "maintenance", "quality", "awesome_list", "hn_mentions")) + ", round(base * (gate - 1), 6) AS c_maintenance_gate, round(base * gate, 6) AS score FROM s")
def _(spark, d):
    out = rank.score(_signals(spark, d))
    return out.select("repo_url", *[F.round(f"c_{k}", 6).alias(f"c_{k}") for k in ("dependents", "popularity", "maintenance", "quality", "awesome_list", "hn_mentions", "maintenance_gate")], F.round("score", 6).alias("score"))


@_query("rk_topk", f"{_SCORE} SELECT repo_url, round(base * gate, 6) AS score FROM s JOIN sig USING (repo_url) WHERE coalesce(stars, 0) >= 100 ORDER BY base * gate DESC, repo_url LIMIT 10")
def _(spark, d):
    return rank.rank(_signals(spark, d), min_stars=100).select("repo_url", F.round("score", 6).alias("score"))


@_query("rk_merge", f"""WITH {_SIGNALS}, seeds AS (SELECT p_partkey AS seq, 'HTTPS://Hub.example/org/part' || (p_partkey % 50) || CASE WHEN p_partkey % 2 = 0 THEN '.git' ELSE '/' END AS u, (['github', 'npm', 'awesome'])[CAST(p_partkey % 3 + 1 AS INT)] AS source, sig.* EXCLUDE (p_partkey, repo_url) FROM sig), src AS (SELECT k, string_agg(source, ',' ORDER BY f) AS sources FROM (SELECT seq % 50 AS k, source, min(seq) AS f FROM seeds GROUP BY 1, 2) GROUP BY k)
SELECT 'https://hub.example/org/part' || (seq % 50) AS repo_url, min(seq) AS seq, max(stars) AS stars, max(forks) AS forks, min(last_push_days_ago) AS last_push_days_ago, round(arg_min(release_cadence, seq) FILTER (WHERE release_cadence IS NOT NULL), 6) AS release_cadence, bool_or(archived) AS archived, any_value(src.sources) AS sources
FROM seeds JOIN src ON seq % 50 = k GROUP BY seq % 50""")
def _(spark, d):
    k = F.col("p_partkey")
    url = F.concat(F.lit("HTTPS://Hub.example/org/part"), (k % 50).cast("string"), F.when(k % 2 == 0, ".git").otherwise("/"))
    source = F.element_at(F.array(*map(F.lit, ["github", "npm", "awesome"])), (k % 3 + 1).cast("int"))
    seeds = _signals(spark, d).withColumn("repo_url", url).withColumn("source", source).withColumnRenamed("p_partkey", "seq")
    out = rank.merge_candidates(seeds)
    return out.select("repo_url", "seq", "stars", "forks", "last_push_days_ago", F.round("release_cadence", 6).alias("release_cadence"), "archived", F.array_join("sources", ",").alias("sources"))


@_query("jn_federate", """WITH a AS (SELECT s_name AS repo, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS stars FROM supplier), b AS (SELECT 'SUPPLIER#' || right(c_name, 9) AS repo, c_acctbal AS stars FROM customer)
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.stars, b.stars) AS stars, concat_ws(',', CASE WHEN a.repo IS NOT NULL THEN 'local' END, CASE WHEN b.repo IS NOT NULL THEN 'remote' END) AS sources FROM a FULL JOIN b ON lower(a.repo) = lower(b.repo)""")
def _(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    a = s.select(F.col("s_name").alias("repo"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("stars"), F.array(F.lit("local")).alias("sources"))
    b = c.select(F.concat(F.lit("SUPPLIER#"), F.right("c_name", F.lit(9))).alias("repo"), F.col("c_acctbal").alias("stars"), F.array(F.lit("remote")).alias("sources"))
    return rank.federate(a, b).withColumn("sources", F.array_join("sources", ","))


_RESP = "r AS (SELECT event_type AS backend, event_id AS probe, CASE WHEN value < 5 THEN 'unavailable' WHEN value < 20 THEN 'degraded' ELSE 'ok' END AS status, 'reason ' || event_id AS reason FROM events)"


@_query("ag_status", f"WITH {_RESP}, g AS (SELECT backend, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'unavailable') AS unavailable, count(*) FILTER (WHERE status = 'degraded') AS degraded, count(*) AS total, arg_min(reason, probe) FILTER (WHERE status <> 'ok') AS first_reason FROM r GROUP BY backend) SELECT *, CASE WHEN unavailable = total THEN 'error' WHEN unavailable = 0 AND degraded = 0 THEN 'ok' ELSE 'degraded' END AS state FROM g")
def _(spark, d):
    status = F.when(F.col("value") < 5, "unavailable").when(F.col("value") < 20, "degraded").otherwise("ok")
    return rank.backend_status(table(spark, d, "events").select(F.col("event_type").alias("backend"), F.col("event_id").alias("probe"), status.alias("status"), F.concat(F.lit("reason "), F.col("event_id").cast("string")).alias("reason")))


@_query("ag_latency", "SELECT event_type AS backend, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def _(spark, d):
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("backend")).agg(p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"))


# -- backends, repositories, semantic search ------------------------------------------------------


@_query("src_capabilities", "SELECT * FROM (VALUES ('grep.app'), ('sourcegraph')) t(backend)")
def _(spark, d):
    return backends.legs(spark, regex=True, filters=("language", "path"))


@_query("src_repo_query", """SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_partkey % 3 > 0 THEN 'language:' || CASE WHEN contains(p_type, ' ') THEN '"' || p_type || '"' ELSE p_type END END, CASE WHEN p_size % 5 > 0 THEN 'stars:>=' || (p_size % 5) END) AS q FROM part""")
def _(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", backends.repo_query(F.col("p_name"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")), F.col("p_size") % 5, F.lit(None).cast("string")).alias("q"))


_REPOS = "(SELECT 'org/' || s_name AS repo, 'tool for ' || n_name AS what, 'none' AS catch, [r_name, 'cli'] AS topics, CASE WHEN s_suppkey % 2 = 0 THEN 'Rust' ELSE 'Go' END AS language, CAST(s_suppkey * 7 AS BIGINT) AS stars FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@_query("flt_match_repos", f"SELECT repo, stars FROM {_REPOS} WHERE (contains(lower(concat_ws(' ', repo, what, catch, array_to_string(topics, ' '))), 'asia') OR contains(lower(what), 'france')) AND language = 'Rust' AND stars >= 50 AND len(list_filter(topics, lambda t: lower(t) = 'cli')) > 0")
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    repos = s.select(F.concat(F.lit("org/"), "s_name").alias("repo"), F.concat(F.lit("tool for "), "n_name").alias("what"), F.lit("none").alias("catch"), F.array("r_name", F.lit("cli")).alias("topics"), F.when(F.col("s_suppkey") % 2 == 0, "Rust").otherwise("Go").alias("language"), (F.col("s_suppkey") * 7).alias("stars"))
    return search.match_repos(repos, "Asia; FRANCE", topic="CLI", language="rust", min_stars=50).select("repo", "stars")


@_query("prj_fields", "SELECT 'org/part' || p_partkey AS repo, CAST(p_size * 300 AS BIGINT) AS stars, CASE WHEN p_size * 300 >= 10000 THEN 'high' WHEN p_size * 300 >= 500 THEN 'medium' ELSE 'low' END AS star_tier, 'https://github.com/org/part' || p_partkey AS url, 'stars,urls' AS fields_returned FROM part")
def _(spark, d):
    repos = table(spark, d, "part").select(F.concat(F.lit("org/part"), F.col("p_partkey").cast("string")).alias("repo"), (F.col("p_size") * 300).cast("long").alias("stars"), F.lit("MIT").alias("license"), F.lit(3).alias("days_since_activity"), F.lit("w").alias("what"))
    return search.pick_fields(search.repo_rows(repos), ["stars", "urls"]).withColumn("fields_returned", F.array_join("fields_returned", ","))


@_query("hy_hybrid")
def _(spark, d):
    docs = _docs(spark, d)
    return semantic.hybrid_search(docs, semantic.index_source(docs), "the thtion of erentan", PROBE).select("id", F.round("score", 9).alias("score"))


from quarry.plans import catalog_domain, catalog_sources  # noqa: E402, F401 - they register their queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
