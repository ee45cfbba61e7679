"""Further queries over search, stores, deduplication, licenses, chunks, vectors, ranking and evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import dedup, graph, rank, retrieval, search, semantic
from quarry.plans import catalog, tools
from quarry.plans.catalog_sources import AS_OF, work_folder
from quarry.plans.language import Query as TextQuery
from quarry.plans.registry import SQL, query
from quarry.sources import tables
from quarry.sources.tables import docs_view, table

DOCS, LINES, LANG, PROBE = catalog.DOCS, catalog.LINES, catalog.LANG, catalog.PROBE


def _docs(spark, d):
    return docs_view(table(spark, d, "documents"))


def _pick(values, n):
    """One of some literals, by a key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


# -- filters and projections ----------------------------------------------------------------------

_GATE = """g AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN repeat('x', CASE WHEN p_size > 25 THEN 1048577 ELSE 9 END) WHEN 1 THEN p_name || chr(0) WHEN 2 THEN p_name ELSE NULL END AS t, p_partkey % 4 = 3 AS random FROM part)"""


@query("flt_gate", f"WITH {_GATE} SELECT id, CASE WHEN random THEN 'high_entropy' WHEN strlen(t) > 1048576 THEN 'too_large' WHEN contains(t, chr(0)) THEN 'binary_nul' END AS reason FROM g")
def _(spark, d):
    """Of each four rows: a text that may be too large, one with a NUL byte, a plain one, and bytes in which all but NUL are equally frequent."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 4
    even = F.lit(bytes(range(1, 256)))
    text = F.when(n == 0, F.repeat(F.lit("x"), F.when(F.col("p_size") > 25, 1048577).otherwise(9))).when(n == 1, F.concat("p_name", F.lit("\0"))).otherwise(F.col("p_name"))
    keys = table(spark, d, "part").select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # a small file that becomes a thousand times as large
    rows = keys.select(k.alias("id"), F.when(n == 3, even).otherwise(text.cast("binary")).alias("content"))
    return search.gate(rows).select("id", "reason")


@query("flt_path_under", f"WITH {DOCS} SELECT doc_id FROM docs WHERE path = 'src' OR path LIKE 'src/%'")
def _(spark, d):
    return _docs(spark, d).where(retrieval.path_under(F.col("path"), "src")).select("doc_id")


@query("prj_concise", "SELECT 'org/part' || p_partkey AS repo, CAST(p_size * 300 AS BIGINT) AS stars, CASE WHEN p_size * 300 >= 10000 THEN 'high' WHEN p_size * 300 >= 500 THEN 'medium' ELSE 'low' END AS star_tier, 'MIT' AS license, 'permissive' AS license_class, 'active' AS activity, 'w' AS what, 'https://github.com/org/part' || p_partkey AS url FROM part")
def _(spark, d):
    repos = table(spark, d, "part").select(F.concat(F.lit("org/part"), F.col("p_partkey").cast("string")).alias("repo"), (F.col("p_size") * 300).cast("long").alias("stars"), F.lit("MIT").alias("license"), F.lit(3).alias("days_since_activity"), F.lit("w").alias("what"), F.lit("c").alias("catch"))
    return search.concise(search.repo_rows(repos), "search_repos")


@query("prj_concise_tree", f"WITH {DOCS} SELECT path, CAST(strlen(content) AS BIGINT) AS size FROM docs")
def _(spark, d):
    rows = _docs(spark, d).select("path", F.octet_length("content").cast("long").alias("size"), F.lit("blob").alias("mode"))
    return search.concise(rows, "repo_tree")


@query("sc_lines", r"""SELECT conv_id, turn, left(coalesce(list_filter(list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1], ''), 200) AS first_line, left(array_to_string(list_filter(list_transform(string_split_regex(t, '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1:6], ' '), 400) AS digest
FROM (SELECT conv_id, turn, chr(10) || ' ' || chr(10) || text || chr(10) || role || chr(13) || chr(10) || text AS t FROM conversations)""")
def _(spark, d):
    text = F.concat(F.lit("\n \n"), "text", F.lit("\n"), "role", F.lit("\r\n"), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", S.first_line(text).alias("first_line"), S.readme_digest(text).alias("digest"))


@query("sc_split_repo", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'org' END AS owner, CASE WHEN p_partkey % 3 = 0 THEN 'part' || p_partkey END AS name FROM part")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("org/part"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("org/a/"), k)).otherwise(k)
    return table(spark, d, "part").select("p_partkey", S.split_repo(text).alias("x")).select("p_partkey", "x.owner", "x.name")


@query("sc_clean_rows", """SELECT conv_id, turn, CASE WHEN length(c) > 500 THEN left(c, 500) || '…[+' || (length(c) - 500) || ' chars truncated]' ELSE c END || '|' || role || '<U+202E>' AS cleaned
FROM (SELECT conv_id, turn, role, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g') AS c FROM conversations)""".replace("\\\\", "\\"))
def _(spark, d):
    """Rows with nested values, sanitised as a tool's answer is."""

    def run(frames):
        for f in frames:
            values = [tools.clean({"text": t.replace("\n", "").replace("\t", ""), "tags": ["\x1b[1m" + r + "\u202e"]}) for t, r in zip(f["text"], f["role"], strict=True)]
            yield pd.DataFrame({"conv_id": f["conv_id"], "turn": f["turn"], "cleaned": [v["text"] + "|" + v["tags"][0] for v in values]})

    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text").mapInPandas(run, "conv_id long, turn long, cleaned string")


# -- search and stores ----------------------------------------------------------------------------


def _opened(spark, d):
    at = work_folder(spark, "index")
    search.save_index(_docs(spark, d), at)
    return search.Index(spark, at)


@query("txt_index_search", SQL.get("txt_scored_topk"))
def _(spark, d):
    """Stored, opened, planned by trigrams in every case, verified and scored."""
    return search.top(_opened(spark, d).search(TextQuery(PROBE))).select("repo", "path", "matched_lines", "whole_word", "test_path", "density", "score")


@query("txt_index_regex", f"WITH {DOCS}, {LINES} SELECT repo, path, count(*) AS matched_lines FROM lines WHERE regexp_matches(line, '(Th|th)tion [a-z]+(ing|ed)') GROUP BY repo, path")
def _(spark, d):
    return _opened(spark, d).search(TextQuery("(Th|th)tion [a-z]+(ing|ed)", kind="regex", case="sensitive")).select("repo", "path", "matched_lines")


@query("txt_snapshot", f"WITH {DOCS} SELECT repo, count(*) AS files, min(path) AS first_path, max(path) AS last_path FROM docs WHERE strlen(content) <= 1048576 GROUP BY repo")
def _(spark, d):
    return _opened(spark, d).repos()


@query("txt_case_variants", f"WITH {DOCS} SELECT doc_id FROM docs WHERE contains(lower(content), 'tht') AND contains(lower(content), 'hti') AND contains(lower(content), 'tio') AND contains(lower(content), 'ion')")
def _(spark, d):
    return search.planned_candidates(search.trigrams(_docs(spark, d)), search.gram_plan(TextQuery(PROBE)))


@query("txt_find_repo", "SELECT 'org/src7' AS repo")
def _(spark, d):
    return search.find_repo(_docs(spark, d), "ORG/SRC7")


@query("jn_packs", "SELECT count(*) AS blobs, TRUE AS smaller FROM (SELECT DISTINCT text FROM documents)")
def _(spark, d):
    """Blobs joined to the files that hold them; compressed, they take less room than raw."""
    at = work_folder(spark, "blobs")
    blobs = tables.blobs(_docs(spark, d))
    tables.put(blobs, at)
    raw = blobs.agg(F.sum("raw_len").alias("raw"))
    files = dedup.stored_blobs(spark, at).agg(F.sum("blobs").alias("blobs"), F.sum("stored").alias("stored"))
    return files.join(raw).select("blobs", (F.col("stored") < F.col("raw")).alias("smaller"))


@query("cas_get", "SELECT DISTINCT sha256(text) AS hash, TRUE AS intact FROM documents WHERE lang = 'de'")
def _(spark, d):
    at = work_folder(spark, "blobs")
    tables.put(tables.blobs(_docs(spark, d)), at)
    wanted = table(spark, d, "documents").where("lang = 'de'").select(tables.content_hash("text").alias("hash"))
    return tables.get(spark, at, wanted).select("hash", "intact")


@query("ch_store", "SELECT 'c' || (doc_id % 40) AS id, max(doc_id) AS start_line, 'p:' || max(doc_id) AS locator FROM documents GROUP BY doc_id % 40 UNION ALL SELECT 'missing', NULL, NULL")
def _(spark, d):
    """Chunks are put one after the other under 40 ids; hits on them, and one on none, are resolved."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("c"), (F.col("doc_id") % 40).cast("string")).alias("id"), F.lit("r").alias("repo"), F.lit("p").alias("path"), F.col("doc_id").alias("start_line"))
    newest = docs.groupBy("id", "repo", "path").agg(F.max("start_line").alias("start_line"))
    older = docs.groupBy("id", "repo", "path").agg(F.min("start_line").alias("start_line"))
    store = semantic.put_chunks(semantic.put_chunks(None, older), newest)
    hits = newest.select("id", F.lit(1.0).alias("score")).union(spark.createDataFrame([("missing", 0.5)], "id string, score double"))
    return semantic.resolve(hits, store).join(semantic.get_chunks(store, hits).select("id", "start_line"), "id").select("id", "start_line", "locator")


@query("ch_by_path", f"WITH {DOCS} SELECT CAST(count(*) AS BIGINT) AS n FROM docs WHERE doc_id = 7")
def _(spark, d):
    docs = _docs(spark, d)
    at = docs.where("doc_id = 7").select("repo", "path").first()
    return semantic.chunks_by_path(semantic.put_chunks(None, semantic.chunks(docs.where("doc_id = 7"))), at.repo, at.path).agg(F.countDistinct("path").alias("n"))


@query("ve_store", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def _(spark, d):
    at = work_folder(spark, "vectors")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    retrieval.save_vectors(rows, at)
    dim = len(rows.first().embedding)
    return retrieval.open_vectors(spark, at, dim).select("id", F.round("norm", 5).alias("norm"))


# -- deduplication and corpus reports -------------------------------------------------------------

_INGEST = catalog._VERDICTS.replace(catalog.DOCS, "raw AS (SELECT *, doc_id % 40 = 0 AS nul FROM (SELECT * FROM d0)), docs AS (SELECT * FROM raw WHERE NOT nul)", 1)
_INGEST = "WITH " + catalog.DOCS.replace("docs AS", "d0 AS", 1) + ", " + _INGEST.removeprefix("WITH ")


def _with_nul(spark, d):
    return _docs(spark, d).withColumn("content", F.when(F.col("doc_id") % 40 == 0, F.concat("content", F.lit("\0"))).otherwise(F.col("content"))).withColumn("content", F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("\0"), "content")).otherwise(F.col("content")))


@query("ag_ingest", f"""{_INGEST} SELECT raw.repo, count(*) AS seen, count(*) FILTER (WHERE NOT nul) AS accepted, CAST(0 AS BIGINT) AS too_large, count(*) FILTER (WHERE nul) AS binary_nul, CAST(0 AS BIGINT) AS high_entropy, count(*) FILTER (WHERE kind = 'exact') AS exact, count(*) FILTER (WHERE kind = 'token') AS token,
  count(*) FILTER (WHERE kind = 'near') AS near, count(*) FILTER (WHERE kind = 'unique') AS "unique", CAST(coalesce(sum(CASE WHEN kind <> 'exact' THEN strlen(content) END), 0) AS BIGINT) AS new_bytes FROM raw LEFT JOIN v ON raw.doc_id = v.seq GROUP BY raw.repo""")
def _(spark, d):
    return dedup.repo_reports(_with_nul(spark, d))


@query("ag_rejections", """SELECT CASE WHEN doc_id % 40 = 0 THEN 'binary_nul' ELSE 'accepted' END AS outcome, source AS ecosystem, count(*) AS files, CAST(sum(strlen(text) + CASE WHEN doc_id % 40 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2
UNION ALL SELECT CASE WHEN doc_id % 40 = 0 THEN 'binary_nul' ELSE 'accepted' END, 'total', count(*), CAST(sum(strlen(text) + CASE WHEN doc_id % 40 = 0 THEN 2 ELSE 0 END) AS BIGINT) FROM documents GROUP BY 1
UNION ALL SELECT 'total', 'total', count(*), CAST(sum(strlen(text) + CASE WHEN doc_id % 40 = 0 THEN 2 ELSE 0 END) AS BIGINT) FROM documents""")
def _(spark, d):
    rows = search.gate(_with_nul(spark, d)).select(F.coalesce("reason", F.lit("accepted")).alias("outcome"), F.substring_index("repo", "/", -1).alias("ecosystem"), F.octet_length("content").alias("b"))
    out = rows.rollup("outcome", "ecosystem").agg(F.count("*").alias("files"), F.sum("b").alias("bytes"))
    return out.fillna("total", ["outcome", "ecosystem"])


@query("set_dice", """SELECT a.p_partkey, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END::DOUBLE, 6) AS dice FROM
  (SELECT p_partkey, list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS x, list_distinct(list_transform(range(1, length(p_type) - 1), lambda i: substr(p_type, i, 3))) AS y FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'ab' ELSE lower(p_name) END AS p_name, CASE WHEN p_partkey % 20 = 0 THEN '' ELSE lower(p_name || p_type) END AS p_type FROM part)) a""")
def _(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.when(k % 10 == 0, "ab").otherwise(F.lower("p_name")).alias("a"), F.when(k % 20 == 0, "").otherwise(F.lower(F.concat("p_name", "p_type"))).alias("b"))
    return rows.select("p_partkey", F.round(dedup.dice(dedup.char_trigrams(F.col("a")), dedup.char_trigrams(F.col("b"))), 6).alias("dice"))


@query("dd_estimate", "SELECT doc_id, TRUE AS near, TRUE AS same FROM documents WHERE len(list_filter(string_split_regex(text, '[^A-Za-z0-9]+'), lambda t: t <> '')) >= 60")
def _(spark, d):
    """Each text against itself without its last tokens: the estimate is near the exact similarity, and 1 for equal texts."""
    rows = dedup.prefix_estimates(_docs(spark, d), cut=15, least=60)
    return rows.select(F.col("seq").alias("doc_id"), (F.abs(F.col("estimate") - F.col("exact")) < 0.3).alias("near"), (F.col("same") == 1.0).alias("same"))


# -- licenses -------------------------------------------------------------------------------------

_BODY = "permission is granted to use and copy this software for the purposes of "
_KNOWN = f"known AS (SELECT r_regionkey AS idx, 'L-' || r_name AS spdx, 'License ' || r_name || chr(10) || repeat('{_BODY}' || r_name || ' ', 4) AS text FROM region)"
_NORM = r"trim(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: lower(trim(x))), lambda x: NOT starts_with(x, '<<') AND NOT ends_with(x, '>>') AND NOT starts_with(x, 'copyright')), ' '), '\s+', ' ', 'g'))"
_GRAMS = "CASE WHEN length({0}) < 3 THEN [] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"
_DICE = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
_ASKED = f"asked AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'short' ELSE '<<beginOptional>>' || chr(10) || 'Copyright ' || n_name || chr(10) || text || repeat(' and further terms of ' || n_name, n_nationkey % 5 * 2) END AS text FROM nation JOIN known ON n_regionkey = idx)"
_MATCHED = f"""{_KNOWN}, {_ASKED}, ln AS (SELECT idx, spdx, {_NORM} AS f FROM known), an AS (SELECT id, {_NORM} AS f FROM asked),
lg AS (SELECT idx, spdx, f, {_GRAMS.format('f')} AS g, {_GRAMS.format('left(f, 200)')} AS p FROM ln), ag AS (SELECT id, f, {_GRAMS.format('f')} AS g, {_GRAMS.format('left(f, 200)')} AS p FROM an WHERE strlen(f) >= 64),
sc AS (SELECT id, spdx, idx, CASE WHEN a.f = l.f THEN 1.0 ELSE greatest({_DICE.format('a.g', 'l.g')}, {_DICE.format('a.p', 'l.p')}) END::DOUBLE AS score, {_DICE.format('a.g', 'l.g')}::DOUBLE AS whole FROM ag a, lg l),
best AS (SELECT id, arg_max(spdx, (score, whole, -idx)) AS spdx, max(score) AS score FROM sc WHERE score >= 0.8 GROUP BY id)"""


def _licenses(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    known = r.select(F.col("r_regionkey").alias("idx"), F.concat(F.lit("L-"), "r_name").alias("spdx"), F.concat(F.lit("License "), "r_name", F.lit("\n"), F.repeat(F.concat(F.lit(_BODY), "r_name", F.lit(" ")), F.lit(4))).alias("text"))
    k = F.col("n_nationkey")
    text = F.concat(F.lit("<<beginOptional>>\nCopyright "), "n_name", F.lit("\n"), "text", F.repeat(F.concat(F.lit(" and further terms of "), "n_name"), (k % 5 * 2).cast("int")))
    asked = n.join(known, n.n_regionkey == known.idx).select(k.alias("id"), "n_name", F.when(k % 5 == 4, "short").otherwise(text).alias("text"))
    return known, asked


@query("li_match", f"WITH {_MATCHED} SELECT asked.id, spdx, round(score, 6) AS score FROM asked LEFT JOIN best USING (id)")
def _(spark, d):
    known, asked = _licenses(spark, d)
    return dedup.match_licenses(asked.select("id", "text"), known).withColumn("score", F.round("score", 6))


@query("li_repo", f"""WITH {_MATCHED}, files AS (SELECT 'org/' || (id % 6) AS repo, (['LICENSE', 'COPYING.txt', 'notice-' || id, 'docs/LICENSE', 'README.md', 'licence_' || id])[CAST(id // 6 % 6 + 1 AS INT)] AS path, id FROM asked),
pr AS (SELECT repo, path, spdx, CASE lower(regexp_extract(path, '^[^.\\-_]*')) WHEN 'license' THEN 0 WHEN 'licence' THEN 0 WHEN 'copying' THEN 1 WHEN 'copyright' THEN 2 WHEN 'notice' THEN 3 END AS prio FROM files JOIN best USING (id) WHERE NOT contains(path, '/'))
SELECT repo, arg_min(spdx, (prio, path)) AS spdx FROM pr WHERE prio IS NOT NULL GROUP BY repo""")
def _(spark, d):
    known, asked = _licenses(spark, d)
    k = F.col("id").cast("string")
    name = F.element_at(F.array(F.lit("LICENSE"), F.lit("COPYING.txt"), F.concat(F.lit("notice-"), k), F.lit("docs/LICENSE"), F.lit("README.md"), F.concat(F.lit("licence_"), k)), (F.floor(F.col("id") / 6) % 6 + 1).cast("int"))
    return dedup.repo_licenses(asked.select(F.concat(F.lit("org/"), (F.col("id") % 6).cast("string")).alias("repo"), name.alias("path"), F.col("text").alias("content")), known)


@query("li_normalize", f"WITH {_KNOWN}, {_ASKED} SELECT id, {_NORM} AS normalized FROM asked")
def _(spark, d):
    return _licenses(spark, d)[1].select("id", dedup.normalize_license(F.col("text")).alias("normalized"))


@query("li_priority", "SELECT p_partkey, (CAST(['0', '0', '1', '2', '3', NULL] AS INT[]))[CAST(p_partkey % 6 + 1 AS INT)] AS prio FROM part")
def _(spark, d):
    names = ["LICENSE", "Licence-MIT.md", "COPYING.LESSER", "copyright_notice", "NOTICE", "LICENSES.txt"]
    return table(spark, d, "part").select("p_partkey", dedup.license_file_priority(_pick(names, F.col("p_partkey"))).alias("prio"))


@query("li_spdx", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'MIT OR Apache-2.0' WHEN 2 THEN 'BSD-3-Clause' END AS tag FROM part")
def _(spark, d):
    heads = ["// SPDX-License-Identifier: Apache-2.0\n// SPDX-License-Identifier: MIT\n", "/* SPDX-License-Identifier: MIT OR Apache-2.0 */\n", "#  SPDX-License-Identifier:BSD-3-Clause  \r\n", "# SPDX-License-Identifier: M!T\n", "no tag\n"]
    return table(spark, d, "part").select("p_partkey", S.spdx_tag(F.concat(_pick(heads, F.col("p_partkey")), "p_name")).alias("tag"))


# -- chunks, embeddings, vectors ------------------------------------------------------------------


@query("ch_items", """SELECT p_partkey AS id, kind, symbol, CAST(s AS BIGINT) AS start_line, CAST(e AS BIGINT) AS end_line FROM part JOIN (VALUES
 (0, 'function', 'f', 2, 4), (0, 'class', 'C', 5, 7), (0, 'method', 'C.m', 6, 7), (1, 'function', 'go', 1, 4), (1, 'class', 'S', 5, 5), (2, 'function', 'Run', 2, 5), (2, 'class', 'T', 6, 8), (3, 'function', 'load', 1, 3), (3, 'class', 'View', 4, 6)) t(m, kind, symbol, s, e) ON p_partkey % 5 = m
UNION ALL SELECT p_partkey, 'window', NULL, 1, 2 FROM part WHERE p_partkey % 5 = 4""")
def _(spark, d):
    sources = [
        "import x\n# about f\n@wrap\ndef f(): pass\nclass C:\n    def m(self):\n        return 1\n",
        "/// about go\n#[inline]\npub fn go() {\n    a(\"}\"); }\nstruct S;\n",
        "package p\n// Run it\nfunc (t *T) Run() {\n  x() // }\n}\ntype T struct {\n  a int\n}\n",
        "export async function load() {\n  return `x`\n}\nclass View {\n  draw() { }\n}\n",
        "plain\ntext\n",
    ]
    k = F.col("p_partkey")
    path = F.concat(F.lit("f"), k.cast("string"), F.lit("."), _pick(["py", "rs", "go", "js", "txt"], k))
    found = semantic.chunks(table(spark, d, "part").select(F.lit("r").alias("repo"), path.alias("path"), _pick(sources, k).alias("content")))
    return found.select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("id"), "kind", "symbol", "start_line", "end_line")


def _fnv(words: str) -> str:
    """CTEs ``tok`` (word, bucket) of the distinct words of a CTE ``words`` (word): FNV-1a modulo 256."""
    return f"""dw AS (SELECT DISTINCT word FROM {words}), hw AS (SELECT word, hex(encode(word)) AS h FROM dw), tok AS (SELECT word, CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS UHUGEINT))),
  lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) % 256::UHUGEINT AS INT) AS bucket FROM hw)"""


@query("em_embed", f"""WITH w AS (SELECT p_partkey AS id, unnest(regexp_extract_all(p_name || ' ' || p_type, '[\\p{{L}}\\p{{N}}]+')) AS word FROM part), {_fnv('w')}, c AS (SELECT id, bucket, count(*) AS n FROM w JOIN tok USING (word) GROUP BY 1, 2)
SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 5) AS weight FROM c""".replace("\\\\", "\\"))
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), semantic.embed(F.concat("p_name", F.lit(" "), "p_type")).alias("e"))
    return rows.select("id", F.posexplode("e").alias("bucket", "w")).where("w <> 0").select("id", "bucket", F.round(F.col("w").cast("double"), 5).alias("weight"))


ASK = "thtion of the erentan"
_CHUNKS = f"""{DOCS}, {LINES}, ln AS (SELECT repo, path, max(line_no) AS total FROM lines GROUP BY 1, 2), ca AS (SELECT repo, path, total, unnest(range(0, CAST(greatest(ceil((total - 60) / 50), 0) * 50 + 1 AS BIGINT), 50)) AS "at" FROM ln),
ch AS (SELECT ca.repo || '/' || ca.path || ':' || ("at" + 1) || '-' || least("at" + 60, total) AS id, ca.repo, ca.path, "at" + 1 AS start_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ca JOIN lines l ON l.repo = ca.repo AND l.path = ca.path AND line_no > "at" AND line_no <= "at" + 60 GROUP BY ca.repo, ca.path, "at", total)"""
_NEAREST = f"""w AS (SELECT id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS word FROM ch), qw AS (SELECT unnest(string_split('{{ask}}', ' ')) AS word), aw AS (SELECT word FROM w UNION ALL SELECT word FROM qw), {_fnv('aw')},
cv AS (SELECT id, bucket, count(*) AS n FROM w JOIN tok USING (word) GROUP BY 1, 2), qv AS (SELECT bucket, count(*) AS n FROM qw JOIN tok USING (word) GROUP BY 1), cn AS (SELECT id, sqrt(sum(n * n)) AS l FROM cv GROUP BY id),
ds AS (SELECT ch.id, coalesce((SELECT sum(cv.n * qv.n) FROM cv JOIN qv USING (bucket) WHERE cv.id = ch.id) / (cn.l * (SELECT sqrt(sum(n * n)) FROM qv)), 0)::DOUBLE AS score FROM ch LEFT JOIN cn ON ch.id = cn.id)""".replace("\\\\", "\\")


@query("ve_chunk_search", f"WITH {_CHUNKS}, {_NEAREST.replace('{ask}', ASK)} SELECT round(score, 4) AS score FROM ds ORDER BY score DESC LIMIT 10")
def _(spark, d):
    return semantic.search_chunks(semantic.index_source(_docs(spark, d)), ASK, 10).select(F.round("score", 4).alias("score"))


@query("hy_identifier", f"""WITH {_CHUNKS}, {catalog.scored_sql('Thtion')}, cs AS (SELECT repo, path, {catalog.TOTAL} AS score FROM sc), ex AS (SELECT repo, path, count(*) AS n FROM lines WHERE contains(line, 'Thtion') GROUP BY 1, 2)
SELECT count(*) AS found FROM ch JOIN ex USING (repo, path) WHERE contains(text, 'Thtion')""")
def _(spark, d):
    """An identifier skips the dense leg: only chunks of files with the anchor are found."""
    docs = _docs(spark, d)
    depth = 1_000_000  # no cut, so that the count is that of all chunks with the anchor
    return semantic.hybrid_search(docs, semantic.index_source(docs), "Thtion", "Thtion", depth).agg(F.count("*").alias("found"))


# -- ranking, graphs, evaluation ------------------------------------------------------------------


@query("rk_npms", """WITH RECURSIVE a AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_retailprice) AS mean FROM part), x AS (SELECT p_partkey, greatest(0, least(1, (p_retailprice - lo) / (hi - lo))) AS x, greatest(0, least(1, (mean - lo) / (hi - lo))) AS m FROM part, a),
b AS (SELECT p_partkey, x, m, 0.0::DOUBLE AS l, 1.0::DOUBLE AS h, 0 AS i FROM x UNION ALL SELECT p_partkey, x, m, CASE WHEN 3 * m * ((l + h) / 2) * (1 - (l + h) / 2) + ((l + h) / 2) ** 3 < x THEN (l + h) / 2 ELSE l END, CASE WHEN 3 * m * ((l + h) / 2) * (1 - (l + h) / 2) + ((l + h) / 2) ** 3 < x THEN h ELSE (l + h) / 2 END, i + 1 FROM b WHERE i < 64)
SELECT p_partkey, round(2.25 * ((l + h) / 2) * (1 - (l + h) / 2) + ((l + h) / 2) ** 3, 6) AS npms FROM b WHERE i = 64""")
def _(spark, d):
    return rank.npms_scores(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", F.round("npms", 6).alias("npms"))


@query("ag_max_normalized", "SELECT p_partkey, round(p_size / max(p_size) OVER (), 6) AS normalized, 0.0::DOUBLE AS none FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.lit(-1.0).alias("z"))
    out = rank.max_normalised(rank.max_normalised(rows, "v", "n"), "z", "none")
    return out.select("p_partkey", F.round("n", 6).alias("normalized"), "none")


@query("ag_flags", "SELECT bool_or(value < 20) AS partial, bool_or(value > 1000000) AS has_more FROM events")
def _(spark, d):
    return rank.response_flags(table(spark, d, "events").select(F.when(F.col("value") < 20, "degraded").otherwise("ok").alias("status"), (F.col("value") > 1000000).alias("has_more")))


_LIVE = f"""pk AS (SELECT CASE WHEN s_suppkey % 5 > 0 THEN 'Org/' || s_name END AS repo, 'pkg' || s_suppkey AS package, CAST(s_suppkey AS BIGINT) AS stars, CAST(1 AS BIGINT) AS forks, FALSE AS archived, NULL::VARCHAR AS description, '' AS license, 'Go' AS language, 'u' AS url, '1999-12-01' AS pushed_at FROM supplier),
gh AS (SELECT lower('org/Supplier#' || right(c_name, 9)) AS repo, CAST(c_custkey * 90 AS BIGINT) AS stars, CAST(c_custkey AS BIGINT) AS forks, c_nationkey % 9 = 0 AS archived, c_mktsegment AS description, 'MIT' AS license, 'Rust' AS language, 'v' AS url, CASE WHEN c_custkey % 2 = 0 THEN '1999-0' || (c_custkey % 9 + 1) || '-15' END AS pushed_at FROM customer),
me AS (SELECT coalesce(pk.repo, gh.repo) AS repo, package, coalesce(gh.pushed_at, pk.pushed_at) AS pushed_at, coalesce(gh.stars, pk.stars) AS stars, coalesce(gh.forks, pk.forks) AS forks, coalesce(gh.archived, pk.archived) AS archived, coalesce(nullif(pk.description, ''), gh.description) AS description, coalesce(nullif(pk.license, ''), gh.license) AS license, coalesce(pk.language, gh.language) AS language, coalesce(pk.url, gh.url) AS url,
  concat_ws(',', CASE WHEN pk.package IS NOT NULL THEN 'npm' END, CASE WHEN gh.repo IS NOT NULL THEN 'github' END) AS sources FROM pk FULL JOIN gh ON lower(pk.repo) = gh.repo)"""


def _live(spark, d):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    packages = table(spark, d, "supplier").select(
        F.when(k % 5 > 0, F.concat(F.lit("Org/"), "s_name")).alias("repo"), F.concat(F.lit("pkg"), k.cast("string")).alias("package"), k.alias("stars"), F.lit(1).cast("long").alias("forks"), F.lit(False).alias("archived"), F.lit(None).cast("string").alias("description"),
        F.lit("").alias("license"), F.lit("Go").alias("language"), F.lit("u").alias("url"), F.lit("1999-12-01").alias("pushed_at"),
    )
    repos = table(spark, d, "customer").select(
        F.lower(F.concat(F.lit("org/Supplier#"), F.right("c_name", F.lit(9)))).alias("repo"), (c * 90).alias("stars"), c.alias("forks"), (F.col("c_nationkey") % 9 == 0).alias("archived"), F.col("c_mktsegment").alias("description"), F.lit("MIT").alias("license"),
        F.lit("Rust").alias("language"), F.lit("v").alias("url"), F.when(c % 2 == 0, F.concat(F.lit("1999-0"), (c % 9 + 1).cast("string"), F.lit("-15"))).alias("pushed_at"),
    )
    return packages, repos


@query("jn_live", f"WITH {_LIVE} SELECT repo, package, pushed_at, stars, forks, archived, description, license, language, url, sources FROM me")
def _(spark, d):
    return rank.merge_live(*_live(spark, d))


@query("rk_live", f"""WITH {_LIVE}, x AS (SELECT *, date_diff('day', CAST(pushed_at AS DATE), DATE '{AS_OF}') AS days FROM me WHERE repo IS NOT NULL AND lower(language) LIKE '%o%' AND stars >= 20)
SELECT repo, stars, CASE WHEN stars >= 10000 THEN 'high' WHEN stars >= 500 THEN 'medium' ELSE 'low' END AS star_tier, CAST(days AS INT) AS last_push_days_ago, sources FROM x ORDER BY stars DESC, repo LIMIT 10 OFFSET 2""")
def _(spark, d):
    out = rank.live_search(*_live(spark, d), F.lit(AS_OF).cast("date"), by="stars", language="O", min_stars=20, limit=10, offset=2)
    return out.select("repo", "stars", "star_tier", "last_push_days_ago", "sources")


@query("rk_updated", f"{catalog._SCORE} SELECT repo_url FROM sig WHERE coalesce(stars, 0) >= 100 ORDER BY last_push_days_ago ASC NULLS LAST, repo_url LIMIT 20")
def _(spark, d):
    return rank.rank(catalog._signals(spark, d), by="updated", min_stars=100, limit=20).select("repo_url")


@query("rk_stars", f"{catalog._SCORE} SELECT repo_url, stars FROM sig ORDER BY stars DESC NULLS LAST, repo_url LIMIT 20")
def _(spark, d):
    return rank.rank(catalog._signals(spark, d), by="stars", limit=20).select("repo_url", "stars")


@query("gr_neighbours", f"SELECT dst AS id FROM ({catalog._EDGES}) WHERE src = 7")
def _(spark, d):
    return graph.neighbours(graph.clean_edges(catalog._graph(spark, d)[1]), 7)


@query("gr_scores", "WITH r AS (" + graph.pagerank_sql(catalog._NODES, catalog._EDGES, 3).replace("round(r, 9)", "r") + ") SELECT round(sum(rank), 7) AS total, (SELECT count(*) FROM supplier) AS asked FROM r WHERE id IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    nodes, raw = catalog._graph(spark, d)
    ranks = graph.pagerank(nodes, graph.clean_edges(raw), iterations=3)[0]
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return graph.total_of(ranks, wanted).select(F.round("total", 7).alias("total")).join(graph.scores_of(ranks, wanted).agg(F.count("*").alias("asked")))


_TOPICS = "res AS (SELECT source AS topic, doc_id AS doc, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), want AS (SELECT source AS topic, doc_id AS doc FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"


def _topics(spark, d):
    docs = table(spark, d, "documents")
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    results = docs.select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"), F.row_number().over(w).alias("rank"))
    wanted = docs.join(table(spark, d, "labels").where("quality = 1"), "doc_id").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"))
    return results, wanted


@query("ev_topics", f"WITH {_TOPICS}, f AS (SELECT topic, min(rank) AS first FROM res JOIN want USING (topic, doc) GROUP BY topic) SELECT w.topic, CAST(first AS INT) AS first, coalesce(first <= 10, FALSE) AS hit, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS mrr FROM (SELECT DISTINCT topic FROM want) w LEFT JOIN f USING (topic)")
def _(spark, d):
    return retrieval.topic_hits(*_topics(spark, d), 10).withColumn("mrr", F.round("mrr", 6))


@query("ev_decoys", f"WITH {_TOPICS}, toxic AS (SELECT source AS topic, doc_id AS doc FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) SELECT topic, doc, CAST(rank AS INT) AS rank FROM toxic LEFT JOIN res USING (topic, doc)")
def _(spark, d):
    docs = table(spark, d, "documents")
    decoys = docs.join(table(spark, d, "labels").where("toxic = 1"), "doc_id").select(F.col("source").alias("topic"), F.col("doc_id").alias("doc"))
    return retrieval.decoy_ranks(_topics(spark, d)[0], decoys)


@query("ev_search_run", f"""WITH {DOCS}, {LINES}, {catalog.scored_sql(PROBE)}, res AS (SELECT 'q' AS query_id, repo || '/' || path AS doc, row_number() OVER (ORDER BY {catalog.TOTAL} DESC, path, repo) AS rank FROM sc QUALIFY rank <= 50),
qr AS (SELECT repo || '/' || path AS doc, quality * 2 + (1 - toxic) AS gain FROM docs JOIN labels USING (doc_id)), j AS (SELECT rank, coalesce(gain, 0) AS gain FROM res LEFT JOIN qr USING (doc))
SELECT round(coalesce(1.0 / (SELECT min(rank) FROM j WHERE gain >= 1 AND rank <= 10), 0)::DOUBLE, 6) AS mrr, round(((SELECT count(*) FROM j WHERE gain >= 1) / (SELECT count(*) FROM qr WHERE gain >= 1))::DOUBLE, 6) AS recall""")
def _(spark, d):
    """A search run evaluated: the scored top 50 of a probe against graded labels."""
    docs = _docs(spark, d)
    found = search.top(search.scored(docs, TextQuery(PROBE)))
    name = F.concat("repo", F.lit("/"), "path").alias("doc")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "repo")  # 50 rows
    results = found.select(F.lit("q").alias("query_id"), name, "score", "path", "repo").withColumn("rank", F.row_number().over(w)).select("query_id", "doc", "rank")
    qrels = docs.join(table(spark, d, "labels"), "doc_id").select(F.lit("q").alias("query_id"), name, (F.col("quality") * 2 + 1 - F.col("toxic")).alias("gain"))
    return retrieval.evaluate(results, qrels, depth=10, recall_depth=50).select(F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


@query("lm_limits", "SELECT p_partkey AS key, CASE WHEN p_size BETWEEN 1 AND 30 THEN CAST(p_size AS BIGINT) END AS repos, CASE WHEN p_size BETWEEN 1 AND 40 THEN CAST(p_size AS BIGINT) END AS code, p_partkey AS cursor FROM part")
def _(spark, d):
    def limit(kind, n):
        try:
            return tools.limit(kind, n)
        except tools.ToolError:
            return None

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "repos": pd.array([limit("repos", n) for n in f["n"]], "Int64"), "code": pd.array([limit("code", n) for n in f["n"]], "Int64"), "cursor": [tools.cursor(f"off:{k}") for k in f["key"]]})

    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("n")).mapInPandas(run, "key long, repos long, code long, cursor long")


@query("lm_totals", f"WITH {DOCS}, {LINES} SELECT count(DISTINCT repo) AS total FROM lines WHERE contains(lower(line), '{PROBE}')")
def _(spark, d):
    """The total of a code search is exact, whatever the page."""
    got = tools.Tools(_docs(spark, d)).call("search_code", {"probes": [PROBE], "limit": 2})
    return spark.createDataFrame([(got["total"],)], "total long")
