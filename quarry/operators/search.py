"""Code and text search: filters, line matches, explainable scores, top-k, probes, roll-ups, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import scalars as S
from quarry.plans.language import Query, required_literals

MAX_RESULTS, PROBE_CAP = 50, 500
_WORDCHAR = "[A-Za-z0-9_]"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def allows(*, repos=(), exclude_repos=(), langs=(), exclude_langs=(), paths=(), exclude_paths=()) -> Column:
    """OR within a field, AND across fields; repos and paths by substring, languages exactly."""
    out = F.lit(True)
    for values, col, keep in ((repos, "repo", True), (exclude_repos, "repo", False), (paths, "path", True), (exclude_paths, "path", False)):
        if values:
            test = _any([F.col(col).contains(v) for v in values])
            out = out & (test if keep else ~test)
    lang = S.detect_lang(F.col("path"))
    if langs:
        out = out & lang.isin(list(langs))
    if exclude_langs:
        out = out & ~lang.isin(list(exclude_langs))
    return out


def _java(q: Query) -> str:
    """The pattern for Java, with Unicode classes and cases, and no line ends but ``\\n``."""
    body = q.pattern if q.kind == "regex" else re.escape(q.pattern)
    return ("(?diuU)" if q.case == "insensitive" else "(?dU)") + body


def candidates_test(q: Query) -> Column:
    """Whether a document is admitted, passes the filters and may match: it holds every literal that the pattern requires.

    The test looks at whole contents, so it never uses the pattern itself: its anchors would mean something else there.
    """
    keep = S.admitted(F.col("content")) & allows(repos=q.repos, exclude_repos=q.exclude_repos, langs=q.langs, exclude_langs=q.exclude_langs, paths=q.paths, exclude_paths=q.exclude_paths)
    if q.content_scope == "test":
        keep = keep & F.lower("path").rlike("test|spec")
    text = F.col("content") if q.case == "sensitive" else F.lower(F.translate("content", "\u017f\u212a", "sk"))  # both match s and k in any case
    for literal in required_literals(q):
        keep = keep & text.contains(literal if q.case == "sensitive" else literal.lower())
    return keep


def _hits(lines: Column, q: Query) -> Column:
    """(line_no, line, n_spans, n_word_spans) of the lines that match."""
    pattern = _java(q.validate())
    flags = re.match(r"\(\?\w+\)", pattern)[0]
    bounded = f"{flags}(?<!{_WORDCHAR})(?:{pattern[len(flags) :]})(?!{_WORDCHAR})"
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("long")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line")))
    found = F.filter(numbered, lambda x: x["line"].rlike(pattern))
    return F.transform(found, lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), count(x["line"], pattern).alias("n_spans"), count(x["line"], bounded).alias("n_word_spans")))


def matched(docs: DataFrame, queries: list[Query]) -> DataFrame:
    """Matching documents, one row per query and document: query (its number), repo, path, and hits: (line_no, line, n_spans, n_word_spans) per line.

    All lines are tested within the row of their document, and all queries in one scan: nothing is shuffled.
    """
    hits = [F.when(F.col(f"may{k}"), F.struct(F.lit(k).alias("query"), _hits(F.col("all"), q).alias("hits"))) for k, q in enumerate(queries)]
    may = [candidates_test(q) for q in queries]
    rows = docs.select("repo", "path", "content", *[m.alias(f"may{k}") for k, m in enumerate(may)]).where(_any([F.col(f"may{k}") for k in range(len(queries))]))
    rows = rows.select("repo", "path", *[f"may{k}" for k in range(len(queries))], S.lines_of(F.col("content")).alias("all"))
    each = rows.select("repo", "path", F.explode(F.array(*hits)).alias("x")).where("x IS NOT NULL")
    return each.select("x.query", "repo", "path", "x.hits").where(F.size("hits") > 0)


def line_matches(docs: DataFrame, q: Query) -> DataFrame:
    """One row per matching line: repo, path, line_no, line (whole), n_spans, n_word_spans."""
    return matched(docs, [q]).select("repo", "path", F.explode("hits").alias("x")).select("repo", "path", "x.*")


def score_columns(q: Query, n_lines: Column, any_word: Column, any_exact: Column) -> dict[str, Column]:
    """The seven components of a document's score."""
    path, low = F.col("path"), F.lower("path")
    stem = F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", 1))
    on = lambda test, v: F.when(test, float(v)).otherwise(0.0)
    return {
        "whole_word": on(any_word, 2.0),
        "case_exact": on(any_exact, 1.5) if q.case == "sensitive" else F.lit(0.0),
        "definition_path": on(path.startswith("src/") | path.contains("/src/"), 1.0),
        "test_path": on(low.contains("test") | low.contains("spec"), -1.0),
        "filename_match": on(stem.contains(q.pattern.lower()), 2.0),
        "path_length": F.least(F.lit(1.0), F.lit(100.0) / (F.octet_length(path) + 20)),
        "density": F.log1p(n_lines.cast("double")),
    }


def scored(docs: DataFrame, q: Query) -> DataFrame:
    """One row per matching document: components, score (6 places), matched_lines, matches (line_no, text cut at 500)."""
    return _scores(matched(docs, [q]), [q]).drop("query")


def _has(text: str):
    return lambda x: x["line"].contains(text)


def _scores(found: DataFrame, queries: list[Query]) -> DataFrame:
    """Scores of ``matched`` documents, within the row."""
    any_word = F.exists("hits", lambda x: x["n_spans"] == x["n_word_spans"])
    cut = lambda x: F.when(F.octet_length(x) > S.MAX_LINE, F.concat(F.left(x, F.lit(S.MAX_LINE)), F.lit("…"))).otherwise(x)
    parts: dict[str, Column] = {}
    for k, q in enumerate(queries):
        exact = F.exists("hits", _has(q.pattern)) & F.lit(q.kind == "literal")
        for name, c in score_columns(q, F.size("hits"), any_word, exact).items():
            parts[name] = F.when(F.col("query") == k, c).otherwise(parts[name]) if k else c
    total = reduce(lambda a, b: a + b, [F.col(f"_{n}") for n in parts])
    out = found.select("*", *[c.alias(f"_{n}") for n, c in parts.items()])
    return out.select(
        "query", "repo", "path", F.size("hits").cast("long").alias("matched_lines"), *[F.round(f"_{n}", 6).alias(n) for n in parts], F.round(total, 6).alias("score"),
        F.transform("hits", lambda x: F.struct(x["line_no"].alias("line_no"), cut(x["line"]).alias("text"))).alias("matches"),
    )


def top(found: DataFrame, k: int = MAX_RESULTS) -> DataFrame:
    return found.orderBy(F.desc("score"), "path", "repo").limit(k)


def parse_probe(probe: str) -> Query:
    """``/x/`` is a regex, anything else a literal in lower case."""
    if len(probe) > 2 and probe.startswith("/") and probe.endswith("/"):
        return Query(pattern=probe[1:-1], kind="regex", case="sensitive")
    return Query(pattern=probe.lower())


def multi_probe(docs: DataFrame, probes: list[str], *, cap: int | None = PROBE_CAP) -> DataFrame:
    """(probe_idx, probe, repo, path, score, matched_lines, matches): the best ``cap`` documents of each probe, or all."""
    if not 1 <= len(probes) <= 5:
        raise ValueError("1 to 5 probes are allowed")
    queries = [parse_probe(p) for p in probes]
    found = _scores(matched(docs, queries), queries)  # one scan for all probes
    rows = found.select(F.col("query").alias("probe_idx"), F.element_at(F.array(*map(F.lit, probes)), F.col("query") + 1).alias("probe"), "repo", "path", "score", "matched_lines", "matches")
    if cap is None:
        return rows
    w = Window.partitionBy("probe_idx").orderBy(F.desc("score"), "path", "repo")  # each task keeps its own best before the shuffle
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")


def merge_probes(hits: DataFrame) -> DataFrame:
    """One row per document: its probes in order, breadth, and the matches of its first probe."""
    return hits.groupBy("repo", "path").agg(F.array_sort(F.collect_set("probe")).alias("probes"), F.countDistinct("probe").alias("breadth"), F.max("score").alias("score"), F.min_by("matches", "probe_idx").alias("matches"))


def roll_up(hits: DataFrame) -> DataFrame:
    """One row per repo, widest first: probes, breadth, number of files, and a sample line."""
    sample = F.min_by(F.element_at("matches", 1)["text"], F.struct("probe_idx", "path"))
    out = hits.groupBy("repo").agg(F.array_sort(F.collect_set("probe")).alias("probes"), F.countDistinct("probe").alias("breadth"), F.countDistinct("path").alias("files"), sample.alias("sample"))
    return out.orderBy(F.desc("breadth"), F.desc("files"), "repo")


def snippets(found: DataFrame, docs: DataFrame, *, context: int = 5, per_repo: int = 2) -> DataFrame:
    """Lines around the first match of each repo's best documents: repo, path, start_line, end_line, match_line, locator, lines."""
    c = max(3, min(10, context))
    w = Window.partitionBy("repo").orderBy(F.desc("score"), "path")
    best = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_repo).select("repo", "path", F.element_at("matches", 1)["line_no"].alias("match_line"))
    wide = best.join(docs.select("repo", "path", S.lines_of(F.col("content")).alias("all")), ["repo", "path"])
    total = F.greatest(F.size("all"), F.lit(1)).cast("long")
    at = F.least(F.greatest(F.col("match_line"), F.lit(1)), total)
    start, end = F.greatest(at - c, F.lit(1)), F.least(at + c, total)
    body = F.transform(F.slice("all", start.cast("int"), (end - start + 1).cast("int")), S.cap_line)
    return wide.select("repo", "path", start.alias("start_line"), end.alias("end_line"), at.alias("match_line"), F.concat("path", F.lit(":L"), start.cast("string"), F.lit("-L"), end.cast("string")).alias("locator"), body.alias("lines"))


def fetch_file(docs: DataFrame, repo: str, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines start..end of a file (1-based, inclusive, clamped; the first 100 by default)."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("lines are 1-based and must not run backwards")
    lines = docs.where((F.col("repo") == repo) & (F.col("path") == path)).select("repo", "path", S.lines_of(F.col("content")).alias("all"))
    last = F.least(F.lit(end if end is not None else start + 99), F.size("all"))
    body = F.when(last >= start, F.slice("all", F.lit(start), last - start + 1)).otherwise(F.array().cast("array<string>"))
    return lines.select("repo", "path", F.size("all").cast("long").alias("total_lines"), F.array_join(body, "\n").alias("text"))


def doc_pages(docs: DataFrame) -> DataFrame:
    return docs.where(F.lower(F.substring_index("path", ".", -1)).isin("md", "mdx", "markdown", "txt"))


def grep_docs(docs: DataFrame, probe: str) -> DataFrame:
    """Matching lines of documentation pages, grouped by page."""
    q = parse_probe(probe)
    hits = line_matches(doc_pages(docs), q)
    return hits.groupBy("repo", "path").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("line"), F.col("line").alias("text")))).alias("lines"))


def tree(docs: DataFrame, repo: str, *, prefix: str = "", glob: str = "", limit: int | None = 200) -> DataFrame:
    """Sorted paths of a repo below a prefix; a glob is a suffix of the file name after a leading ``*``."""
    rows = docs.where((F.col("repo") == repo) & F.col("path").startswith(prefix))
    if glob:
        rows = rows.where(F.substring_index("path", "/", -1).endswith(glob.lstrip("*")))
    out = rows.select("path", F.octet_length("content").cast("long").alias("size"))
    return out if limit is None else out.orderBy("path").limit(limit)


def profiles(docs: DataFrame) -> DataFrame:
    """Per repo: files, sorted languages, top-level folders, digest of its first documentation page."""
    top_dir = F.substring_index("path", "/", 1)
    page = F.col("path").endswith(".md")
    return docs.groupBy("repo").agg(
        F.count("*").alias("files"), F.array_sort(F.collect_set(S.detect_lang(F.col("path")))).alias("languages"),
        F.array_sort(F.collect_set(F.when(~top_dir.contains("."), top_dir))).alias("top_dirs"), S.readme_digest(F.min_by(F.when(page, F.col("content")), F.when(page, F.col("path")))).alias("digest"),
    )


def find_repo(docs: DataFrame, repo: str) -> DataFrame:
    """The repository of this name, exactly, else the first by name that differs in case only; no row if there is none."""
    same = docs.where(F.lower("repo") == repo.lower()).groupBy("repo").agg((F.first("repo") != repo).alias("differs"))
    return same.orderBy("differs", "repo").limit(1).select("repo")


def repo_listing(docs: DataFrame) -> DataFrame:
    return docs.groupBy("repo").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "repo")


def page_of(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset.. of a total order; past the end there are none."""
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit must be positive")
    return rows.orderBy(*order).offset(offset).limit(limit)


def byte_budget(rows: DataFrame, order: list, cap: int = 25_000) -> DataFrame:
    """The longest prefix of rows, in order, whose JSON stays within ``cap`` bytes.

    A row is two bytes or more, so only the first ``cap`` / 2 can be in it, and only these meet in one task.
    """
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    first = rows.orderBy(*order).limit(cap // 2 + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("_b", F.sum(size).over(w)).where(F.col("_b") <= cap).drop("_b")


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, offsets) of (doc_id, content)."""
    for batch in batches:
        for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
            raw = np.frombuffer(content.cast(pa.binary()).as_buffer(), np.uint8).astype(np.int32)
            gram = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
            order = np.argsort(gram, kind="stable").astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], np.diff(gram[order]) != 0)))
            offsets = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(order))
            yield pa.RecordBatch.from_arrays([pa.array(gram[order[first]]), pa.repeat(doc_id, len(first)), offsets], names=["gram", "doc_id", "offsets"])


def trigrams(docs: DataFrame) -> DataFrame:
    """Positional postings: (gram, doc_id, offsets) over the UTF-8 bytes of admitted documents; a gram is three bytes as one number.

    A document's postings are made within its row, so nothing is shuffled.
    """
    ok = docs.where(S.admitted(F.col("content")) & (F.octet_length("content") >= 3))
    return ok.select("doc_id", "content").mapInArrow(_positions, f"gram int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, offsets array<int>")


def gram_numbers(literal: str) -> list[int]:
    """The trigrams of a literal, in order."""
    b = literal.encode()
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


def case_variants(gram: int) -> list[int]:
    """The gram in every case of its ASCII letters; none where a letter (k, s) also has a form outside of ASCII."""
    choices = []
    for b in gram.to_bytes(3, "big"):
        c = chr(b)
        if c in "kKsS" or b >= 128:
            return []
        choices.append([ord(c.lower()), ord(c.upper())] if c.isalpha() else [b])
    return [x << 16 | y << 8 | z for x, y, z in product(*choices)]


def gram_plan(q: Query) -> list[list[int]]:
    """What a document must have: of each list one gram. Empty where the pattern requires no trigram."""
    grams = sorted({g for literal in required_literals(q) for g in gram_numbers(literal)})
    wanted = [[g] if q.case == "sensitive" else case_variants(g) for g in grams]
    return [w for w in wanted if w]


@F.pandas_udf(T.DoubleType())
def entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy of a text's bytes, or of bytes, in bits per byte; null and empty contents have 0."""

    def one(raw):
        n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
        p = n[n > 0] / max(1, n.sum())
        return float(-(p * np.log2(p)).sum()) + 0.0

    return content.map(lambda x: one(x.encode() if isinstance(x, str) else bytes(x or b"")))


def entropies(docs: DataFrame) -> DataFrame:
    """(doc_id, entropy) of every document."""
    return docs.select("doc_id", entropy("content").alias("entropy"))


def gate(docs: DataFrame) -> DataFrame:
    """``docs`` with ``reason``: why the corpus gate rejects a document (size, NUL bytes, entropy), or null.

    Only contents that pass the other tests go to Python. The row that Spark keeps meanwhile has what is selected of the result:
    the list of one, whose row is made before, keeps a content out of it that is not.
    """
    plain = S.rejection(F.col("content"), F.lit(0.0))
    once = F.array(F.struct(plain.alias("_reason"), F.when(plain.isNull(), F.col("content")).alias("_left")))
    rows = docs.select("*", F.inline(once)).withColumn("reason", F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(entropy("_left") > S.MAX_ENTROPY, "high_entropy"))
    return rows.select(*docs.columns, "reason")


def planned_candidates(postings: DataFrame, wanted: list[list[int]]) -> DataFrame:
    """Ids of the documents that have one gram of each list: a superset of the matches. Postings of other grams are not read."""
    at = {g: k for k, grams in enumerate(wanted) for g in grams}
    number = F.create_map(*[F.lit(x).cast("int") for kv in at.items() for x in kv])
    hit = postings.where(F.col("gram").isin(sorted(at))).select("doc_id", number[F.col("gram")].alias("wanted"))
    return hit.groupBy("doc_id").agg(F.countDistinct("wanted").alias("n")).where(F.col("n") == len(wanted)).select("doc_id")


# -- the stored index ----------------------------------------------------------------------------

INDEX_VERSION = 2
#: Bytes of text whose postings are packed together.
PACKED_BYTES = 4 << 20
_PACKED = ["gram", "doc_id", "docs", "sizes", "offsets"]


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in bytes of seven bits, the lowest first, the top bit where more follow; and the size of each."""
    v, size = values.astype(np.uint64), np.ones(len(values), np.int64)
    for k in range(7, 64, 7):
        more = v >> np.uint64(k) > 0
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        out[at[own] + k] = (v[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[own] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def _numbers(data: bytes) -> np.ndarray:
    """The numbers of ``_varints``."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    end = np.flatnonzero(raw < 128)
    start = np.append(0, end[:-1] + 1)
    place = (np.arange(len(raw)) - np.repeat(start, end - start + 1)).astype(np.uint64)
    return np.add.reduceat((raw & 127).astype(np.uint64) << np.uint64(7) * place, start)


def _pack(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The postings of some documents, packed: a row per gram, or per gram and document where ids are no integers."""
    numbers = pa.types.is_integer(ids.type)
    if numbers:
        order = pa.array(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"))
        ids, texts = ids.take(order), texts.take(order)
    size = pa.compute.binary_length(texts.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8).astype(np.uint64)
    key = (raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]) << np.uint64(32) | np.arange(len(raw) - 2, dtype=np.uint64)
    across = np.concatenate([start[1:] - 2, start[1:] - 1])
    key = np.delete(key, across[across < len(key)])  # grams of two documents
    key.sort()
    gram, at = (key >> np.uint64(32)).astype(np.int32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(start, at, side="right") - 1
    at -= start[doc]
    new = np.append(True, gram[1:] != gram[:-1])
    own = np.flatnonzero(new | np.append(True, doc[1:] != doc[:-1]))  # the first of each gram and document
    row = np.flatnonzero(new[own]) if numbers else np.arange(len(own))  # those with which a row begins
    step = np.diff(at, prepend=0)
    step[own] = at[own]

    def binary(values, first):
        data, length = _varints(values)
        edge = np.append(0, np.cumsum(length))
        return pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edge[np.append(first, len(values))].astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])

    first = ids.take(pa.array(doc[own[row]]))
    if numbers:
        value = ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[doc[own]]
        gap = np.delete(np.diff(value, prepend=value[:1]), row)  # of each document of a row but the first
        docs = binary(gap, row - np.arange(len(row)))
    else:
        docs = pa.array([b""] * len(row), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(gram[own[row]]), first, docs, binary(np.diff(np.append(own, len(at))), row), binary(step, own[row])], names=_PACKED)


def packed(docs: DataFrame) -> DataFrame:
    """``trigrams`` in few and small rows, each of one gram in the documents of about PACKED_BYTES of text.

    doc_id is the first document; docs has the distances of the ids after it, sizes the number of offsets of each document, offsets
    the distances between these, all as ``_varints``.
    """

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pa.compute.binary_length(batch.column(1).cast(pa.binary())).to_numpy(zero_copy_only=False))
            part = ends // PACKED_BYTES
            edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if hi > lo:
                    yield _pack(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))

    ok = docs.where(S.admitted(F.col("content")) & (F.octet_length("content") >= 3))
    return ok.select("doc_id", "content").mapInArrow(run, f"gram int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, docs binary, sizes binary, offsets binary")


def unpacked(rows: DataFrame, *, offsets: bool = True) -> DataFrame:
    """(gram, doc_id, offsets) of ``packed`` rows, or without the offsets."""

    def run(batches):
        for batch in batches:
            gram, first, docs, sizes, steps = batch.columns
            gaps = [_numbers(x) for x in docs.to_pylist()]
            many = np.array([len(g) + 1 for g in gaps], np.int64)
            which = np.repeat(np.arange(batch.num_rows), many)
            ids = first.take(pa.array(which))
            if pa.types.is_integer(first.type) and len(which):
                base = first.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                ids = pa.array(np.concatenate([b + np.append(np.uint64(0), np.cumsum(g, dtype=np.uint64)) for b, g in zip(base, gaps, strict=True)]).view(np.int64)).cast(first.type)
            cols = [gram.take(pa.array(which)), ids]
            if offsets:
                size = np.concatenate([np.zeros(0, np.uint64), *[_numbers(x) for x in sizes.to_pylist()]]).astype(np.int64)
                step = np.concatenate([np.zeros(0, np.uint64), *[_numbers(x) for x in steps.to_pylist()]]).astype(np.int64)
                end = np.cumsum(size)
                total = np.cumsum(step)
                before = np.append(0, total)[end - size]
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), pa.array(total - np.repeat(before, size), pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["gram", "doc_id", "offsets"][: len(cols)])

    return rows.select(*_PACKED).mapInArrow(run, f"gram int, doc_id {rows.schema['doc_id'].dataType.simpleString()}" + ", offsets array<int>" * offsets)


def save_index(docs: DataFrame, path: str) -> None:
    """Stores documents (doc_id, repo, path, content) and their postings below ``path``, with a manifest of the format's version.

    Postings are packed and ordered by gram over all files, so that a search reads the few row groups whose range holds its grams.
    """
    ok = docs.where(S.admitted(F.col("content"))).select("doc_id", "repo", "path", S.detect_lang(F.col("path")).alias("lang"), "content")
    ok.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
    stored = docs.sparkSession.read.parquet(f"{path}/docs")
    packed(stored).repartitionByRange("gram", "doc_id").sortWithinPartitions("gram", "doc_id").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([(INDEX_VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


class Index:
    """A stored index, opened: its documents and packed postings."""

    def __init__(self, spark: SparkSession, path: str):
        version = [r.version for r in spark.read.schema("version int").json(f"{path}/manifest").collect()]
        if version != [INDEX_VERSION]:
            raise ValueError(f"{path}: index version {version}, {INDEX_VERSION} is supported")
        self.docs, self.packed = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings")

    def repos(self) -> DataFrame:
        """Repositories with the number of documents and their first and last path."""
        return self.docs.groupBy("repo").agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))

    def postings(self, grams: list[int], *, offsets: bool = True) -> DataFrame:
        """(gram, doc_id, offsets) of some grams; others are not read."""
        return unpacked(self.packed.where(F.col("gram").isin(grams)), offsets=offsets)

    def candidates(self, q: Query) -> DataFrame:
        """The documents whose postings allow a match; all of them where the pattern requires no trigram."""
        wanted = gram_plan(q.validate())
        if not wanted:
            return self.docs
        found = self.postings(sorted({g for grams in wanted for g in grams}), offsets=False)
        return self.docs.join(planned_candidates(found, wanted), "doc_id", "left_semi")

    def search(self, q: Query) -> DataFrame:
        """``scored`` over the candidates only."""
        return scored(self.candidates(q), q)


def update_docs(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Incremental index: changed documents replace those of equal (repo, path); inadmissible ones only delete."""
    keep = docs.join(changed.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    return keep.unionByName(changed.where(S.admitted(F.col("content"))).select(*docs.columns))


def remove_repo(docs: DataFrame, repo: str) -> DataFrame:
    return docs.where(F.col("repo") != repo)


#: The columns that the concise form keeps, by tool, and those of each named field.
CONCISE = {
    "search_repos": ["repo", "stars", "star_tier", "license", "license_class", "activity", "what", "url"],
    "repo_tree": ["path", "size"],
    "repo_profile": ["repo", "files", "languages", "top_dirs"],
    "search_code": ["repo", "probes_hit", "probe_breadth", "total_probes", "hit_files", "license_class", "path", "locator", "start_line", "end_line", "backends"],
}
FIELDS = {"what": ["what"], "catch": ["catch"], "license": ["license", "license_class"], "recency": ["last_release", "days_since_activity", "activity"], "stars": ["stars", "star_tier"], "urls": ["url"]}


def concise(rows: DataFrame, tool: str) -> DataFrame:
    """The concise projection of a tool's rows; tools without one keep all columns."""
    keep = CONCISE.get(tool)
    return rows if keep is None else rows.select(*[c for c in rows.columns if c in keep])


def pick_fields(rows: DataFrame, names: list[str]) -> DataFrame:
    """``repo`` and the columns of the named fields, with ``fields_returned``."""
    keep = {"repo"}.union(*(FIELDS.get(n, []) for n in names))
    return rows.select(*[c for c in rows.columns if c in keep], F.array(*map(F.lit, names)).alias("fields_returned"))


def repo_rows(repos: DataFrame) -> DataFrame:
    """Repository rows with derived tiers, classes and addresses."""
    return repos.withColumns({"star_tier": S.star_tier(F.col("stars")), "license_class": S.license_class(F.col("license")), "activity": S.activity(F.col("days_since_activity")), "url": F.concat(F.lit("https://github.com/"), "repo")})


def match_repos(repos: DataFrame, phrases: str, *, topic: str | None = None, language: str | None = None, min_stars: int | None = None) -> DataFrame:
    """Any of the ``;``-separated phrases in repo, what, catch or topics, and exact topic, language and minimum stars.

    Without a phrase nothing matches.
    """
    hay = F.lower(F.concat_ws(" ", "repo", "what", "catch", F.array_join("topics", " ")))
    wanted = [p.strip().lower() for p in phrases.split(";") if p.strip()]
    keep = _any([hay.contains(p) for p in wanted]) if wanted else F.lit(False)
    if topic is not None:
        keep = keep & F.exists("topics", lambda t: F.lower(t) == topic.lower())
    if language is not None:
        keep = keep & (F.lower("language") == language.lower())
    if min_stars is not None:
        keep = keep & (F.col("stars") >= min_stars)
    return repos.where(keep)
