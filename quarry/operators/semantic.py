"""Chunks, embeddings, vector index, and the hybrid of lexical and dense search."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import scalars as S
from quarry.operators import dedup, retrieval, search
from quarry.plans.language import Query
from quarry.sources import tables

DIM, DEPTH = 256, 30
_OFFSET, _PRIME = 0xCBF29CE484222325, 0x100000001B3


#: Runs of characters that are alphanumeric as ``str.isalnum`` has it.
_WORDS = re.compile(r"[^\W_]+")


def _buckets(tokens: list[str], dim: int) -> np.ndarray:
    """FNV-1a of each token's bytes, modulo ``dim``; all tokens go on by a byte at a time."""
    raw = [t.encode() for t in tokens]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data, at = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.cumsum(size) - size
    h, own = np.full(len(raw), _OFFSET, np.uint64), np.arange(len(raw))
    for k in range(int(size.max(initial=0))):
        own = own[size[own] > k]
        h[own] = (h[own] ^ data[at[own] + k]) * np.uint64(_PRIME)
    return (h % np.uint64(dim)).astype(np.int64)


def embed(text: Column, dim: int = DIM) -> Column:
    """Counts of a text's alphanumeric tokens (case kept) by hash bucket, of length one; zero without tokens.

    Any other ``Column -> Column`` of float arrays can take its place in ``index_source``.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        number: dict[str, int] = {}
        found = [[number.setdefault(w, len(number)) for w in _WORDS.findall(t or "")] for t in texts]
        row = np.repeat(np.arange(len(found)), list(map(len, found))) if found else np.zeros(0, np.int64)
        token = np.fromiter((k for ks in found for k in ks), np.int64, len(row))
        v = np.bincount(row * dim + _buckets(list(number), dim)[token], minlength=len(found) * dim).reshape(-1, dim).astype(np.float64)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return pd.Series(list((v / np.where(n > 0, n, 1.0)).astype(np.float32)), dtype=object)

    return run(text)


_CHUNK = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("symbol", T.StringType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType())]))


def python_items(source: str) -> list[dict] | None:
    """Top-level functions and classes of Python source, methods of classes as items of their own; decorators and comments
    right above belong to an item. None where the source does not parse or has no item."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, out = source.split("\n"), []

    def add(node, prefix=""):
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        while start > 1 and lines[start - 2].lstrip().startswith("#"):
            start -= 1
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if prefix else "function"
        out.append({"kind": kind, "symbol": prefix + node.name, "start_line": start, "end_line": node.end_lineno})

    items = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    for node in tree.body:
        if isinstance(node, items):
            add(node)
            if isinstance(node, ast.ClassDef):
                for inner in node.body:
                    if isinstance(inner, items):
                        add(inner, f"{node.name}.")
    return out or None


#: How a top-level item begins in languages with braces: kind by pattern; the group is the symbol. Ours, by line shapes.
_ITEMS = {
    "rust": [("function", r"(?:pub(?:\([^)]*\))? )?(?:const |async |unsafe |extern \"[^\"]*\" )*fn (\w+)"), ("class", r"(?:pub(?:\([^)]*\))? )?(?:struct|enum|trait|union|mod) (\w+)"), ("impl", r"(?:unsafe )?impl\b(?:<[^{]*>)? ?([^{]*?) ?(?:where\b.*)?\{?$")],
    "go": [("function", r"func (?:\([^)]*\) )?(\w+)"), ("class", r"type (\w+)")],
    "javascript": [("function", r"(?:export )?(?:default )?(?:async )?function\*? ?(\w+)"), ("class", r"(?:export )?(?:default )?class (\w+)"), ("function", r"(?:export )?const (\w+) = (?:async )?\(?[^=]*=>")],
    "c": [("function", r"[A-Za-z_][\w\s*]*?\b(\w+)\([^;]*$"), ("class", r"(?:typedef )?(?:struct|enum|union) (\w+)[^;(]*$")],
}
_ITEMS["typescript"] = [*_ITEMS["javascript"], ("class", r"(?:export )?(?:interface|type|enum) (\w+)")]
_COMPILED = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in _ITEMS.items()}
_NO_CODE = re.compile(r"//.*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'")


def brace_items(source: str, lang: str) -> list[dict] | None:
    """Top-level items of a language with braces: from a line that begins one to the line that closes its braces (or its end at ``;``).

    Comments and attributes right above belong to an item. None where there is no item or braces do not close.
    """
    lines, out, i = source.split("\n"), [], 0
    while i < len(lines):
        hit = next(((kind, m) for kind, p in _COMPILED.get(lang, ()) if (m := p.match(lines[i]))), None)
        if hit is None:
            i += 1
            continue
        start, depth, opened, end = i, 0, False, None
        for j in range(i, len(lines)):
            code = _NO_CODE.sub("", lines[j])
            depth += code.count("{") - code.count("}")
            opened = opened or "{" in code
            if depth <= 0 and (opened or ";" in code or lang == "go" and not code.rstrip().endswith(("(", ","))):
                end = j
                break
        if end is None:
            return None
        while start > 0 and re.match(r"\s*(//|/\*|\*|#\[|@)", lines[start - 1]):
            start -= 1
        out.append({"kind": hit[0], "symbol": hit[1][1].strip(), "start_line": start + 1, "end_line": end + 1})
        i = end + 1
    return out or None


def items_of(source: str, lang: str) -> list[dict] | None:
    return python_items(source) if lang == "python" else brace_items(source, lang)


def chunks(docs: DataFrame) -> DataFrame:
    """(id, repo, path, kind, symbol, start_line, end_line, text, lang): syntax items of Python and of languages with braces, line windows of the rest."""

    @F.pandas_udf(_CHUNK)
    def parse(sources: pd.Series, langs: pd.Series) -> pd.Series:
        return pd.Series([items_of(t, lang) if t else None for t, lang in zip(sources, langs, strict=True)], dtype=object)

    tables.bound_batches(docs.sparkSession)
    lang = S.detect_lang(F.col("path"))
    items = docs.select("repo", "path", S.lines_of(F.col("content")).alias("all"), F.when(lang.isin("python", *_ITEMS), parse("content", lang)).alias("items"))
    window = lambda at: F.struct(F.lit("window").alias("kind"), F.lit(None).cast("string").alias("symbol"), (at + 1).cast("long").alias("start_line"), F.least(at + dedup.WINDOW, F.size("all")).cast("long").alias("end_line"))
    each = items.where("size(all) > 0").select("repo", "path", "all", F.explode(F.coalesce("items", F.transform(dedup.window_starts(F.col("all")), window))).alias("x"))
    ident = F.concat("repo", F.lit("/"), "path", F.lit(":"), F.col("x.start_line").cast("string"), F.lit("-"), F.col("x.end_line").cast("string"))
    text = F.array_join(F.slice("all", F.col("x.start_line").cast("int"), (F.col("x.end_line") - F.col("x.start_line") + 1).cast("int")), "\n")
    return each.select(ident.alias("id"), "repo", "path", "x.kind", "x.symbol", "x.start_line", "x.end_line", text.alias("text"), lang.alias("lang"))


def put_chunks(store: DataFrame | None, rows: DataFrame) -> DataFrame:
    """A chunk store with ``rows`` in it: of equal ids the new row stays."""
    fresh = rows.dropDuplicates(["id"])
    return fresh if store is None else store.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def get_chunks(store: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted ids with their chunks; null columns where there is none."""
    return ids.select("id").join(store, "id", "left")


def chunks_by_path(store: DataFrame, repo: str, path: str) -> DataFrame:
    return store.where((F.col("repo") == repo) & (F.col("path") == path)).orderBy("start_line", "id")


def resolve(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Hits (id, score) with the repo, path and ``path:line`` locator of their chunks; hits without a chunk stay."""
    return hits.join(store.select("id", "repo", "path", F.concat("path", F.lit(":"), F.col("start_line").cast("string")).alias("locator")), "id", "left")


def index_source(docs: DataFrame, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """Chunks with their embeddings; of chunks with one id the last in (path, kind) order stays."""
    w = Window.partitionBy("id").orderBy(F.desc("kind"))
    rows = chunks(docs).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return rows.withColumn("embedding", embedder(F.col("text")))


def search_chunks(index: DataFrame, query: str, k: int = DEPTH, where: Column | None = None, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """The k chunks nearest to a query, with ``path:line`` locators."""
    target = list(index.sparkSession.range(1).select(embedder(F.lit(query)).alias("e")).first().e)
    best = retrieval.cosine_top_k(index, target, k, where, also=("repo", "path", "start_line", "end_line", "symbol"))
    return best.withColumn("locator", F.concat("path", F.lit(":"), F.col("start_line").cast("string")))


def hybrid_search(docs: DataFrame, index: DataFrame, query: str, anchor: str, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of the chunks of lexically ranked files that hold the anchor, and the nearest chunks.

    Identifier-shaped queries skip the dense leg.
    """
    q = Query(anchor, case="sensitive")
    files = search.top(search.scored(docs, q), depth).select("repo", "path", "score")
    lexical = index.join(files, ["repo", "path"]).where(F.col("text").contains(anchor)).select("id", "score", "start_line")
    lexical = lexical.orderBy(F.desc("score"), "id").limit(depth).select("id", "score")
    kind = docs.sparkSession.range(1).select(S.classify_query(F.lit(query)).alias("k")).first().k
    dense = search_chunks(index, query, depth).select("id", "score") if kind == "natural_language" else lexical.limit(0)
    return retrieval.rrf(lexical, dense)
