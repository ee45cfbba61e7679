"""Language identification (operator 3): Bayesian fusion of independent evidence.

posterior(l) ~ prior of the host(l) * P(text | l) * P(declared markup language | l) * P(address suffix | l)

* Text: a byte-trigram model over hashed buckets, fitted on at most ``SAMPLE`` labelled rows (chosen by hash, so
  every run fits the same). Trigrams are no independent witnesses: their mean log likelihood counts as
  ``WITNESSES`` of them at most. The class ``und`` has uniform trigrams and stands for texts of no known language.
* Declared language (``<html lang>`` or a column): right in DECLARED_RIGHT of cases, else any other.
* Address: a country suffix or a path segment that names a language, right in SUFFIX_RIGHT of cases.
* Host prior: soft counts by the texts alone, summed per host and per domain over all rows, smoothed
  hierarchically: host towards domain towards the whole, with SMOOTH pseudo-rows at each level. A row's own count
  is taken out of its host's before it is used. The host
  table is joined by Spark's own choice of strategy, so it is broadcast only while it is small.

So nothing is evidence twice: the text, the declaration and the address of a row count once each, and where a label
column also serves as the declaration, rows that train the text model declare nothing (``Model.cut``); at most half of
the labelled rows train it.

A row is accepted when its best class is a language with a posterior of MIN_POSTERIOR or more.

Edge cases: null or empty texts, and texts without letters, are ``und`` and not accepted; missing
declarations, addresses and hosts are no evidence; texts of any length are scored whole; of classes with equal posteriors
the first by name wins; repeated rows each count for their host; no
labelled rows leave only ``und``; an empty table gives no rows; columns named like the results are replaced, all others
carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import saved, table, with_fields

SAMPLE, BUCKETS, WITNESSES = 4000, 1 << 14, 120
DECLARED_RIGHT, SUFFIX_RIGHT, SMOOTH, MIN_POSTERIOR, UNKNOWN_PRIOR = 0.9, 0.8, 20.0, 0.5, 0.02
#: Country suffixes that name a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the byte trigrams of rows; runs of other bytes than letters count as one space."""
    size = np.diff(off)
    low = K.LOWER[data]
    letter = K.IS_WORD[data] & ~((data >= 48) & (data <= 57))
    row = np.repeat(np.arange(len(size)), size)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a word
    code = np.where(letter, low, 32)[keep].astype(np.uint32)
    row = row[keep]
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (code[:-2] * np.uint32(65599) + code[1:-1]) * np.uint32(65599) + code[2:]
    same = row[:-2] == row[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)[same], row[:-2][same]


class Model:
    """Log likelihoods (BUCKETS x classes); the last class is ``und``."""

    def __init__(self, langs: list[str], counts: np.ndarray, cut: int = -(1 << 63)):
        """``counts``: (BUCKETS x languages) trigrams seen. ``cut``: labelled rows with hashes up to it have trained the model."""
        counts = counts + 0.05
        logs = np.log(counts / counts.sum(axis=0)) if langs else np.zeros((BUCKETS, 0))
        self.langs, self.cut = [*langs, "und"], cut
        self.logs = np.hstack([logs, np.full((BUCKETS, 1), -np.log(BUCKETS))]).astype(np.float32)

    def score(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x classes) log likelihoods, and which rows have any letters."""
        n = len(off) - 1
        out, has = np.zeros((n, len(self.langs))), np.zeros(n, bool)
        for lo, hi in K.slices(off):
            bucket, row = _trigrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            count = np.bincount(row, minlength=hi - lo)
            for k in range(len(self.langs)):
                out[lo:hi, k] = np.bincount(row, self.logs[bucket, k], hi - lo)
            has[lo:hi] = count > 0
            out[lo:hi] *= (np.minimum(count, WITNESSES) / np.maximum(count, 1))[:, None]
        return out, has


def label_hash(text_col: str, lang_col: str) -> Column:
    """Decides whether a labelled row trains the model: it can if this is negative."""
    return F.xxhash64(text_col, lang_col)


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits the text model on at most ``sample`` different labelled texts: those with the smallest hashes, of half of all texts.

    Trigrams are counted on the executors; the driver gets at most BUCKETS counts per language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), label_hash(text_col, lang_col).alias("h")).where("h < 0")
    cut = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return Model([], np.zeros((BUCKETS, 0)))
    chosen = rows.where(F.col("h") <= cut).dropDuplicates(["h", "l"])

    def count(batches):
        for batch in batches:
            data, off = K.column_bytes(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi in K.slices(off):
                bucket, row = _trigrams(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for lang in set(langs[lo:hi]):
                    n = np.bincount(bucket[langs[lo:hi][row] == lang], minlength=BUCKETS)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["l", "bucket", "n"])
        K.trim()

    seen = chosen.select("l", "t").mapInArrow(count, "l string, bucket bigint, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.l for r in seen})
    at, counts = {x: k for k, x in enumerate(langs)}, np.zeros((BUCKETS, len(langs)))
    for r in seen:
        counts[r.bucket, at[r.l]] = r.n
    return Model(langs, counts, cut)


def html_text(html: Column) -> Column:
    """Visible text of markup: no scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def html_language(html: Column) -> Column:
    found = F.lower(F.regexp_extract(html, r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def url_language(url: Column) -> Column:
    """The language of the address: that of its country suffix, else a two-letter first path segment."""
    suffix = F.lower(F.regexp_extract(url_host(url), r"\.([a-z]{2})$", 1))
    known = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    path = F.lower(F.regexp_extract(url, r"^[^?#]*?//[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return F.coalesce(F.try_element_at(known, suffix), F.when(path != "", path))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _witness(values: list, langs: list[str], right: float) -> np.ndarray:
    """Log likelihoods of a named language; names of no known class and missing ones are no evidence."""
    out = np.zeros((len(values), len(langs)))
    at = {x: k for k, x in enumerate(langs[:-1])}
    wrong = np.log((1 - right) / max(1, len(langs) - 2))
    for i, v in enumerate(values):
        if v in at:
            out[i, :-1] = wrong
            out[i, -1] = np.log(1 / max(1, len(langs) - 1))
            out[i, at[v]] = np.log(right)
    return out


def detect(docs: DataFrame, model: Model, *, text: Column, declared: Column | None = None, address: Column | None = None, host: Column | None = None) -> DataFrame:
    """``docs`` with language, posterior, accepted and text_language (by the text alone)."""
    new = ["language", "posterior", "accepted", "text_language"]
    docs = docs.drop(*new)
    none = F.lit(None).cast("string")
    host = none if host is None else host
    domain = F.coalesce(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit(""))
    domain = F.when(domain == "", host).otherwise(domain)
    given = [F.coalesce(text, F.lit("")).alias("t"), (none if declared is None else F.lower(declared)).alias("d"), (none if address is None else address).alias("a"), F.coalesce(host, F.lit("")).alias("h"), F.coalesce(domain, F.lit("")).alias("m")]
    width = len(docs.columns)
    base = docs.select("*", *given).toDF(*[f"c{i}" for i in range(width)], "t", "d", "a", "h", "m")
    langs, sent = model.langs, docs.sparkSession.sparkContext.broadcast(model)
    k = len(langs)

    def of_text(t):
        score, has = sent.value.score(*K.column_bytes(t))
        return score, has, _softmax(score) * has[:, None]

    def soft(batches):
        for batch in batches:
            _, _, p = of_text(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(p[:, i]) for i in range(k))], names=["h", "m", *(f"p{i}" for i in range(k))])
        K.trim()

    counts = base.select("t", "h", "m").mapInArrow(soft, "h string, m string, " + ", ".join(f"p{i} double" for i in range(k)))
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]
    hosts = saved(counts.groupBy("h", "m").agg(*sums), "hosts")
    domains = hosts.groupBy("m").agg(*[F.sum(f"p{i}").alias(f"m{i}") for i in range(k)])
    whole = hosts.agg(*sums).first()
    flat = np.array([whole[i] or 0.0 for i in range(k)])
    flat = (flat + 1) / (flat.sum() + k)
    flat[-1] = UNKNOWN_PRIOR
    n_m = sum((F.col(f"m{i}") for i in range(k)), F.lit(0.0))
    of_domain = [(F.col(f"m{i}") + SMOOTH * float(flat[i])) / (n_m + SMOOTH) for i in range(k)]
    prior = hosts.join(domains, "m").select("h", F.array(*[F.col(f"p{i}") for i in range(k)]).alias("seen"), F.array(*[x * SMOOTH for x in of_domain]).alias("smooth"))
    joined = base.drop("m").join(saved(prior, "host-priors"), "h", "left").select(*base.columns[: width + 3], "seen", "smooth")

    def fuse(batches):
        for batch in batches:
            score, has, own = of_text(batch.column(width))
            more = _witness(batch.column(width + 1).to_pylist(), langs, DECLARED_RIGHT) + _witness(batch.column(width + 2).to_pylist(), langs, SUFFIX_RIGHT)
            seen, smooth = (np.array(batch.column(width + i).to_pylist(), np.float64).reshape(len(batch), k) for i in (3, 4))
            p = np.maximum(seen - own, 0.0) + smooth
            post = _softmax(score + more + np.log(p / p.sum(axis=1, keepdims=True)))
            best = post.argmax(axis=1)
            best[~has] = k - 1
            top = np.where(has, post[np.arange(len(post)), best], 1.0)
            cols = [pa.array([langs[i] for i in best], pa.string()), pa.array(top), pa.array((best < k - 1) & (top >= MIN_POSTERIOR)), pa.array([langs[i] if h else "und" for i, h in zip(score.argmax(axis=1), has, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *cols], names=[*batch.schema.names[:width], *new])
        K.trim()

    fields = with_fields(base.select(*base.columns[:width]), "language string, posterior double, accepted boolean, text_language string")
    return joined.mapInArrow(fuse, fields).toDF(*docs.columns, *new)


def detect_documents(docs: DataFrame) -> DataFrame:
    """``documents``: the lang column trains the text model or, in rows that do not, is the declaration; the source stands for the host."""
    model = fit(docs)
    return detect(docs, model, text=F.col("text"), declared=F.when(label_hash("text", "lang") > model.cut, F.col("lang")), host=F.col("source"))


def detect_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """``pages``: markup, its declared language, and the address; the text model comes from labelled documents."""
    return detect(pages, fit(labelled), text=html_text(F.col("html")), declared=html_language(F.col("html")), address=url_language(F.col("url")), host=url_host(F.col("url")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "accepted", "text_language")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return out.select("page_id", "language", F.round("posterior", 6).alias("posterior"), "accepted", "text_language")
