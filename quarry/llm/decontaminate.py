"""Benchmark decontamination (operator 6).

The word windows of the benchmark (ten words; a shorter item is one window) become a broadcast hash
set. One scan of the training texts hashes every token window, looks it up, and verifies each hit
word by word; hit spans or whole documents can then be removed. No shuffle takes place.

The benchmark is broadcast in slices of at most ``slice_bytes`` of text, as arrays of some five bytes
per byte of text. A benchmark that fits one slice (the usual case) costs one scan; a larger one costs
one scan a slice, written to the shared folder before the next begins, and the hits of the slices are
united by row. So a worker holds one slice at a time, and no item is left out.

Edge cases: null and empty texts have no words and are never hit; items without words have no
window; items whose id is null hit words but are not listed; repeated items count once by id; equal items with different ids are
all listed; repeated rows are scanned each for itself; texts are scanned whole, whatever their length; an empty benchmark
hits nothing, an empty table gives no rows; columns named ``n_words``, ``hit_spans`` or ``hit_items`` are replaced, all others
carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import numbered, saved, table, with_fields

WINDOW = 10
SLICE_BYTES = 64 << 20
LOWER = K.LOWER


class Windows:
    """The word windows of benchmark items in arrays: some five bytes per byte of item text.

    ``buf`` holds the words of all items, lower-cased and one space after each; ``begin`` is where each word starts.
    Of each window length, ``keys`` are the sorted hashes of its windows, ``first`` where the windows of a key begin
    in ``at`` (word numbers). Windows of one key are sorted by their words, so equal ones stand together; ``same`` is
    the number of the run of equal ones.
    """

    def __init__(self, texts: list[str | None], ids: list, n: int = WINDOW):
        self.ids = ids
        data, off = K.column_bytes(pa.array(texts, pa.large_string()))
        bufs, sizes, count, found = [], [], [], {}
        word = 0
        for lo, hi in K.slices(off) if len(texts) else ():
            w = K.words(data, off, lo, hi)
            size = np.diff(w.first)
            flat = LOWER[w.buf]
            flat[w.ends] = 32  # the byte after a word becomes its space
            edge = np.zeros(len(flat) + 1, np.int8)
            edge[w.starts] = 1
            edge[w.ends + 1] -= 1
            bufs.append(flat[np.cumsum(edge[:-1]) > 0].tobytes())
            sizes.append(w.ends - w.starts + 1)
            count.append(size)
            for length in sorted({min(int(s), n) for s in size if s}):
                hashes, at = K.grams(w, length)
                row = np.searchsorted(w.first, at, side="right") - 1
                own = np.minimum(size[row], n) == length
                found.setdefault(length, []).append((hashes[own], (at[own] + word).astype(np.int32)))
            word += len(w.starts)
        self.buf = b"".join(bufs)
        self.begin = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64) if sizes else np.zeros(1, np.int64)
        self.item = np.cumsum(np.concatenate(count)) if count else np.zeros(0, np.int64)  # word number at which each item ends
        self.by_length = {length: self._sorted(length, *(np.concatenate(x) for x in zip(*parts, strict=True))) for length, parts in found.items()}

    def _sorted(self, length: int, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(hashes, kind="stable")
        hashes, at = hashes[order], at[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        first = np.flatnonzero(new)
        fresh = new.copy()
        last = np.append(first[1:], len(at))
        several = last - first > 1
        for i, j in zip(first[several].tolist(), last[several].tolist(), strict=True):
            words = sorted((self.words(a, length), a) for a in at[i:j].tolist())
            at[i:j] = [a for _, a in words]
            fresh[i + 1 : j] = [x[0] != y[0] for x, y in zip(words[:-1], words[1:], strict=True)]
        return hashes[first], np.append(first, len(at)).astype(np.int32), at, np.flatnonzero(fresh).astype(np.int32)

    def words(self, at: int, length: int) -> bytes:
        """``length`` words from word number ``at``, joined by spaces."""
        return self.buf[self.begin[at] : self.begin[at + length] - 1]

    def items(self, length: int, run: int) -> set:
        """Ids of the items with the windows of a run of equal ones."""
        _, _, at, runs = self.by_length[length]
        stop = runs[run + 1] if run + 1 < len(runs) else len(at)
        return {self.ids[i] for i in np.searchsorted(self.item, at[runs[run] : stop], side="right").tolist()}

    @property
    def nbytes(self) -> int:
        return len(self.buf) + self.begin.nbytes + self.item.nbytes + sum(x.nbytes for xs in self.by_length.values() for x in xs)


class Matcher:
    """Finds the windows of a slice of benchmark items in the words of texts."""

    def __init__(self, windows: Windows):
        self.windows, self.maps = windows, {}
        for length, (keys, *_) in windows.by_length.items():
            bits = min(26, max(16, len(keys).bit_length() + 4))
            seen = np.zeros(1 << bits, bool)
            seen[keys >> K.U(64 - bits)] = True
            self.maps[length] = keys, seen, K.U(64 - bits)

    def rows(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set, K.Words, int]]:
        """Per row: number of words, hit word spans (merged, half open, in the row's words), item ids, words, row in the slice."""
        for lo, hi in K.slices(off):
            w = K.words(data, off, lo, hi)
            found: dict[int, tuple[list, set]] = {}
            for length, (keys, seen, shift) in self.maps.items():
                hashes, at = K.grams(w, length)
                maybe = np.flatnonzero(seen[hashes >> shift])
                if not len(maybe):
                    continue
                h = hashes[maybe]
                pos = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[pos] == h
                at = at[maybe[hit]]
                row = np.searchsorted(w.first, at, side="right") - 1
                for k, i, r in zip(pos[hit].tolist(), at.tolist(), row.tolist(), strict=True):
                    run = self._verified(length, k, b" ".join(w.word(j) for j in range(i, i + length)))
                    if run is not None:
                        spans, runs = found.setdefault(r, ([], set()))
                        spans.append((i - int(w.first[r]), i - int(w.first[r]) + length))
                        runs.add((length, run))
            count = np.diff(w.first).tolist()
            for r in range(hi - lo):
                spans, runs = found.get(r, ((), ()))
                yield count[r], union_spans(spans), set().union(*(self.windows.items(*x) for x in runs)), w, r

    def _verified(self, length: int, key: int, words: bytes) -> int | None:
        """The run of windows of a key whose words are those of the text."""
        _, first, at, runs = self.windows.by_length[length]
        run = int(np.searchsorted(runs, first[key]))
        while run < len(runs) and runs[run] < first[key + 1]:
            if self.windows.words(int(at[runs[run]]), length) == words:
                return run
            run += 1
        return None


def _slices_of(benchmark: DataFrame, id_col: str, text_col: str, slice_bytes: int) -> Iterator[Windows]:
    """Windows of the benchmark, at most slice_bytes of its text at a time (or one item)."""
    rows, size = [], 0
    for x in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len((x.t or "").encode())
        if rows and size + n > slice_bytes:
            yield Windows([r.t for r in rows], [r.i for r in rows])
            rows, size = [], 0
        rows.append(x)
        size += n
    yield Windows([r.t for r in rows], [r.i for r in rows])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged word spans, half open) and ``hit_items`` (distinct ids as sorted strings).

    Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    at, width, plain = docs.columns.index(text_col), len(docs.columns), numbered(docs)
    out, schema = plain, with_fields(plain, "n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, hit_items array<string>")
    for k, windows in enumerate(_slices_of(benchmark, item_id_col, item_text_col, slice_bytes)):
        if k:
            out = saved(out, "scanned")
        sent = docs.sparkSession.sparkContext.broadcast(windows)

        def run(batches, sent=sent, later=k > 0):
            matcher = Matcher(sent.value)
            for batch in batches:
                data, off = K.column_bytes(batch.column(at))
                before = zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True) if later else None
                n, spans, items = [], [], []
                for count, own, ids, _, _ in matcher.rows(data, off):
                    ids = {str(i) for i in ids if i is not None}
                    if later:
                        old_spans, old_ids = next(before)
                        own, ids = union_spans([*own, *((x["start"], x["end"]) for x in old_spans)]), ids | set(old_ids)
                    n.append(count)
                    spans.append([{"start": a, "end": b} for a, b in own])
                    items.append(sorted(ids))
                more = [pa.array(n, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=[*batch.schema.names[:width], "n_words", "hit_spans", "hit_items"])
            K.trim()

        out = out.mapInArrow(run, schema)
    return out.toDF(*docs.columns, "n_words", "hit_spans", "hit_items")


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def n_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])


def remove(scanned: DataFrame, *, text_col: str = "text", drop_share: float = 0.5) -> DataFrame:
    """Cuts the hit spans out of the texts; documents hit in ``drop_share`` of their words or more go."""
    kept = scanned.where((n_hit() == 0) | (n_hit() < F.col("n_words") * drop_share))
    at, spans_at, plain = kept.columns.index(text_col), kept.columns.index("hit_spans"), numbered(kept)

    def run(batches):
        for batch in batches:
            spans = batch.column(spans_at).to_pylist()
            if any(spans):
                data, off = K.column_bytes(batch.column(at))
                texts = batch.column(at).to_pylist()
                for r, own in enumerate(spans):
                    if own:
                        texts[r] = K.words(data, off, r, r + 1).without(0, [(x["start"], x["end"]) for x in own]).decode()
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch
        K.trim()

    return plain.mapInArrow(run, plain.schema).toDF(*kept.columns).drop("n_words", "hit_spans", "hit_items")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (
  SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
