"""Near-duplicate documents (operator 7): DartMinHash signatures and banded joining.

Terms are five-word shingles weighted by how often they occur. Darts are a Poisson process of unit
rate over (weight, rank) for each term, a function of the term's hash alone; a text owns the darts
below the weight of its terms. Space is cut into regions of area one: weights in
[2^v - 1, 2^(v+1) - 1) by ranks of height 2^-v, each with a Poisson(1) number of hashed darts. Only
regions under a rank limit are opened, chosen so that about ``T (ln T + 4)`` darts hit, whatever
the length of the text; texts with an empty coordinate double their limit. Each dart belongs to a hashed
coordinate, and the earliest dart of each coordinate is the signature: two texts agree in a coordinate with
the probability of their weighted Jaccard similarity.

Texts meet in a band when ROWS consecutive coordinates agree. A pair at 0.8 misses all 30 bands with
a probability of 7e-6. Every pair of texts that share a bucket is verified by its exact weighted Jaccard
similarity. The pairs of buckets of up to PAIRED texts are enumerated. Larger buckets are cut
into blocks of about BLOCK texts, and two blocks at a time are compared within one task by matrix products,
which returns the number of links of each text and a spanning forest of the links, not the links: of n texts
with n**2 links some n**2 / BLOCK rows leave the tasks. A pair of several buckets counts in one of them only.
Classes are connected components of the links.

Equal texts are one text from the start (64 bits of SHA-256). Edge cases: null and empty texts and
texts without words have no shingle and only group with equal texts; texts of one to four words are
one shingle; texts are taken whole, whatever their length; rows that repeat an id keep one output row each; a similarity of
exactly the threshold counts; an empty table gives no rows. ``near_duplicates`` ignores other columns, ``deduplicate``
carries them, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import numbered, saved, table, text_key

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 30, 5
PAIRED, BLOCK, COLUMNS = 32, 384, 4096
U = np.uint64


def shingles(data: np.ndarray, off: np.ndarray, lo: int, hi: int, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the shingles of rows lo..hi, sorted by row and hash."""
    w = K.words(data, off, lo, hi)
    hashes, at = K.grams(w, n)
    rows = np.searchsorted(w.first, at, side="right") - 1
    size = np.diff(w.first)
    for k in range(1, n):  # texts shorter than a shingle
        short = np.flatnonzero(size == k)
        if len(short):
            acc = np.full(len(short), k, U)
            for j in range(k):
                acc = K.mix(acc + w.hashes[w.first[short] + j])
            hashes, rows = np.concatenate([hashes, acc]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], hashes[first], np.diff(np.append(first, len(rows)))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_POISSON_U = (_POISSON * 2.0**32).astype(np.uint64)


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def signatures(rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, t: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(n_rows x t ids of the earliest darts, rows that have terms)."""
    sig = np.zeros((n_rows, t), U)
    total = np.bincount(rows, weights, n_rows)
    has = total > 0
    limit = np.divide(t * (math.log(t) + 4), total, out=np.zeros(n_rows), where=has)
    todo = has.copy()
    weights = weights.astype(np.float64)
    while todo.any():
        own = todo[rows]
        filled = _throw(sig, rows[own], terms[own], weights[own], limit, t)
        todo &= ~filled
        limit[todo] *= 2
    return sig, has


def _throw(sig, rows, terms, weights, limit, t) -> np.ndarray:
    keys, ranks, ids = [], [], []
    v = 0
    while len(rows):
        height = 2.0**-v
        cells = np.ceil(limit[rows] / height).astype(np.int64)
        who = np.repeat(np.arange(len(rows)), cells)
        cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = K.mix(terms[who] + K.mix(cell.astype(U) * U(64) + U(v + 1)))
        count = np.searchsorted(_POISSON_U, seed >> U(32), side="right")
        dart = np.repeat(np.arange(len(who)), count)
        j = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        h = K.mix(seed[dart] + (j + 1).astype(U) * U(0x9E3779B97F4A7C15))
        at = (1 << v) - 1 + _unit(h) / height
        rank = (cell[dart] + _unit(K.mix(h ^ U(0xA5A5A5A5)))) * height
        own = who[dart]
        keep = (at < weights[own]) & (rank < limit[rows[own]])
        h, own = h[keep], rows[own[keep]]
        keys.append(own * t + (K.mix(h ^ U(0x5C5C5C5C5C)) % U(t)).astype(np.int64))
        ranks.append(rank[keep])
        ids.append(h)
        v += 1
        more = weights > (1 << v) - 1  # terms that reach into the next region of weights
        rows, terms, weights = rows[more], terms[more], weights[more]
    key, rank, ident = (np.concatenate(x) for x in (keys, ranks, ids))
    late = np.argsort(-rank, kind="stable")
    full = np.zeros(sig.size, bool)
    full[key] = True
    sig.ravel()[key[late]] = ident[late]  # the earliest is written last
    return full.reshape(sig.shape).all(axis=1)


def text_id(text_col: str = "text"):
    """The first 64 bits of the text's SHA-256."""
    return F.conv(F.substring(text_key(text_col), 1, 16), 16, -10).cast("bigint")


def band_keys(texts: DataFrame, *, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(key, tid) per band of each text (tid, text); keys of different bands differ."""

    def run(batches):
        for batch in batches:
            data, off = K.column_bytes(batch.column(1))
            tid = batch.column(0).to_numpy()
            for lo, hi in K.slices(off, 1 << 18, 128):  # short texts need as many darts as long ones
                r, h, w = shingles(data, off, lo, hi, shingle)
                sig, has = signatures(r, h, w, hi - lo, bands * rows)
                keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (hi - lo, bands)).copy()
                for j in range(rows):
                    keys = K.mix(keys + sig[:, j::rows])
                own = np.repeat(tid[lo:hi][has], bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys[has].ravel().view(np.int64)), pa.array(own)], names=["key", "tid"])
        K.trim()

    return texts.select("tid", "text").mapInArrow(run, "key bigint, tid bigint")


def mates(keys: DataFrame) -> DataFrame:
    """(key, tid, n): the distinct texts of each bucket of n > 1 texts."""
    keys = saved(keys.distinct(), "distinct-bands")
    sizes = saved(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")  # a table, so that the join can split a large bucket
    return saved(keys.join(sizes.hint("merge"), "key").select("key", "tid", "n"), "mates")


def candidate_pairs(found: DataFrame, *, paired: int = PAIRED) -> DataFrame:
    """Distinct (a, b), a < b: all pairs of the buckets of up to ``paired`` texts."""
    small = found.where(F.col("n") <= paired).groupBy("key").agg(F.sort_array(F.collect_list("tid")).alias("ts"))
    first = small.select("ts", F.posexplode("ts").alias("i", "a"))
    return first.select("a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b")).distinct()


def _weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if len(a[0]) == 0 and len(b[0]) == 0:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def profiles(texts: DataFrame, *, shingle: int = SHINGLE) -> DataFrame:
    """(tid, terms, counts, large) of (tid, text, large): sorted hashes and weights of the shingles as bytes."""

    def profile(batches):
        for batch in batches:
            data, off = K.column_bytes(batch.column(1))
            for lo, hi in K.slices(off):
                r, h, w = shingles(data, off, lo, hi, shingle)
                cut = np.searchsorted(r, np.arange(hi - lo + 1)).tolist()
                terms = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                counts = [w[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), batch.column(2).slice(lo, hi - lo)], names=["tid", "terms", "counts", "large"])
        K.trim()

    return saved(texts.select("tid", "text", "large").mapInArrow(profile, "tid bigint, terms binary, counts binary, large array<bigint>"), "shingles")


def verify(pairs: DataFrame, prof: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of the pairs that share no large bucket and whose exact weighted Jaccard similarity reaches the threshold."""
    left = prof.select(F.col("tid").alias("a"), F.col("terms").alias("ta"), F.col("counts").alias("ca"), F.col("large").alias("la"))
    right = prof.select(F.col("tid").alias("b"), F.col("terms").alias("tb"), F.col("counts").alias("cb"), F.col("large").alias("lb"))
    wide = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(~F.coalesce(F.arrays_overlap("la", "lb"), F.lit(False))).select("a", "b", "ta", "ca", "tb", "cb")

    def check(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            sim = [_weighted_jaccard((np.frombuffer(ta, U), np.frombuffer(ca, "<u4")), (np.frombuffer(tb, U), np.frombuffer(cb, "<u4"))) for ta, ca, tb, cb in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            keep = pa.array([s >= threshold for s in sim], pa.bool_())
            yield pa.RecordBatch.from_arrays([a, b, pa.array(sim, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    return wide.mapInArrow(check, "a bigint, b bigint, similarity double")


def _product(own: np.ndarray, col: np.ndarray, cut: int, n: int, step: np.ndarray | None = None) -> np.ndarray:
    """Rows before ``cut`` by the others: the sum of ``step`` (or 1) over the columns that two rows of (own, col) share. col is sorted."""
    out = np.zeros((cut, n - cut))
    width = int(col[-1]) + 1 if len(col) else 0
    for lo in range(0, width, COLUMNS):
        size = min(COLUMNS, width - lo)
        i, j = np.searchsorted(col, [lo, lo + size])
        dense = np.zeros((n, size))
        dense[own[i:j], col[i:j] - lo] = 1.0
        out += (dense[:cut] * step[lo : lo + size] if step is not None else dense[:cut]) @ dense[cut:].T
    return out


def _overlaps(terms: list[np.ndarray], counts: list[np.ndarray], cut: int) -> np.ndarray:
    """Sums of the smaller weights of the texts before ``cut`` with each of the others.

    The smaller of two weights is the sum of the steps between the weights of a term that both reach.
    """
    n = len(terms)
    own, h, w = np.repeat(np.arange(n), [len(x) for x in terms]), np.concatenate(terms), np.concatenate(counts).astype(np.int64)
    _, term, freq = np.unique(h, return_inverse=True, return_counts=True)
    shared = freq[term] > 1
    own, term, w = own[shared], term[shared], w[shared]
    order = np.lexsort((w, term))
    own, term, w = own[order], term[order], w[order]
    if not len(w):
        return np.zeros((cut, n - cut))
    fresh = np.concatenate(([True], term[1:] != term[:-1]))
    new = fresh | np.concatenate(([True], w[1:] != w[:-1]))
    level = np.cumsum(new) - 1
    value, first = w[new], fresh[new]
    step = np.where(first, value, value - np.concatenate(([0], value[:-1]))).astype(np.float64)
    lowest = np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))[level]
    reach = level - lowest + 1  # a weight reaches its own level and those below
    total = np.cumsum(reach)
    col = np.repeat(level + 1 - total, reach) + np.arange(total[-1])
    own = np.repeat(own, reach)
    order = np.argsort(col, kind="stable")
    return _product(own[order], col[order], cut, n, step)


def _forest(link: np.ndarray, cut: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows and columns; the columns follow the rows, or are the same texts."""
    n = cut if same else sum(link.shape)
    near = np.zeros((n, n), bool)
    if same:
        near |= link | link.T
    else:
        near[:cut, cut:], near[cut:, :cut] = link, link.T
    left, out = near.any(axis=1), []
    for start in np.flatnonzero(left).tolist():
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            out += [(at, x) for x in new.tolist()]
            todo += new.tolist()
    return out


def block_links(found: DataFrame, prof: DataFrame, *, threshold: float = THRESHOLD, paired: int = PAIRED, block: int = BLOCK) -> DataFrame:
    """(a, b, n) from all pairs of buckets of more than ``paired`` texts: for a = b the number of links of text a in a pair of blocks, else (with null) links that span the rest.

    Of the large buckets that two texts share the one with the smallest key has their link.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = found.where(F.col("n") > paired).select("key", "tid", blocks.alias("m"), F.pmod(F.xxhash64("tid", "key"), blocks).cast("int").alias("own"))
    rows = rows.select("key", "tid", "own", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other"))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "tid")
    wide = rows.join(prof.hint("merge"), "tid").select("key", "i", "j", "right", "tid", "terms", "counts", "large").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "right", "tid")

    def cell(key, i, j, rows):
        tid = np.array([r[0] for r in rows], np.int64)
        terms, counts = [np.frombuffer(r[1], U) for r in rows], [np.frombuffer(r[2], "<u4") for r in rows]
        n, cut = len(rows), sum(not r[4] for r in rows)
        before = [np.array([k for k in r[3] if k < key], np.int64) for r in rows]
        if i == j:
            terms, counts, before, n = terms * 2, counts * 2, before * 2, 2 * n
        if not 0 < cut < n:
            return []
        sums = np.array([int(c.sum()) for c in counts], np.float64)
        low = _overlaps(terms, counts, cut)
        link = low / (sums[:cut, None] + sums[None, cut:] - low) >= threshold
        if i == j:
            link &= ~np.eye(cut, dtype=bool)
        who, key_ = np.repeat(np.arange(n), [len(x) for x in before]), np.concatenate(before)
        if len(key_):
            col = np.unique(key_, return_inverse=True)[1]
            order = np.argsort(col, kind="stable")
            link &= _product(who[order], col[order], cut, n) == 0
        count = link.sum(axis=1) if i == j else np.concatenate((link.sum(axis=1), link.sum(axis=0)))
        out = [(t, t, c) for t, c in zip(tid.tolist(), count.tolist(), strict=True) if c]
        return out + [(int(tid[x]), int(tid[y]), None) for x, y in _forest(link, cut, i == j)]

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for key, i, j, right, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (key, i, j):
                    yield from emit(now, rows)
                    now, rows = (key, i, j), []
                rows.append((*rest, right))
        yield from emit(now, rows)
        K.trim()

    def emit(now, rows):
        if rows and (out := cell(*now, rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "n"])

    return wide.mapInArrow(run, "a bigint, b bigint, n bigint")


def text_links(docs: DataFrame, *, text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the ids of different texts that connect all classes, and (tid, n_links): how many verified links a text has."""
    # the joins are told to sort and merge, so that small inputs run the plan that large ones need
    base = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tid", text_id("text"))
    found = mates(band_keys(base, bands=bands, rows=rows, shingle=shingle))
    pairs = saved(candidate_pairs(found), "pairs")
    wanted = found.groupBy("tid").agg(F.collect_list(F.when(F.col("n") > PAIRED, F.col("key"))).alias("large"))
    texts = base.groupBy("tid").agg(F.first("text").alias("text")).join(wanted.hint("merge"), "tid")
    prof = profiles(texts, shingle=shingle)
    links = saved(verify(pairs, prof, threshold=threshold), "links")
    blocks = saved(block_links(found, prof, threshold=threshold), "block-links")
    single = links.select(F.explode(F.array("a", "b")).alias("tid"), F.lit(1).cast("long").alias("n"))
    degree = single.union(blocks.where("a = b").select("a", "n")).groupBy("tid").agg(F.sum("n").alias("n_links"))
    return links.select("a", "b").union(blocks.where("a <> b").select("a", "b")), degree


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: its id, tid, root (of the class), class_id (smallest id in the class), class_size, n_links (verified links of its text)."""
    links, degree = text_links(docs, text_col=text_col, **options)
    roots = components(links)
    info = saved(roots.withColumnRenamed("id", "tid").join(degree, "tid", "left"), "classes-of-texts")
    rows = docs.select(F.col(id_col), text_id(text_col).alias("tid")).join(info, "tid", "left")
    rows = saved(rows.select(id_col, "tid", F.coalesce("root", "tid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "members")
    classes = saved(rows.groupBy("root").agg(F.min(id_col).alias("class_id"), F.count("*").alias("class_size")), "classes")
    return rows.join(classes, "root").select(id_col, "tid", "root", "class_id", "class_size", "n_links")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (a null id only if there is no other; of equal ids any)."""
    plain, ident, text = numbered(docs), f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    found = near_duplicates(plain.select(ident, text), id_col=ident, text_col=text, **options)
    keep = found.where(F.col(ident).eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("tid").alias("tid"), F.first("class_id").alias("keep"))
    wide = plain.withColumn("tid", text_id(text)).join(keep.select("tid", "keep"), "tid").where(F.col(ident).eqNullSafe(F.col("keep")))
    return wide.dropDuplicates(["tid"]).select(*plain.columns).toDF(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")
