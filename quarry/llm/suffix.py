"""Suffix-array deduplication (operator 1): every byte inside a string of 400 bytes that also starts elsewhere.

The decision is made on Burrows-Wheeler transforms of bounded buckets. Breadth-first backward extension of
intervals derives the common prefixes of neighbouring suffixes by increasing value and stops at the
minimum length: neighbours still open then share at least that many bytes.

To bring equal strings into one bucket, each window of LENGTH bytes names its anchor, the K-byte
string in it with the smallest hash (leftmost of equals). Equal windows have equal anchors at equal
places. Consecutive windows with one anchor form a segment, so every window lies in exactly one
segment, and a text has about one segment per 150 bytes.

1. Segments are counted by a 128-bit hash of their bytes. A segment that occurs twice is repeated as
   a whole, in all its windows; copies of texts and the inside of popular passages collapse here by partial
   aggregation, however often they occur. (No transform could see such a group whole: it has no bound.)
2. Different segments that share an anchor go to the same bucket, one representative each.
   Buckets of many anchors are packed to about BUCKET bytes, and the transform decides their windows.
3. The segments of an anchor that are over LARGE bytes together are divided first, as often as needed: windows by the
   number of bytes that they have before the anchor, in classes of 50, then of 7, then of 1. Windows of one class
   can only be equal if their segments agree on all the bytes that every window of the class has, so these bytes are the
   key of a smaller bucket, which holds the segments cut to the class. Segments that are equal
   when cut collapse as in step 1; buckets of up to LARGE bytes go to the transform; others are divided again. At
   a class of one window the key is the window, so nothing is left. No bucket is larger, whatever the input.

Edge cases: null texts are empty; texts under LENGTH bytes keep all bytes; texts of any length are taken whole; rows with
equal texts (whatever their ids, null ids too) are occurrences of each other, so both lose all bytes that LENGTH
windows cover; matches never cross texts; zero bytes are ordinary bytes; an empty table gives no rows; columns named
``removed``, ``n_bytes`` or ``kept`` are replaced, all others are carried, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import numbered, saved, table, text_key, with_fields

LENGTH, ANCHOR, BUCKET, LARGE = 400, 100, 3 << 16, 1 << 20
#: Windows of a class, by round of division.
CLASSES = (50, 7, 1)
#: Steps in which the surroundings of an anchor are compared before a bucket is transformed.
STEPS = 6
U = np.uint64
_PLACE = U((1 << 31) - 1)


def text_ids(col: str = "text"):
    """96 bits of the text's SHA-256, as a long and an int."""
    key = text_key(col)
    return F.conv(F.substring(key, 1, 16), 16, -10).cast("bigint").alias("t"), F.conv(F.substring(key, 17, 7), 16, 10).cast("int").alias("u")


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(v) - w + 1
    blocks = -(-len(v) // w)
    x = np.full(blocks * w, np.iinfo(np.uint64).max, U)
    x[: len(v)] = v
    x = x.reshape(blocks, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """(row, first window, number of windows, anchor hash, place of the anchor in the segment) of the segments of rows."""
    size = np.diff(off)
    if not len(data) or size.max() < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U), np.zeros(0, np.int64))
    n = len(data)
    pw, ip = K.powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(K.BYTE_CODE[data] * pw[:n], out=sums[1:])
    h = K.mix((sums[k:] - sums[:-k]) * ip[: n - k + 1])
    place = window_minima((h & ~_PLACE) | np.arange(len(h), dtype=U), length - k + 1) & _PLACE
    row = np.repeat(np.arange(len(size)), size)[: len(place)]
    valid = np.arange(len(place)) + length <= off[row + 1]
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    at = place[first].astype(np.int64)
    return row[first], first - off[row[first]], stop - first, h[at], at - first


def _segment_rows(texts: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, off = K.column_bytes(batch.column(2))
            t, u = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in K.slices(off):
                own = data[off[lo] : off[hi]]
                row, start, count, anchor, at = segments(own, off[lo : hi + 1] - off[lo], length, k)
                if not len(row):
                    continue
                begin = off[lo:hi][row] - off[lo] + start
                size = count + length - 1
                raw = memoryview(own)
                digest = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t[lo:hi][row]), pa.array(u[lo:hi][row]), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(anchor.view(np.int64)), pa.array(at.astype(np.int32))],
                    names=["t", "u", "start", "size", "s1", "s2", "anchor", "at"],
                )
        K.trim()

    return texts.mapInArrow(run, "t bigint, u int, start int, size int, s1 bigint, s2 bigint, anchor bigint, at int")


# -- the transform -------------------------------------------------------------------------------


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of x (values 0..256) by their first ``depth`` values or more, by prefix doubling."""
    n = len(x)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key <<= 9
        key[: n - j] |= x[j:] if j else x
    have = 7
    while True:
        order = np.argsort(key, kind="stable")
        own = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - have] += rank[have:] + 1
        have *= 2


def long_repeats(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, the places at which a string of ``length`` bytes starts that also starts elsewhere in the parts."""
    sizes = np.array([len(p) + 1 for p in parts])
    begin = np.cumsum(sizes) - sizes
    x = np.zeros(int(sizes.sum()), np.int64)
    for b, p in zip(begin.tolist(), parts, strict=True):
        x[b : b + len(p)] = np.frombuffer(p, np.uint8)
        x[b : b + len(p)] += 1  # 0 ends a part
    n = len(x)
    sa = suffix_array(x, length)
    open_ = expand(x[sa - 1], length)  # open_[i]: neighbours i-1 and i share `length` values or more
    part_end = np.repeat(begin + sizes - 1, sizes)
    fits = sa + length <= part_end[sa]
    same = open_[:n] & fits
    same[1:] &= fits[:-1]
    hit = same.copy()
    hit[:-1] |= same[1:]
    starts = np.sort(sa[hit])
    cut = np.searchsorted(starts, np.append(begin, n))
    return [starts[a:b] - base for a, b, base in zip(cut[:-1].tolist(), cut[1:].tolist(), begin.tolist(), strict=True)]


def expand(bwt: np.ndarray, length: int) -> np.ndarray:
    """Breadth-first backward extension from the empty string, stopped at ``length``.

    The interval of a string w yields the intervals of cw for each value c before it. In the round
    of strings of size v, the entry after the end of a new interval gets the common prefix v, if it
    has none yet; intervals that set no entry are not extended. Entries open after ``length`` rounds
    have a common prefix of at least ``length``.
    """
    n = len(bwt)
    by_value = np.argsort(bwt.astype(np.int16), kind="stable")
    last = np.empty(n, np.int64)
    last[by_value] = np.arange(n)  # place before which each value moves (the LF map)
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    values, counts = np.unique(bwt, return_counts=True)
    where = np.split(by_value, np.cumsum(counts)[:-1])  # places of each value, ascending
    base = np.cumsum(counts) - counts
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        nlo, nhi = [], []
        one = lo == hi
        nlo.append(last[lo[one]])
        nhi.append(nlo[0])
        size = hi - lo + 1
        few = ~one & (size <= 24)
        if few.any():
            a, m = lo[few], size[few]
            place = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            key = np.repeat(np.arange(len(a)), m) * 257 + bwt[place]
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            edge = np.flatnonzero(key[1:] != key[:-1])
            nlo.append(last[place[np.concatenate(([0], edge + 1))]])
            nhi.append(last[place[np.append(edge, len(place) - 1)]])
        many = ~one & ~few
        if many.any():
            a, b = lo[many], hi[many] + 1
            for c in range(len(values)):
                i, j = np.searchsorted(where[c], a), np.searchsorted(where[c], b)
                own = j > i
                nlo.append(base[c] + i[own])
                nhi.append(base[c] + j[own] - 1)
        lo, hi = np.concatenate(nlo), np.concatenate(nhi)
        own = open_[hi + 1]
        lo, hi = lo[own], hi[own]
        open_[hi + 1] = False
        if not len(lo):
            break
    return open_


def _runs(starts: np.ndarray, length: int) -> list[dict]:
    """Byte ranges that windows at ``starts`` cover, one per run of consecutive starts."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b) + length} for a, b in zip(starts[np.concatenate(([0], edge + 1))], starts[np.append(edge, len(starts) - 1)], strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_FOUND = "s1 bigint, s2 bigint, spans array<struct<a:int,b:int>>"


def _surroundings(at: int, raw: bytes, length: int, anchor: int) -> list[tuple[int, bytes]]:
    """STEPS strings around the anchor of a segment, as far as they lie in it.

    Two windows are equal only if their segments agree on l bytes before and r bytes after the
    anchor with l + r >= length - anchor; for one of the STEPS splits, l and r are then at least
    i and STEPS - 1 - i steps, and the segments share that string.
    """
    step = max(1, (length - anchor) // STEPS)
    ends = [(i, at - i * step, at + anchor + (STEPS - 1 - i) * step) for i in range(STEPS)]
    return [(i, raw[lo:hi]) for i, lo, hi in ends if lo >= 0 and hi <= len(raw)]


def _alike(rows: list, length: int, anchor: int) -> list:
    """Of the segments of one anchor those that share a string around it with another."""
    keys, count = [_surroundings(r[3], r[-1], length, anchor) for r in rows], {}
    for own in keys:
        for x in own:
            count[x] = count.get(x, 0) + 1
    return [r for r, own in zip(rows, keys, strict=True) if any(count[x] > 1 for x in own)]


def _by_transform(parts: DataFrame, length: int, k: int) -> DataFrame:
    """Decides segments (bucket, s1, s2, n, at, shift, bytes), packed to buckets of whole ones; spans begin at ``shift``."""

    def decide(rows):
        hits = long_repeats([r[-1] for r in rows], length)
        out = [(r[0], r[1], _runs(h + r[4], length)) for r, h in zip(rows, hits, strict=True) if r[2] == 1 and len(h)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], _SPANS)], names=["s1", "s2", "spans"])

    def run(batches):
        bucket, group, size, now = [], [], 0, None

        def close():
            nonlocal size
            own = _alike(group, length, k)
            if any(r[2] == 1 for r in own):
                bucket.extend(own)
                size += sum(len(r[-1]) for r in own)
            group.clear()

        for batch in batches:
            for key, *r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    close()
                    if size >= BUCKET:
                        yield decide(bucket)
                        bucket.clear()
                        size = 0
                now = key
                group.append(r)
        close()
        if bucket:
            yield decide(bucket)
        K.trim()

    ordered = parts.select("bucket", "s1", "s2", "n", "at", "shift", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, _FOUND)


def _classes(at: int, size: int, first: int, count: int, width: int, length: int, k: int) -> list[tuple[int, int, int, int, int]]:
    """Classes of the windows of a segment: (number, begin and end of the key, begin and end of the segment cut to the class).

    A class holds the windows with first + number * width bytes before the anchor, or up to width - 1 more; only
    windows with first..first + count - 1 bytes before it are asked for.
    """
    least, most = max(first, at - (size - length), 0), min(first + count - 1, at, length - k)
    out = []
    for c in range((least - first) // width, (most - first) // width + 1) if least <= most else ():
        lo, hi = first + c * width, min(first + (c + 1) * width, first + count) - 1
        out.append((lo, at - lo, at + length - hi, at - min(hi, most), at + length - max(lo, least)))
    return out


def _divided(items: DataFrame, width: int, length: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(decided spans, smaller items with the bytes of their buckets as ``total``) of items (bucket, s1, s2, n, at, shift, first, count, bytes).

    ``count`` windows are asked for, from those with ``first`` bytes before the anchor. ``n`` over 1 marks segments that others may equal, but that are decided.
    """
    names = ["s1", "s2", "shift", "n", "first", "k1", "k2", "d1", "d2", "a", "b"]
    hashed = lambda *x: np.frombuffer(hashlib.blake2b(x[-1], digest_size=16, key=" ".join(map(str, x[:-1])).encode()).digest(), np.int64).tolist()

    def keys(batches):
        for batch in batches:
            out = []
            for bucket, s1, s2, n, at, shift, first, count, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for lo, ka, kb, a, b in _classes(at, len(raw), first, count, width, length, k):
                    out.append((s1, s2, shift, n, lo, *hashed(bucket, lo, raw[ka:kb]), *hashed(at - a, raw[a:b]), a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)
        K.trim()

    columns = ["bucket", "s1", "s2", "n", "at", "shift", "first", "count", "bytes"]
    own = saved(items.select(*columns).mapInArrow(keys, ", ".join(f"{c} bigint" for c in names)), "classes")
    alike = own.groupBy("k1", "k2", "d1", "d2").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.min(F.struct("s1", "s2", "shift", "first", "a", "b")).alias("x"))
    alike = saved(alike, "alike-classes")
    same = alike.where("c > 1").select("k1", "k2", "d1", "d2")
    decided = own.where("n = 1").join(same, ["k1", "k2", "d1", "d2"]).select("s1", "s2", F.array(F.struct((F.col("a") + F.col("shift")).cast("int").alias("a"), (F.col("b") + F.col("shift")).cast("int").alias("b"))).alias("spans"))
    open_ = (F.col("c") == 1) & (F.col("n") == 1)
    buckets = alike.groupBy("k1", "k2").agg(F.count("*").alias("kinds"), F.count_if(open_).alias("open"), F.sum(F.col("x.b") - F.col("x.a")).alias("total")).where("kinds > 1 AND open > 0")
    wanted = alike.join(saved(buckets.select("k1", "k2", "total"), "class-buckets"), ["k1", "k2"])
    wanted = wanted.select(F.xxhash64("k1", "k2").alias("bucket"), "x.s1", "x.s2", "x.shift", F.when(open_, 1).otherwise(2).cast("long").alias("n"), "x.first", "x.a", "x.b", "total")
    parts = items.select("s1", "s2", "shift", "at", "bytes").join(wanted, ["s1", "s2", "shift"]).where("first <= at")
    cut = F.substring("bytes", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    return decided, parts.select("bucket", "s1", "s2", "n", (F.col("at") - F.col("a")).alias("at"), (F.col("shift") + F.col("a")).alias("shift"), "first", F.lit(width).cast("long").alias("count"), "total", cut.alias("bytes"))


def _decided(parts: DataFrame, length: int, k: int, large: int) -> DataFrame:
    """(s1, s2, spans) of parts (bucket, s1, s2, n, at, total, bytes): by transforms, of divided buckets where they are over ``large`` bytes."""
    items = parts.withColumn("shift", F.lit(0).cast("long")).withColumn("first", F.lit(0).cast("long")).withColumn("count", F.lit(length - k + 1).cast("long"))
    out = _by_transform(items.where(F.col("total") <= large), length, k)
    for width in CLASSES:
        items = items.where(F.col("total") > large)
        if items.isEmpty():
            break
        decided, items = _divided(items, width, length, k)
        items = saved(items, "class-parts")
        out = out.union(decided).union(_by_transform(items.where((F.col("total") <= large) if width > 1 else F.lit(True)), length, k))
    return out


# -- the operator --------------------------------------------------------------------------------


def repeated(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, large: int = LARGE) -> DataFrame:
    """(t, u, spans): for each distinct text with repeats, the byte ranges that they cover (may overlap)."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    base = docs.select(text).select(*text_ids("text"), "text")
    segs = saved(_segment_rows(base, length, anchor), "all-segments")
    distinct = saved(segs.groupBy("s1", "s2", "anchor").agg(F.count("*").alias("n"), F.first("t").alias("t"), F.first("start").alias("start"), F.first("size").alias("size"), F.first("at").alias("at")), "segments")
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least"), F.sum("size").alias("total")).where("kinds > 1 and least = 1")
    wanted = distinct.join(saved(shared.select("anchor", "total"), "shared-anchors"), "anchor")
    texts = base.groupBy("t", "u").agg(F.first("text").alias("text"))
    asked = wanted.groupBy("t").agg(F.collect_list(F.struct("start", "size", "s1", "s2", "n", "anchor", "total", "at")).alias("asked"))

    def cut(batches):
        for batch in batches:
            raw = batch.column(0).cast(pa.binary())
            out = []
            for row, ask in zip(raw, batch.column(1).to_pylist(), strict=True):
                view = memoryview(row.as_buffer())
                for a in ask:
                    part = bytes(view[a["start"] : a["start"] + a["size"]])
                    if hashlib.blake2b(part, digest_size=16).digest() == np.array([a["s1"], a["s2"]], np.int64).tobytes():
                        out.append((a["anchor"], a["total"], a["s1"], a["s2"], a["n"], a["at"], part))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], names=["bucket", "total", "s1", "s2", "n", "at", "bytes"])
        K.trim()

    parts = saved(texts.join(asked, "t").select("text", "asked").mapInArrow(cut, "bucket bigint, total bigint, s1 bigint, s2 bigint, n bigint, at bigint, bytes binary"), "parts")
    whole = distinct.where("n > 1").select("s1", "s2", F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("b"))).alias("spans"))
    found = saved(_decided(parts, length, anchor, large).union(whole), "repeats")
    placed = segs.select("t", "u", "start", "s1", "s2").join(found, ["s1", "s2"])
    span = F.explode("spans")
    placed = placed.select("t", "u", "start", span.alias("x")).select("t", "u", F.struct((F.col("start") + F.col("x.a")).alias("a"), (F.col("start") + F.col("x.b")).alias("b")).alias("x"))
    return placed.groupBy("t", "u").agg(F.collect_set("x").alias("spans"))


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with removed (merged byte ranges), n_bytes, and kept: the remaining bytes."""
    docs = docs.drop("removed", "n_bytes", "kept")
    found = saved(repeated(docs.select(F.col(text_col).alias("text")), text_col="text", length=length, **options), "spans")
    at, plain = docs.columns.index(text_col), numbered(docs)
    keyed = plain.select("*", *text_ids(f"c{at}")).join(found, ["t", "u"], "left").select(*plain.columns, "spans")
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, off = K.column_bytes(batch.column(at))
            removed, kept = [], []
            for r, spans in enumerate(batch.column(len(batch.columns) - 1).to_pylist()):
                raw, runs = data[off[r] : off[r + 1]].tobytes(), []
                for x in sorted(spans or (), key=lambda x: x["a"]):
                    if runs and x["a"] <= runs[-1]["b"]:
                        runs[-1]["b"] = max(runs[-1]["b"], x["b"])
                    else:
                        runs.append(dict(x))
                edges = [0, *(e for x in runs for e in (x["a"], x["b"])), len(raw)]
                removed.append(runs)
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(removed, kind), pa.array(np.diff(off), pa.int64()), pa.array(kept, pa.binary())], names=[*batch.schema.names[:-1], "removed", "n_bytes", "kept"])
        K.trim()

    out = keyed.mapInArrow(run, with_fields(plain, "removed array<struct<a:bigint,b:bigint>>, n_bytes bigint, kept binary"))
    return out.toDF(*docs.columns, "removed", "n_bytes", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return out.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
