"""Token ids in binary files (operator 9): patched frame-of-reference blocks.

File format (little endian)::

    "QPF2" | block ... | block starts u64[n_blocks] | n_tokens u32[n_docs] | document ids: Arrow stream | n_blocks, n_ids, n_docs, bytes of the stream: u64 each | "QPF2"

Blocks hold 512 ids (the last fewer). A block is ``minimum u32, width u8, n_exceptions u16, n_ids
u16``, the ids less the minimum packed at ``width`` bits (values too wide leave their low bits),
then positions u16 and high parts u32 of the exceptions. The width is the bit length that
``percentile`` of the block's values have at most. The index of block starts lets a reader fetch any
range of ids.

Writing is one range-partitioned pass in ascending id order: each partition becomes one file, whose
name is unique to the task attempt. A manifest row per file (its first and last id, and counts) is written to
Parquet after it; only files in the manifest are read, so a task that runs twice does no harm. Reading
takes as many tasks as there are files.

Edge cases: a null text is empty and has just the end id; texts are encoded whole, whatever their length;
rows with equal ids stay in the order of their texts' hashes (rows that are equal altogether in any order, which
cannot be told apart); null ids come first; ids may have any type that sorts; an empty table gives no files and no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import chunks, codec, default_path
from .shared import open_fs, saved, scratch, table

BLOCK = 512
MAGIC = b"QPF2"
_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("n_exceptions", "<u2"), ("n_ids", "<u2")])


def pack(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """The blocks of ids; all but the last hold BLOCK ids."""
    full = len(ids) // BLOCK
    out = _pack(ids[: full * BLOCK].reshape(full, BLOCK), percentile) if full else []
    if len(ids) > full * BLOCK:
        out += _pack(ids[full * BLOCK :].reshape(1, -1), percentile)
    return out


def _pack(x: np.ndarray, percentile: float) -> list[bytes]:
    n, k = x.shape
    low = x.min(axis=1)
    delta = (x - low[:, None]).astype(np.uint32)
    cut = min(k - 1, int(np.ceil(percentile * k)) - 1)
    width = np.ceil(np.log2(np.partition(delta, cut, axis=1)[:, cut].astype(np.float64) + 1)).astype(np.uint8)
    over = (delta >> width[:, None].astype(np.uint32)) if width.max() < 32 else np.zeros_like(delta)
    row, pos = np.nonzero(over)
    high = over[row, pos].astype("<u4")
    first = np.searchsorted(row, np.arange(n + 1))
    head = np.zeros(n, _HEAD)
    head["minimum"], head["width"], head["n_exceptions"], head["n_ids"] = low, width, np.diff(first), k
    body: list[bytes] = [b""] * n
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(delta[own].astype("<u4").view(np.uint8).reshape(len(own), k, 4), axis=2, bitorder="little", count=int(w))
            packed = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
            for i, b in zip(own.tolist(), packed, strict=True):
                body[i] = b.tobytes()
    heads, positions, size = head.tobytes(), pos.astype("<u2"), _HEAD.itemsize
    return [heads[i * size : (i + 1) * size] + body[i] + positions[a:b].tobytes() + high[a:b].tobytes() for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks; ``starts`` are their offsets in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
    begin = np.concatenate(([0], np.cumsum(head["n_ids"].astype(np.int64))))
    out = np.zeros(begin[-1], np.uint32)
    width, count = head["width"].astype(np.int64), head["n_ids"].astype(np.int64)
    for w, k in {*zip(width.tolist(), count.tolist(), strict=True)}:
        own = np.flatnonzero((width == w) & (count == k))
        x = np.zeros((len(own), k), np.uint32)
        if w:
            packed = raw[starts[own][:, None] + _HEAD.itemsize + np.arange((w * k + 7) // 8)]
            bits = np.zeros((len(own), k, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little", count=w * k).reshape(len(own), k, w)
            x = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
        out[begin[own][:, None] + np.arange(k)] = x + head["minimum"][own][:, None]
    for i in np.flatnonzero(head["n_exceptions"]).tolist():
        m = int(head["n_exceptions"][i])
        at = int(starts[i]) + _HEAD.itemsize + (int(width[i]) * int(count[i]) + 7) // 8
        pos = np.frombuffer(data, "<u2", m, at).astype(np.int64)
        out[begin[i] + pos] += np.frombuffer(data, "<u4", m, at + 2 * m) << np.uint32(width[i])
    return out


class Writer:
    """Streams ids into one file; blocks may span documents."""

    def __init__(self, out, percentile: float):
        self.out, self.percentile, self.at = out, percentile, len(MAGIC)
        self.starts, self.sizes, self.rest, self.n = [], [], np.zeros(0, np.uint32), 0
        out.write(MAGIC)

    def add(self, ids: np.ndarray, sizes: list[int]) -> None:
        self.sizes += sizes
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        cut = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:cut])
        self.rest = ids[cut:]

    def _blocks(self, ids: np.ndarray) -> None:
        blocks = pack(ids, self.percentile)
        lens = np.cumsum([self.at, *map(len, blocks)])
        self.starts.append(lens[:-1])
        self.at = int(lens[-1])
        self.out.write(b"".join(blocks))

    def close(self, doc_ids: pa.Array) -> None:
        self._blocks(self.rest)
        starts = np.concatenate(self.starts).astype("<u8")
        batch = pa.RecordBatch.from_arrays([doc_ids], names=["id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        named = sink.getvalue().to_pybytes()
        self.out.write(starts.tobytes() + np.array(self.sizes, "<u4").tobytes() + named + np.array([len(starts), self.n, len(self.sizes), len(named)], "<u8").tobytes() + MAGIC)
        self.out.close()


class Reader:
    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(36, size - 36)
        if tail[32:] != MAGIC:
            raise ValueError(f"{uri}: not a token file")
        self.n_blocks, self.n_ids, self.n_docs, named = np.frombuffer(tail[:32], "<u8").astype(np.int64).tolist()
        self.end = size - 36 - named - 4 * self.n_docs - 8 * self.n_blocks
        self.starts = np.frombuffer(self.file.read_at(8 * self.n_blocks, self.end), "<u8").astype(np.int64)
        self.sizes = np.frombuffer(self.file.read_at(4 * self.n_docs, self.end + 8 * self.n_blocks), "<u4").astype(np.int64)
        self.doc_ids = pa.ipc.open_stream(self.file.read_at(named, size - 36 - named)).read_next_batch().column(0)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin..end, by way of the block index."""
        if end <= begin:
            return np.zeros(0, np.uint32)
        b0, b1 = begin // BLOCK, min(self.n_blocks, -(-end // BLOCK))
        stop = int(self.starts[b1]) if b1 < self.n_blocks else self.end
        data = self.file.read_at(stop - int(self.starts[b0]), int(self.starts[b0]))
        return unpack(data, self.starts[b0:b1] - self.starts[b0])[begin - b0 * BLOCK : end - b0 * BLOCK]


def write(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None, percentile: float = 0.9) -> DataFrame:
    """Writes the token ids of ``docs`` in ascending id order; returns the manifest: (part, file, first_id, last_id, n_docs, n_tokens, base), base being the tokens of the files before."""
    path = path or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = docs.select(F.col(id_col).alias("id"), text.alias("text")).repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        c, writer, ids_seen = codec(path), None, []
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.qpf"
        for whole in batches:
            for batch in chunks(whole, 1):
                if writer is None:
                    fs, at = open_fs(uri)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = Writer(fs.open_output_stream(at, compression=None), percentile)
                flat, n = c.encode(batch.column(1).to_pylist())
                writer.add(np.insert(flat, np.cumsum(n), end_id), (n + 1).tolist())
                ids_seen.append(batch.column(0))
        if writer is not None:
            ids = pa.concat_arrays(ids_seen)
            writer.close(ids)
            K.trim()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([uri]), ids.slice(0, 1), ids.slice(len(ids) - 1), pa.array([len(ids)], pa.int64()), pa.array([writer.n], pa.int64())], names=["part", "file", "first_id", "last_id", "n_docs", "n_tokens"])

    manifest = saved(ordered.mapInArrow(run, f"part bigint, file string, first_id {id_type}, last_id {id_type}, n_docs bigint, n_tokens bigint"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document, from the files that ``manifest`` names: its id, start (ids before it), n_tokens, ids_crc32, and the ids themselves if asked for."""
    id_type = manifest.schema["first_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader, at = Reader(row["file"]), 0
                ends = np.cumsum(reader.sizes)
                lo = 0
                while lo < reader.n_docs:  # about a million ids at a time, or one document
                    hi = max(lo + 1, int(np.searchsorted(ends, at + (1 << 20), side="right")))
                    ids = reader.ids(at, int(ends[hi - 1]))
                    sizes = reader.sizes[lo:hi]
                    cuts = np.concatenate(([0], np.cumsum(sizes)))
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cols = [
                        reader.doc_ids.slice(lo, hi - lo), pa.array(cuts[:-1] + at + row["base"], pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64()),
                    ]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    lo, at = hi, int(ends[hi - 1])
        K.trim()

    # a fixed number of partitions, which adaptive execution does not merge: the rows are small, the files are not
    files = manifest.select("part", "file", "base").repartitionByRange(max(1, manifest.count()), "part")
    return files.mapInArrow(run, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
