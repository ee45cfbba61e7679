"""WARC archives (operator 10): index first, then coalesced byte-range reads.

Writing is one pass: each task streams gzip-compressed records, one member each, to an archive of
its own and emits an index row (file, offset, length, URL, digest) per record. The index is
written to Parquet, and only archives named in it count, so a task that runs twice does no harm.
Reading takes index rows, sorts them by file and offset, joins ranges that touch or nearly touch,
and fetches each joined range with one read.

Records whose payload another record also has become ``revisit`` records: of the records with equal
payloads of at least ``min_bytes`` the one with the largest id holds the payload. Ids and digests are
grouped and joined without payloads, and only records that become revisits meet the payloads again.

Edge cases: a null payload is empty; rows with the largest id of equal payloads are all responses, even if that id
is repeated; null ids sort below all others, and pages of which no copy has an id are responses; null URLs are written
as ``urn:page:<id>``; a record ID is ``urn:page:<id>#<digest>``, so pages that share an id but no payload stay apart, and only rows equal in
both share it; payloads of any length are one record; other columns of the input are ignored, whatever their names; an
empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import open_fs, saved, scratch, table

INDEX = "id string, url string, file string, offset bigint, length bigint, payload_bytes bigint, digest string, record_type string, refers_to string"
#: Ranges at most this far apart are fetched together; a joined range grows to at most MAX_READ bytes (or one record).
GAP, MAX_READ = 64 << 10, 8 << 20
#: At most about so many bytes of archives are read by one task.
PIECE = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(id_: str, url: str, payload: bytes, digest: str, kind: str, refers_to: str | None, n: int, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its response, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{id_}#{digest}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[5:5] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}#{digest}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:]), payload


def assign(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """(id, url, html, digest, payload_bytes, record_type, refers_to) for each page."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    # ids and digests alone decide; what they decide meets the payloads by id and digest, so copies of one page go to many tasks
    narrow = saved(base.where(F.col("payload_bytes") >= min_bytes).select("id", "digest"), "page-digests")
    twice = saved(narrow.groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "repeated-digests")
    other = narrow.join(twice, "digest").where(~F.col("id").eqNullSafe(F.col("keeper")))
    revisits = saved(other.groupBy("id", "digest").agg(F.max("keeper").alias("refers_to")), "revisits").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    found = base.join(revisits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return found.select("id", "url", "html", "digest", "payload_bytes", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("record_type"), "refers_to")


def write(assigned: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes archives and returns the index, one row a record."""
    rows = assigned.select(F.col("id").cast("string").alias("id"), "url", "html", "digest", "payload_bytes", "record_type", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches):
        uri, out, at = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            if out is None:
                fs, path = open_fs(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            offsets, lengths = [], []
            for x in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)), strict=True):
                id_, url, html, digest, n, kind, refers = x
                url = "".join(c for c in url if c not in "\r\n") if url else f"urn:page:{id_}"
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(id_, url, html.as_py(), digest, kind, refers, n, date)) + z.flush()
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            b = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols = [b["id"], b["url"], pa.array([uri] * len(batch)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), b["payload_bytes"], b["digest"], b["record_type"], b["refers_to"]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "file", "offset", "length", "payload_bytes", "digest", "record_type", "refers_to"])
        if out is not None:
            out.close()
        K.trim()

    return saved(rows.mapInArrow(run, INDEX), "warc-index")


def fetch(rows: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
    """Decompressed records of (file, offset, length) in file and offset order, by coalesced range reads."""
    uri, source, group = None, None, []

    def read(group):
        start = group[0][0]
        data = source.read_at(group[-1][0] + group[-1][1] - start, start)
        for offset, length in group:
            yield zlib.decompress(data[offset - start : offset - start + length], 31)

    for file, offset, length in rows:
        if group and (file != uri or offset > group[-1][0] + group[-1][1] + GAP or offset + length - group[0][0] > MAX_READ):
            yield from read(group)
            group = []
        if file != uri:
            fs, path = open_fs(file)
            uri, source = file, fs.open_input_file(path)
        group.append((offset, length))
    if group:
        yield from read(group)


def read(index: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Reads the records that ``index`` names: id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    All values come from the archives. Digest and size of a response are computed from its payload;
    those of a revisit come from its headers.
    """
    size = index.agg(F.countDistinct("file").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, size.files, -(-size.bytes // PIECE))  # a fixed number, as index rows are small and records are not
    wanted = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload

    def run(batches):
        rows = ((x, o, n) for b in batches for x, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        size = 0
        for raw in fetch(rows):
            fields, http, payload = parse(raw)
            own = fields["WARC-Type"] == "response"
            digest = hashlib.sha1(payload).hexdigest() if own else fields["WARC-Payload-Digest"].removeprefix("sha1:")
            refers = None if own else _page(fields["WARC-Refers-To"])
            out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], len(payload) if own else int(http["Content-Length"]), digest, fields["WARC-Type"], refers, payload)[: len(names)])
            size += len(payload) * with_payload + 300
            if size > 4 << 20:
                yield _batch(out, names)
                out, size = [], 0
        if out:
            yield _batch(out, names)
        K.trim()

    return wanted.mapInArrow(run, "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)


def _page(record_id: str) -> str:
    """The page id in ``<urn:page:ID#DIGEST>``."""
    return record_id[10:-1].rpartition("#")[0]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(assign(table(spark, sf_dir, "pages")), scratch(spark, "warc"))
    back = read(index)
    number = lambda c: F.when(F.col(c) != "None", F.col(c)).cast("bigint")
    return back.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), q AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p
), k AS (
  SELECT d, max(page_id) AS keeper FROM q WHERE n >= 1000 GROUP BY d HAVING count(*) > 1
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM q LEFT JOIN k ON q.d = k.d
"""
