"""Readers and stores: driver tables, the docs view, directory walks, content store, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File extensions whose sources are chunked and embedded.
SOURCE_EXTENSIONS = ["rs", "py", "pyi", "js", "mjs", "cjs", "jsx"]


#: Rows that travel to a Python worker at once. Whole texts make rows large, so Spark's default of 10,000 is too many.
BATCH_ROWS = "1000"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the batch size where the session has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_view(documents: DataFrame) -> DataFrame:
    """``documents`` as source files: (doc_id, repo, path, content)."""
    ext = F.element_at(F.array(*map(F.lit, ["rs", "py", "js", "go", "md", "txt"])), (F.col("doc_id") % 6 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 5 == 0, "tests/").otherwise("src/")
    return documents.select(
        "doc_id", F.concat(F.lit("org/"), "source").alias("repo"),
        F.concat(folder, "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.col("text").alias("content"),
    )


def walk(spark: SparkSession, root: str, *, index: bool = False, extensions: list[str] | None = None) -> DataFrame:
    """Files below ``root``: (path, size, bytes, content), paths relative with ``/``.

    ``.git`` is skipped, with ``index`` also ``node_modules`` and ``.DS_Store``. ``content`` is null for
    bytes that are no UTF-8; with ``extensions`` only such UTF-8 files stay.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), f"^\\Q{base}\\E/", "")
    skip = ["\\.git"] + (["node_modules", "\\.DS_Store"] if index else [])
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    out = files.select(rel.alias("path"), F.col("length").alias("size"), F.col("content").alias("bytes"), text.alias("content"))
    out = out.where(~F.col("path").rlike(f"(^|/)({'|'.join(skip)})(/|$)"))
    if extensions:
        out = out.where(F.element_at(F.split("path", r"\."), -1).isin(extensions) & F.col("content").isNotNull())
    return out


def safe_tree_rows(tree: DataFrame, max_bytes: int = 1_048_576) -> DataFrame:
    """Rows (mode, kind, path, size) of a version-control tree that may be materialised: blobs, no links, safe paths, size cap."""
    safe = ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.?(/|$)|\\|(^|/)\.git(/|$)") & (F.col("path") != "")
    return tree.where((F.col("kind") == "blob") & ~F.col("mode").isin("120000", "160000") & safe & (F.col("size") <= max_bytes))


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: checkpointed where the session names a shared folder, else persisted (Spark computes lost parts again)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None and (root := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() is not None else df.persist()


def content_hash(col: str = "content"):
    return F.sha2(F.col(col).cast("binary"), 256)


def blobs(docs: DataFrame) -> DataFrame:
    """Content store: one row per distinct content, (hash, raw_len, content)."""
    return docs.select(content_hash().alias("hash"), F.octet_length("content").cast("long").alias("raw_len"), "content").dropDuplicates(["hash"])


def put(blobs_: DataFrame, path: str) -> None:
    blobs_.write.mode("overwrite").option("compression", "zstd").parquet(path)


def get(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    """Blobs of the wanted hashes with ``intact``: length and hash recomputed from the content."""
    found = spark.read.parquet(path).join(hashes.select("hash").distinct(), "hash", "left_semi")
    return found.withColumn("intact", (content_hash() == F.col("hash")) & (F.octet_length("content") == F.col("raw_len")))


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Upsert semantics: per key the row with the largest ``seq``."""
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def canonical_repo(repos: DataFrame, forks: DataFrame) -> DataFrame:
    """``repos`` with ``canonical``: the upstream in ``forks`` (fork, canonical), or null."""
    return repos.join(forks.select(F.col("fork").alias("repo"), "canonical"), "repo", "left")
