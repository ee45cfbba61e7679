"""Scratch folders, file access and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, SparkSession] = {}


#: Rows that travel to a Python worker at once. Whole texts make rows large, so Spark's default of 10,000 is too many.
BATCH_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the batch size where the session has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only a local master without that setting gets a folder of its own; anything else would put
    files where other executors cannot see them.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one; it is deleted when the driver ends."""
    path = f"{shared_root(spark)}/quarry/{what}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH[path] = spark
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    _SCRATCH.pop(path, None)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in list(_SCRATCH.items()):
        try:
            drop_scratch(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch
            return


#: For scratch tables on a local or mounted file system (``file:``): no checksum file beside each part, so a third fewer
#: processes are forked to set permissions of files. Other file systems ignore these settings.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read again."""
    df.write.options(**(_PLAIN_FILES if path.startswith("file:") else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    bound_batches(spark)
    out = write(df, scratch(spark, what))
    release(spark)
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes tables of ``saved`` of which nothing is read again."""
    for df in tables:
        names = {p.rsplit("/", 2)[1] for p in df.inputFiles()}
        for path in [p for p in _SCRATCH if p.rsplit("/", 1)[1] in names]:
            drop_scratch(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs, which it does when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Lets the executors' JVMs give memory back that the step before took: they keep it otherwise, beside what Python takes in the next."""
    release(spark)
    if not spark.sparkContext.master.startswith("local["):
        n = spark.sparkContext.defaultParallelism
        spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def open_fs(uri: str):
    """(pyarrow file system, path) for a URI; executors use it for raw files in the shared folder."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: whatever they were called, also twice or with dots, no name of an operator's own clashes."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def with_fields(df: DataFrame, more: str) -> str:
    """The schema of numbered columns and more fields, as text."""
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + [more])


def text_key(col: str = "text"):
    """SHA-256 (hex) of the UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(F.col(col), F.lit("")).cast("binary"), 256)
