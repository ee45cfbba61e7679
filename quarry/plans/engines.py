"""Which documents the tools work on: a few built-in ones, a stored index, rows of remote responses, or local and remote together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.plans.tools import Tools

ENGINES = ("stub", "hotset", "live", "merged")
_STUB = [("demo/cache", "src/lru.rs", "pub fn retry_backoff() {}\n"), ("demo/cache", "README.md", "# cache\nRetries back off.\n"), ("demo/queue", "src/queue.py", "def retry_backoff(n):\n    return 2 ** n\n")]


def open_engine(spark: SparkSession, name: str, *, index: str | None = None, remote: DataFrame | None = None) -> Tools:
    """The tools over an engine. ``remote``: hits (repo, path, content); of a file that is local and remote the local one counts."""
    if name not in ENGINES:
        raise ValueError(f"unknown engine `{name}`; known: {', '.join(ENGINES)}")
    if name == "stub":
        return Tools(spark.createDataFrame(_STUB, "repo string, path string, content string"))
    if name in ("hotset", "merged") and index is None or name in ("live", "merged") and remote is None:
        raise ValueError(f"engine `{name}` needs {'an index' if index is None and name != 'live' else 'remote rows'}")
    columns = ["repo", "path", "content"]
    if name == "live":
        return Tools(remote.select(*columns))
    local = search.Index(spark, index).docs.select(*columns)
    if name == "hotset":
        return Tools(local)
    key = [F.lower("repo") == F.lower(F.col("_r")), F.col("path") == F.col("_p")]
    others = remote.select(*columns).join(local.select(F.col("repo").alias("_r"), F.col("path").alias("_p")), key, "left_anti")
    return Tools(local.unionByName(others))
