"""Connected components of links between 64-bit ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_scratch, scratch, write


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b); the root is the smallest id of its component.

    Each step only takes minima by id (partial aggregation, so a hub with many links is no hot
    task) and joins them back. Every round is written to the shared folder, so no round depends on
    executors that may be lost.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path, edges = _save(spark, edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        # large star: larger neighbours go to the smallest of the neighbourhood
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new_path, new = _save(spark, small)
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop_scratch(spark, path)
        path, edges = new_path, new
        if same:
            break
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def _save(spark, df: DataFrame) -> tuple[str, DataFrame]:
    path = scratch(spark, "components")
    return path, write(df, path)
