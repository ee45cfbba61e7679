"""Vector search, rank fusion and retrieval evaluation."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.tables import settled

RRF_K, DEPTH = 3, 10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0)))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, *also) of the k nearest by cosine, filtered before scoring; ties by id."""
    if k < 1 or not query:
        return vectors.select("id", F.lit(0.0).alias("score"), *also).limit(0)
    rows = vectors if where is None else vectors.where(where)
    target = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", cosine(F.col("embedding"), target).alias("score"), *also).orderBy(F.desc("score"), "id").limit(k)


def path_under(col: Column, prefix: str) -> Column:
    """A path equal to ``prefix`` or below it, at a component border."""
    return (col == prefix) | col.startswith(prefix if prefix.endswith("/") else prefix + "/")


def ranked(scores: DataFrame) -> DataFrame:
    """``scores`` (list, id, score) with a 1-based rank in each list.

    Lists may be long: rows are dealt out in order of list and rank, numbered where they are, and the numbers
    of the parts before (one narrow row a part) are added.
    """
    order = [F.col("list"), F.desc("score"), F.col("id")]
    parts = settled(scores.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    sizes = parts.groupBy("list", "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("list").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("list", "_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    return parts.join(starts, ["list", "_p"]).withColumn("rank", F.col("_m") + F.col("_add")).drop("_p", "_m", "_add")


def rrf(lexical: DataFrame, dense: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two lists (id, score): (id, lex, dense, score), best first."""
    lists = [df.select(F.lit(name).alias("list"), "id", F.col("score").cast("double").alias("score")) for name, df in (("lex", lexical), ("dense", dense))]
    value = F.lit(1.0) / (F.col("rank") + k)
    of = lambda name: F.coalesce(F.max(F.when(F.col("list") == name, value)), F.lit(0.0)).alias(name)
    both = ranked(lists[0].union(lists[1])).groupBy("id").agg(of("lex"), of("dense"))
    return both.withColumn("score", F.col("lex") + F.col("dense")).orderBy(F.desc("score"), "id")


def evaluate(results: DataFrame, qrels: DataFrame, depth: int = DEPTH, recall_depth: int = 50) -> DataFrame:
    """Per query: ndcg (ideal over the returned list), mrr and hit at ``depth``, recall at ``recall_depth``.

    results: (query_id, doc, rank); qrels: (query_id, doc, gain). Relevant means a gain of 1 or more.
    """
    joined = results.join(qrels, ["query_id", "doc"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
    top = joined.where(F.col("rank") <= depth).withColumn("ideal", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "rank")))
    value = F.pow(F.lit(2.0), "gain") - 1
    per = top.groupBy("query_id").agg(F.sum(value / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(value / F.log2(F.col("ideal") + 1)).alias("idcg"), F.min(F.when(F.col("gain") >= 1, F.col("rank"))).alias("first"))
    found = joined.where((F.col("rank") <= recall_depth) & (F.col("gain") >= 1)).groupBy("query_id").agg(F.count("*").alias("found"))
    want = qrels.where("gain >= 1").groupBy("query_id").agg(F.count("*").alias("wanted"))
    out = results.select("query_id").distinct().join(per, "query_id", "left").join(found, "query_id", "left").join(want, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query_id", F.when(zero(F.col("idcg")) == 0, 0.0).otherwise(F.col("dcg") / F.nullif("idcg", F.lit(0.0))).alias("ndcg"), zero(F.lit(1.0) / F.col("first")).alias("mrr"),
        F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"), F.when(F.col("wanted").isNull(), 1.0).otherwise(zero(F.col("found") / F.col("wanted"))).alias("recall"),
    )


def means(per_query: DataFrame) -> DataFrame:
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def topic_hits(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per topic: first (rank of its first expected document, any depth), hit (within ``k``) and mrr.

    results: (topic, doc, rank); expected: (topic, doc). Every expected topic has a row.
    """
    if k < 1:
        raise ValueError("k must be positive")
    first = results.join(expected.select("topic", "doc").distinct(), ["topic", "doc"], "left_semi").groupBy("topic").agg(F.min("rank").alias("first"))
    out = expected.select("topic").distinct().join(first, "topic", "left")
    return out.select("topic", "first", F.coalesce(F.col("first") <= k, F.lit(False)).alias("hit"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def decoy_ranks(results: DataFrame, decoys: DataFrame) -> DataFrame:
    """(topic, doc, rank) of the decoys; null where a decoy is not in the results."""
    return decoys.join(results, ["topic", "doc"], "left").select("topic", "doc", "rank")


def latencies(run, queries: list, *, warm_up: int = 5) -> list[float]:
    """Seconds of each query after ``warm_up`` runs of the first ones; ``run`` takes a query and returns when it is done."""
    for q in queries[:warm_up]:
        run(q)
    out = []
    for q in queries:
        began = time.perf_counter()
        run(q)
        out.append(time.perf_counter() - began)
    return out


def percentile(values: DataFrame, column: str, p: float) -> Column:
    """The nearest-rank percentile as an aggregate."""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})")


def markdown(rows: DataFrame) -> str:
    """A small report as a table; numbers have four places at most."""
    text = lambda v: "" if v is None else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = [rows.columns, ["-"] * len(rows.columns), *([text(v) for v in r] for r in rows.collect())]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def save_vectors(vectors: DataFrame, path: str) -> None:
    """Stores (id, embedding, ...) with the norm of each vector; of equal ids one stays."""
    vectors.dropDuplicates(["id"]).withColumn("norm", norm(F.col("embedding"))).write.mode("overwrite").parquet(path)


def open_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """A vector store; its vectors must have ``dim`` places."""
    rows = spark.read.parquet(path)
    odd = rows.where(F.size("embedding") != dim).limit(1).count()
    if odd:
        raise ValueError(f"{path}: vectors do not all have {dim} places")
    return rows
