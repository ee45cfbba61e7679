"""Dependency graphs: degrees, PageRank and personalised PageRank by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAMPING = 0.85


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-loops, dealt out by source once: what groups by source after it moves no row."""
    return edges.where("src <> dst").select("src", "dst").repartition("src").distinct()


def edge_counts(edges: DataFrame) -> DataFrame:
    """How many edges were given, kept, and dropped as self-loops or duplicates."""
    loops = F.count_if(F.col("src") == F.col("dst"))
    kept = F.count_distinct(F.when(F.col("src") != F.col("dst"), F.struct("src", "dst")))
    return edges.agg(F.count("*").alias("given"), loops.alias("self_loops"), kept.alias("kept")).withColumn("duplicates", F.col("given") - F.col("self_loops") - F.col("kept"))


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    deg = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(deg, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, *, seeds: list[int] | None = None, damping: float = DAMPING, iterations: int = 10, tol: float | None = None, checkpoint_every: int = 4) -> tuple[DataFrame, int, bool]:
    """((id, rank), iterations run, converged). With seeds the surfer restarts at them, else anywhere.

    r' = (1 - d) v + d (M r + dangling v), dangling = 1 - sum(M r), starting from v. Ranks sum to one, so the dangling part is the
    rank of the nodes without links. Links stay partitioned by source for all rounds, each round's ranks are computed once, and every
    few rounds they are checkpointed, so lineage stays short and a lost executor costs those rounds at most.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    wanted = sorted(set(seeds or []))
    count = ids.count()
    known = ids.where(F.col("id").isin(wanted)).count() if wanted else 0
    v = F.when(F.col("id").isin(wanted), 1.0 / known).otherwise(0.0) if known else F.lit(1.0 / max(1, count))
    links = edges.select("src", "dst", (F.lit(1.0) / F.count("*").over(Window.partitionBy("src"))).alias("w")).persist()
    out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    nodes_ = ids.withColumn("v", v).join(out, "id", "left").repartition("id").persist()
    if iterations > checkpoint_every and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rank, done, converged = nodes_.select("id", F.col("v").alias("r"), F.col("out").isNull().alias("ends")).persist(), 0, False
    while done < iterations and not converged:
        flow = links.join(rank.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("m"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("ends"), F.col("r"))), F.lit(0.0)).alias("s")).first()[0]
        r = F.col("v") * (1 - damping) + (F.coalesce("m", F.lit(0.0)) + F.col("v") * lost) * damping
        new = nodes_.join(flow, "id", "left").select("id", r.alias("r"), F.col("out").isNull().alias("ends"))
        done += 1
        new = new.persist()
        if done % checkpoint_every == 0 and done < iterations:
            new = new.checkpoint()
        if tol is not None:
            delta = new.join(rank.select("id", F.col("r").alias("old")), "id").agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] or 0.0
            converged = delta < tol
        rank = new
    return rank.select("id", "r"), done, converged


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    """The nodes that ``node`` depends on."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"))


def scores_of(ranks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, r) of the wanted nodes; 0 where a node has no rank."""
    return wanted.select("id").join(ranks, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("r"))


def total_of(ranks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sum of the ranks of the wanted nodes."""
    return scores_of(ranks, wanted.select("id").distinct()).agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("total"))


def pagerank_sql(nodes: str, edges: str, iterations: int, seeds: list[int] | None = None, damping: float = DAMPING) -> str:
    """The same ranks as one SQL query with a CTE per round."""
    if seeds:
        start = f"SELECT id, CASE WHEN id IN ({', '.join(map(str, seeds))}) THEN 1.0::DOUBLE / {len(set(seeds))} ELSE 0.0::DOUBLE END AS v FROM n"
    else:
        start = "SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS v FROM n"
    out = [f"WITH n AS ({nodes}), e AS ({edges}), l AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e), v AS ({start}), r0 AS (SELECT id, v AS r FROM v)"]
    for i in range(iterations):
        out.append(f"f{i} AS MATERIALIZED (SELECT dst AS id, sum(r * w) AS m FROM l JOIN r{i} ON l.src = r{i}.id GROUP BY dst)")
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT v.id, v * {1 - damping} + (coalesce(m, 0) + v * (1.0 - (SELECT coalesce(sum(m), 0) FROM f{i}))) * {damping} AS r FROM v LEFT JOIN f{i} ON v.id = f{i}.id)")
    return ", ".join(out) + f" SELECT id, round(r, 9) AS rank FROM r{iterations}"
