"""Structured Streaming: incremental reindexing, event-stream parsing, cooldowns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import scalars as S

DEFAULT_COOLDOWN, MAX_COOLDOWN = 60.0, 3600.0


def reindex(spark: SparkSession, landing: str, store: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Applies changed documents (repo, path, content, seq) from ``landing`` to the store, the latest seq winning.

    The store keeps (repo, path, content, seq, deleted): documents that may not be indexed, or whose content is null, stay as
    deleted rows without content, so that older changes which arrive late do not bring them back. ``read_store`` leaves them out.
    Each batch rewrites only the partitions (repos) it touches. A batch that runs again gives the same store.
    """

    def apply(batch: DataFrame, _: int) -> None:
        latest = Window.partitionBy("repo", "path").orderBy(F.desc("seq"))
        admitted = F.coalesce(S.admitted(F.col("content")), F.lit(False))
        changed = batch.withColumn("deleted", ~admitted).withColumn("content", F.when(admitted, F.col("content"))).persist()
        try:
            both = changed
            try:
                touched = changed.select("repo").distinct()
                both = spark.read.schema(changed.schema).parquet(store).join(touched, "repo", "left_semi").unionByName(changed)
            except Exception as e:  # noqa: BLE001 - the first batch finds no store
                if "PATH_NOT_FOUND" not in str(e):
                    raise
            keep = both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").select(*changed.columns).checkpoint()
            keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(store)
        finally:
            changed.unpersist()

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The documents of a store that are not deleted."""
    return spark.read.parquet(store).where("NOT deleted").drop("deleted")


def parse_stream(chunks: DataFrame) -> DataFrame:
    """Streaming (request, seq, chunk) to (request, idx, event, data), event by event as they are complete.

    The state of a request is its unfinished tail and the number of events so far. Within a batch chunks are taken by seq.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state):
        tail, idx = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        text = (tail + "".join(rows["chunk"])).replace("\r\n", "\n")
        *whole, tail = text.split("\n\n")
        out = []
        for raw in whole:
            lines = raw.split("\n")
            value = lambda name: [x[len(name) + 1 :].removeprefix(" ") for x in lines if x.startswith(name + ":")]  # noqa: B023, E731
            event, data = (value("event") or ["message"])[0], "\n".join(value("data"))
            if data or event != "message":
                out.append((key[0], idx, event, data))
            idx += 1
        state.update((tail, idx))
        yield pd.DataFrame(out, columns=["request", "idx", "event", "data"])

    kind = chunks.schema["request"].dataType.simpleString()
    return chunks.groupBy("request").applyInPandasWithState(update, f"request {kind}, idx long, event string, data string", "tail string, idx long", "append", "NoTimeout")


def parse_events(chunks: DataFrame) -> DataFrame:
    """Server-sent events of (request, seq, chunk): (request, idx, event, data). An unfinished last event is left out.

    An event ends with an empty line; ``data`` lines of an event are joined by line breaks.
    """
    body = chunks.groupBy("request").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("body"))
    parts = F.split(F.regexp_replace("body", "\r\n", "\n"), "\n\n", -1)
    whole = body.select("request", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("idx", "raw"))
    lines = F.split("raw", "\n")
    field = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    return whole.select("request", F.col("idx").cast("long").alias("idx"), F.coalesce(F.get(field("event"), F.lit(0)), F.lit("message")).alias("event"), F.array_join(field("data"), "\n").alias("data")).where((F.col("data") != "") | (F.col("event") != "message"))


def cooldowns(limits: DataFrame) -> DataFrame:
    """Streaming (backend, at: seconds, wait: seconds or null) to (backend, at, until): the running end of a backend's cooldown.

    A wait is 60 s by default and 3600 s at most; a later limit never shortens it; one that has passed starts anew.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state):
        until = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, wait in zip(rows["at"], rows["wait"], strict=True):
            w = DEFAULT_COOLDOWN if pd.isna(wait) else min(float(wait), MAX_COOLDOWN)
            until = max(until, at + w) if until > at else at + w
            out.append((key[0], at, until))
        state.update((until,))
        yield pd.DataFrame(out, columns=["backend", "at", "until"])

    return limits.groupBy("backend").applyInPandasWithState(update, "backend string, at double, until double", "until double", "append", "NoTimeout")


def permit_gaps(permits: DataFrame, per_minute: float, tie: str = "at") -> DataFrame:
    """(backend, at, gap, early): whether a permit came sooner after the last one than the even spacing allows."""
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("backend").orderBy("at", tie))
    return permits.select("*", gap.alias("gap"), F.coalesce(gap < 60.0 / per_minute - 1e-9, F.lit(False)).alias("early"))
