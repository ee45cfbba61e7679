"""Engines, calls as JSON, retries, extension points, stages."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.__main__ import answer
from quarry.operators import rank, retrieval, search, semantic
from quarry.plans import stages
from quarry.plans.engines import open_engine
from quarry.plans.tools import schemas
from quarry.sources import retry


def test_calls_as_json(spark):
    tools = open_engine(spark, "stub")
    got = json.loads(answer(tools, json.dumps({"tool": "search_code", "arguments": {"probes": ["retry_backoff"]}})))
    assert [(r["repo"], r["files"]) for r in got["results"]] == [("demo/cache", 1), ("demo/queue", 1)] and got["total"] == 2
    assert json.loads(answer(tools, '{"tool": "repo_tree", "arguments": {"repo": "DEMO/cache"}}'))["total"] == 2
    assert json.loads(answer(tools, "no call"))["error"]["kind"] == "bad_call"
    assert json.loads(answer(tools, '{"tool": "nope"}'))["error"]["kind"] == "unknown_tool"
    assert json.loads(answer(tools, '{"tool": "repo_tree", "arguments": {"x": 1}}'))["error"]["kind"] == "unknown_parameter"
    assert set(json.loads(answer(tools, '{"tool": "tools"}'))["tools"]) == set(schemas())


def test_engines(spark, tmp_path):
    docs = spark.createDataFrame([(1, "O/r", "a.rs", "local one\n"), (2, "O/r", "b.rs", "local two\n")], "doc_id long, repo string, path string, content string")
    search.save_index(docs, str(tmp_path / "i"))
    remote = spark.createDataFrame([("o/R", "a.rs", "remote one\n"), ("x/y", "c.rs", "remote three\n")], "repo string, path string, content string")
    of = lambda name, **k: {(r.path, r.content) for r in open_engine(spark, name, **k).docs.collect()}
    both = {"index": str(tmp_path / "i"), "remote": remote}
    assert of("hotset", index=both["index"]) == {("a.rs", "local one\n"), ("b.rs", "local two\n")}
    assert of("live", remote=remote) == {("a.rs", "remote one\n"), ("c.rs", "remote three\n")}
    assert of("merged", **both) == {("a.rs", "local one\n"), ("b.rs", "local two\n"), ("c.rs", "remote three\n")}
    for name, k in (("nope", {}), ("hotset", {}), ("merged", {"index": "x"})):
        with pytest.raises(ValueError, match="engine"):
            open_engine(spark, name, **k)


def test_retries():
    waits, left = [], [OSError(), OSError(), 7]

    def f():
        x = left.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert retry.call(f, sleep=waits.append) == 7 and waits == [0.25, 0.5]
    left[:] = [OSError(), OSError(), OSError(), 7]
    with pytest.raises(OSError):
        retry.call(f, sleep=waits.append)
    waits.clear()
    left[:] = [retry.RateLimited(1.5), 8]
    assert retry.call(f, sleep=waits.append) == 8 and waits == [1.5]
    for first in ([retry.RateLimited(9)], [retry.RateLimited(1), retry.RateLimited(1)]):
        left[:] = [*first, 8]
        with pytest.raises(retry.RateLimited):
            retry.call(f, sleep=waits.append)


def test_another_embedder(spark):
    def lengths(text):
        return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))

    docs = spark.createDataFrame([("r", "a.txt", "aaaa"), ("r", "b.txt", "b")], "repo string, path string, content string")
    index = semantic.index_source(docs, lengths)
    assert [r.path for r in semantic.search_chunks(index, "c", 2, embedder=lengths).collect()] == ["b.txt", "a.txt"]


def test_stages(spark, tmp_path):
    ran = []

    def compute():
        ran.append(1)
        return spark.range(3)

    for inputs, want in ((["b", "a"], True), (["a", "b"], False), (["a"], True)):
        result, did = stages.run(spark, str(tmp_path), "s", inputs, compute)
        assert did == want and result.count() == 3
    assert len(ran) == 2


def test_latencies_and_reports(spark):
    seen = []
    times = retrieval.latencies(seen.append, list(range(8)), warm_up=5)
    assert seen == [*range(5), *range(8)] and len(times) == 8
    rows = spark.createDataFrame([(float(x),) for x in range(10, 50, 10)], "v double")
    assert rows.agg(retrieval.percentile(rows, "v", 50).alias("p")).first().p == 20.0
    assert retrieval.markdown(spark.createDataFrame([("a", 0.5, None)], "n string, x double, y int")) == "| n | x | y |\n| - | - | - |\n| a | 0.5 |  |\n"


def test_decoys_rank_below_the_truth(spark):
    """Two good repositories, two middling, an archived and an abandoned decoy, for each of six topics."""
    topics = ["async runtime", "http client", "json", "logging", "errors", "cache"]
    profiles = [("good", 30000, 4000, 5, False, 0.95), ("fine", 20000, 3000, 20, False, 0.8), ("lite", 800, 60, 90, False, 0.35), ("kit", 500, 40, 120, False, 0.42), ("archived", 9000, 900, 900, True, 0.55), ("vapor", 3, 0, 800, False, 0.1)]
    rows = [(t, f"https://h/{n}/{t.replace(' ', '-')}", s, f, d, a, c) for t in topics for n, s, f, d, a, c in profiles]
    base = spark.createDataFrame(rows, "topic string, repo_url string, stars long, forks long, last_push_days_ago int, archived boolean, centrality double")
    none = F.lit(None).cast("double")
    scored = rank.score(base.select("*", F.lit(0).alias("dependents_count"), none.alias("release_cadence"), none.alias("issue_response_days"), none.alias("openssf_score"), F.lit(0).alias("awesome_list_memberships"), F.lit(0).alias("hn_mentions"), F.lit(True).alias("license_present"), F.lit(True).alias("has_tests_heuristic")))
    ranked = retrieval.ranked(scored.select(F.col("topic").alias("list"), F.col("repo_url").alias("id"), "score"))
    results = ranked.select(F.col("list").alias("topic"), F.col("id").alias("doc"), "rank")
    truth = base.where(F.col("repo_url").rlike("/(good|fine)/")).select("topic", F.col("repo_url").alias("doc"))
    decoys = base.where(F.col("repo_url").rlike("/(archived|vapor)/")).select("topic", F.col("repo_url").alias("doc"))
    hits = retrieval.topic_hits(results, truth, 10).collect()
    assert len(hits) == 6 and all(r.hit and r["first"] == 1 and r.mrr == 1.0 for r in hits)
    assert {r["rank"] for r in retrieval.decoy_ranks(results, decoys).collect()} == {5, 6}
