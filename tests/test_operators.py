"""Closed forms, hand-computed expectations, and edge cases."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.operators import dedup, graph, rank, retrieval, search, semantic
from quarry.plans.language import Query
from quarry.plans.tools import Tools, clean, cursor, envelope
from quarry.sources import backends, tables
from quarry.streaming import reindex as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_pagerank_closed_forms(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "src long, dst long")
    nodes = lambda n: spark.range(n).withColumnRenamed("id", "id")
    r, _, ok = graph.pagerank(nodes(2), edges((0, 1), (1, 0)), iterations=50, tol=1e-12)
    assert ok and all(math.isclose(x.r, 0.5) for x in r.collect())
    star = {x.id: x.r for x in graph.pagerank(nodes(4), edges((1, 0), (2, 0), (3, 0)), iterations=40)[0].collect()}
    assert math.isclose(sum(star.values()), 1.0) and star[0] > star[1] and math.isclose(star[1], star[2])
    seeded = {x.id: x.r for x in graph.pagerank(nodes(4), edges((0, 1), (1, 0), (2, 3), (3, 2)), seeds=[0], iterations=30)[0].collect()}
    assert seeded[2] == seeded[3] == 0 and math.isclose(seeded[0] + seeded[1], 1.0)


def test_edges_are_dealt_out_once(spark):
    edges = graph.clean_edges(spark.createDataFrame([(0, 1), (0, 1), (1, 1), (0, 2), (2, 0)], "src long, dst long"))
    counts = edges.groupBy("src").count()
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counts.collect())) == [(0, 2), (2, 1)]


def test_fusion(spark):
    frame = lambda xs: spark.createDataFrame([(x, float(-i)) for i, x in enumerate(xs)], "id string, score double")
    got = {r.id: r.score for r in retrieval.rrf(frame("abc"), frame("bda")).collect()}
    assert got == pytest.approx({"b": 0.45, "a": 5 / 12, "d": 0.2, "c": 1 / 6})


def test_ndcg(spark):
    gains = [3, 2, 3, 0, 1, 2]
    res = spark.createDataFrame([("q", str(i), i + 1) for i in range(6)], "query_id string, doc string, rank int")
    rel = spark.createDataFrame([("q", str(i), g) for i, g in enumerate(gains)], "query_id string, doc string, gain int")
    r = retrieval.evaluate(res, rel).first()
    assert (r.mrr, r.recall) == (1.0, 1.0) and math.isclose(r.ndcg, 13.848264 / 14.595391, abs_tol=1e-6)


def test_cosine(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0]), ("c", [1.0, 0.0, 0.0, 1.0]), ("z", [0.0] * 4)], "id string, embedding array<float>")
    assert [r.id for r in retrieval.cosine_top_k(v, [1, 0, 0, 0], 2).collect()] == ["a", "c"]
    assert retrieval.cosine_top_k(v, [1, 0, 0, 0], 0).count() == 0
    assert {r.id: r.score for r in retrieval.cosine_top_k(v, [1, 0, 0, 0], 9).collect()}["z"] == 0.0


def test_scalars(spark):
    assert one(spark, S.bezier_score(F.lit(0.248), F.lit(0.5))) == pytest.approx(0.368)
    assert one(spark, S.bezier_score(F.lit(0.5), F.lit(0.5))) == pytest.approx(0.6875)
    assert one(spark, S.canonical_repo_url(F.lit(" HTTPS://GitHub.com/Own/Repo.git/ "))) == "https://github.com/Own/Repo"
    assert one(spark, S.owner_name(F.lit("https://h/own/repo.git"))) == "own/repo"
    assert one(spark, S.owner_name(F.lit("https://h/own/repo/x"))) is None
    assert [one(spark, S.format_wait(F.lit(x))) for x in (44.2, 750.0, 3600.0)] == ["45s", "12m 30s", "1h 0m"]
    assert one(spark, S.spdx_tag(F.lit("// SPDX-License-Identifier: Apache-2.0\nx"))) == "Apache-2.0"
    assert one(spark, S.spdx_tag(F.lit("/* SPDX-License-Identifier: MIT OR Apache-2.0 */"))) == "MIT OR Apache-2.0"
    assert one(spark, S.spdx_tag(F.lit("none"))) is None
    assert one(spark, S.lines_of(F.lit("a\r\nb\n"))) == ["a", "b"] and one(spark, S.lines_of(F.lit(""))) == []
    s = one(spark, S.sanitize(F.lit("\x1b[31mred\x1b[0m\x07 ‮x")))
    assert (s.text, s.bidi_escaped, s.controls_stripped) == ("red <U+202E>x", 1, 3)
    kinds = {"Foo::bar": 1, "foo": 1, "call foo()": 1, "parse_json fast": 1, "how to retry": 0, "": 0, "getX of y": 1, ".field of it": 1}
    for q, ident in kinds.items():
        assert one(spark, S.classify_query(F.lit(q))) == ("identifier" if ident else "natural_language"), q


def test_rank_parts_sum_to_score(spark):
    cols = "repo_url string, stars long, forks long, dependents_count long, last_push_days_ago int, archived boolean, release_cadence double, issue_response_days double, openssf_score double, awesome_list_memberships int, hn_mentions int, license_present boolean, has_tests_heuristic boolean, centrality double"
    rows = [("a", 5000, 100, 50, 10, False, 12.0, 3.0, 8.0, 2, 5, True, True, 0.5), ("b", 0, 0, 0, None, True, None, None, None, 0, 0, False, False, None), ("c", 10, 1, 0, 2000, True, 1.0, 60.0, 0.0, 9, 99, True, False, 2.0)]
    for r in rank.score(spark.createDataFrame(rows, cols)).collect():
        d = r.asDict()
        assert math.isclose(sum(v for k, v in d.items() if k.startswith("c_")), r.score, abs_tol=1e-12)
    assert {r.repo_url: r.gate for r in rank.score(spark.createDataFrame(rows, cols)).collect()} == {"a": 1.0, "b": 0.25, "c": 0.125}


def test_dedup_tiers(spark):
    random.seed(1)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(400)]
    near = list(base)
    for i in range(0, 400, 100):
        near[i] = "edited"
    texts = [" ".join(base), " ".join(base), " , ".join(base).upper(), " ".join(near), "other", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    assert [r.kind for r in dedup.classify(docs).orderBy("seq").collect()] == ["unique", "exact", "token", "near", "unique", "unique"]


def test_shingles_are_made_of_near_candidates_only(spark, monkeypatch):
    random.seed(5)
    texts = [[f"w{random.randint(0, 10**6)}" for _ in range(200)] for _ in range(30)]
    texts += [texts[3], texts[4][:150] + ["edited"] + texts[4][151:]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, content string")
    asked, made = [], dedup.shingled
    monkeypatch.setattr(dedup, "shingled", lambda d, wanted, seq: asked.extend(r.seq for r in wanted.collect()) or made(d, wanted, seq))
    got = {r.seq: (r.kind, r.of) for r in dedup.classify(docs).where("kind <> 'unique'").collect()}
    assert got.pop(30)[0] == "exact" and got == {31: ("near", "4")} and sorted(asked) == [4, 31]
    assert "sh" not in dedup.features(docs).columns


def test_token_rows_and_estimates(spark):
    import hashlib

    texts = ["A\u212ab, c-D\x1fe ", "", " ,.\u00e9 ", None, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    rows, made = dedup.token_rows(docs).orderBy("seq").collect(), dedup.features(docs).orderBy("seq").collect()
    assert [(r.n, r.hash) for r in rows] == [(n, hashlib.sha256(t.encode()).hexdigest()) for n, t in ((5, "a\x1fb\x1fc\x1fd\x1fe\x1f"), (0, ""), (0, ""), (None, ""), (1, "x\x1f"))]
    assert [r.hash for r in rows] == [r.thash for r in made]
    random.seed(6)
    docs = [" ".join(f"w{random.randint(0, 300)}" for _ in range(n)) for n in (59, 60, 400, 3000)]
    got = dedup.prefix_estimates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, content string"), cut=15, least=60).orderBy("seq").collect()
    sets = [({tuple(t[k : k + 5]) for k in range(len(t) - 4)}, {tuple(t[k : k + 5]) for k in range(len(t) - 19)}) for t in (d.split() for d in docs[1:])]
    assert [(r.seq, r.exact, r.same) for r in got] == [(i + 1, pytest.approx(len(a & b) / len(a | b)), 1.0) for i, (a, b) in enumerate(sets)]
    assert all(abs(r.estimate - r.exact) < 0.2 for r in got)


def test_license_match(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it without restriction."
    known = spark.createDataFrame([(0, "MIT", "Copyright <<owner>>\n" + text), (1, "ISC", "Permission to use, copy, modify and distribute this software for any purpose with or without fee is hereby granted.")], "idx int, spdx string, text string")
    ask = spark.createDataFrame([("a", "Copyright 2020 me\n" + text), ("b", text.replace("any person", "anyone")), ("c", "short"), ("d", "x y z " * 40)], "id string, text string")
    got = {r.id: (r.spdx, r.score) for r in dedup.match_licenses(ask, known).collect()}
    assert got["a"] == ("MIT", 1.0) and got["b"][0] == "MIT" and got["c"][0] is None and got["d"][0] is None
    files = spark.createDataFrame([("r", "COPYING", "nope"), ("r", "LICENSE-X", text), ("r", "sub/LICENSE", text), ("q", "src", text)], "repo string, path string, content string")
    assert [(r.repo, r.spdx) for r in dedup.repo_licenses(files, known).collect()] == [("r", "MIT")]


def test_search_matches_brute_force(spark):
    random.seed(2)
    docs = [("r", f"src/f{i}.rs", "\n".join("".join(random.choice("abcdefg .*()_") for _ in range(random.randint(0, 60))) for _ in range(4))) for i in range(80)]
    frame = spark.createDataFrame(docs, "repo string, path string, content string")
    want = {(p, i + 1) for _, p, c in docs for i, line in enumerate(c.split("\n")) if __import__("re").search("abc|b.*ffe", line)}
    got = {(r.path, r.line_no) for r in search.line_matches(frame, Query("abc|b.*ffe", kind="regex", case="sensitive")).collect()}
    assert got == want
    assert search.scored(spark.createDataFrame([("r", "big.txt", "x" * 1_048_577), ("r", "nul.txt", "needle\0")], "repo string, path string, content string"), Query("needle")).count() == 0


def test_anchors_mean_the_ends_of_lines(spark):
    docs = spark.createDataFrame([("r", "a.rs", "first\nuse serde::X;\nlast line"), ("r", "b.rs", "first\r\nuse serde::X;\r\n"), ("r", "c.rs", "a\u2028use serde::X;")], "repo string, path string, content string")
    found = lambda p, case="sensitive": {(r.path, r.line_no) for r in search.line_matches(docs, Query(p, kind="regex", case=case)).collect()}
    assert found("^use serde") == found("serde::X;$") - {("c.rs", 1)} == found("^USE serde::X;$", "insensitive") == {("a.rs", 2), ("b.rs", 2)}
    assert found("^.*use serde") == {("a.rs", 2), ("b.rs", 2), ("c.rs", 1)}
    assert {r.path for r in search.scored(docs, Query("a|use serde", kind="regex", case="sensitive")).collect()} == {"a.rs", "b.rs", "c.rs"}


def test_required_literals_are_required():
    from quarry.plans.language import required_literals

    want = {"ab(cd)?ef": ["ab", "ef"], "serialize_(u8|u16)": ["serialize_u"], r"\.MustParse|ParseU": [], "foob?": ["foo"], "(?i)abc": [], "(?:foo)+bar": ["foo", "bar"], "x{0,3}yz": ["yz"]}
    assert {p: required_literals(Query(p, kind="regex")) for p in want} == want


def test_planned_search_equals_a_scan(spark, tmp_path):
    random.seed(4)
    texts = ["".join(random.choice("abcKks .*()_\n") for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame([(i, "r", f"f{i}.rs", t) for i, t in enumerate(texts)], "doc_id long, repo string, path string, content string")
    search.save_index(docs, str(tmp_path / "index"))
    index = search.Index(spark, str(tmp_path / "index"))
    for q in (Query("abc"), Query("kab"), Query("bca", case="sensitive"), Query("abc|bca", kind="regex", case="sensitive"), Query("ab.*cab$", kind="regex", case="sensitive")):
        assert {tuple(r) for r in index.search(q).select("path", "score").collect()} == {tuple(r) for r in search.scored(docs, q).select("path", "score").collect()}
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").json(str(tmp_path / "index" / "manifest"))
    with pytest.raises(ValueError, match="version"):
        search.Index(spark, str(tmp_path / "index"))


def test_packed_postings_equal_plain_ones(spark, tmp_path, monkeypatch):
    random.seed(7)
    monkeypatch.setattr(search, "PACKED_BYTES", 1000)
    texts = ["".join(random.choice("ab é") for _ in range(random.choice([0, 2, 3, 4, 40, 900]))) for _ in range(40)]
    ids = [random.getrandbits(64) - 2**63 for _ in range(40)]
    for kind, own in (("long", ids), ("string", list(map(str, ids))), ("int", list(range(40)))):
        docs = spark.createDataFrame([(i, "r", f"f{i}.rs", t) for i, t in zip(own, texts, strict=True)], f"doc_id {kind}, repo string, path string, content string").repartition(3)
        want = {(r.gram, r.doc_id, tuple(r.offsets)) for r in search.trigrams(docs).collect()}
        rows = search.packed(docs)
        assert sorted((r.gram, r.doc_id, tuple(r.offsets)) for r in search.unpacked(rows).collect()) == sorted(want)
        assert kind == "string" or rows.count() < len(want)
    search.save_index(docs, str(tmp_path / "index"))
    grams = sorted({g for g, _, _ in want})[:5]
    got = search.Index(spark, str(tmp_path / "index")).postings(grams)
    assert {(r.gram, r.doc_id, tuple(r.offsets)) for r in got.collect()} == {w for w in want if w[0] in grams}


def test_best_of_a_large_group_of_near_copies(spark):
    random.seed(3)
    base = [f"w{random.randint(0, 999999)}" for _ in range(400)]
    rows = []
    for i in range(300):
        own = list(base)
        for j in random.sample(range(400), 1 + i % 4):
            own[j] = f"e{random.randint(0, 999999)}"
        rows.append((i, " ".join(own)))
    got = {r.seq: (r.of, r.similarity) for r in dedup.classify(spark.createDataFrame(rows, "doc_id long, content string")).where("kind = 'near'").collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(396)} for _, t in rows]
    for i in range(1, 300):
        best = max(((len(sets[i] & sets[j]) / len(sets[i] | sets[j]), -j) for j in range(i)))
        assert got[i] == (str(-best[1]), pytest.approx(best[0]))


def test_score_components(spark):
    docs = spark.createDataFrame([("r", "src/needle.rs", "needle here\nmy needles"), ("r", "tests/a.rs", "needles")], "repo string, path string, content string")
    a, b = search.top(search.scored(docs, Query("needle"))).collect()
    assert (a.whole_word, a.filename_match, a.definition_path, a.test_path) == (2.0, 2.0, 1.0, 0.0)
    assert (b.whole_word, b.test_path) == (0.0, -1.0)


def test_envelopes():
    random.seed(3)
    for _ in range(100):
        rows = [{"v": "é" * random.randint(0, 1199)} for _ in range(random.randint(0, 119))]
        e = envelope(rows, len(rows), False, ["w" * random.randint(0, 100)])
        assert len(json.dumps(e, ensure_ascii=False).encode()) <= 25_000
        assert e["results"] == rows[: len(e["results"])]
    assert clean({"a": ["\x1b[1mx\x07"], "b": "y" * 501})["b"].endswith("…[+1 chars truncated]")
    assert cursor("off:7") == 7


def test_tools(spark):
    docs = spark.createDataFrame([("org/a", "src/x.rs", "hotset_needle\nl2"), ("org/a", "README.md", "# title\nhotset_needle doc"), ("org/b", "src/y.py", "none")], "repo string, path string, content string")
    t = Tools(docs)
    assert t.call("search_code", {"probes": ["hotset_needle"]})["results"][0]["files"] == 2
    assert t.call("repo_profile", {"repo": "ORG/A"})["results"][0]["languages"] == ["markdown", "rust"]
    assert [r["path"] for r in t.call("repo_tree", {"repo": "org/a"})["results"]] == ["README.md", "src/x.rs"]
    assert t.call("fetch_file", {"repo": "org/a", "path": "src/x.rs", "start": 2})["results"][0]["text"] == "l2"
    assert t.call("fetch_docs", {"repo": "org/a", "probe": "NEEDLE"})["results"][0]["n_lines"] == 1
    assert t.call("list_repos", {"names": "B"})["total"] == 1
    for name, args, kind in (("nope", {}, "unknown_tool"), ("guide", {"x": 1}, "unknown_parameter"), ("list_repos", {"limit": 99}, "bad_limit"), ("list_repos", {"cursor": "7"}, "bad_cursor"), ("repo_tree", {"repo": "zz"}, "unknown_repo"), ("search_code", {"probes": []}, "bad_parameter"), ("search_code", {"probes": ["ab"]}, "not_indexable")):
        assert t.call(name, args)["error"]["kind"] == kind


def test_totals_of_a_code_search_have_no_cap(spark):
    many = spark.range(search.PROBE_CAP + 1).select(F.lit("org/a").alias("repo"), F.concat(F.lit("src/needle"), F.col("id").cast("string")).alias("path"), F.lit("needle").alias("content"))
    low = spark.createDataFrame([("org/b", "tests/x.py", "my needles")], "repo string, path string, content string")
    got = Tools(many.union(low)).call("search_code", {"probes": ["needle"], "limit": 1})
    assert (got["total"], got["has_more"], got["results"][0]["files"]) == (2, True, search.PROBE_CAP + 1)


def test_rejected_contents_do_not_go_to_python(spark):
    texts = [None, b"", b"plain", b"a\0b", bytes(range(1, 256)), b"x" * 1_048_577, b"x" * 1_048_576]
    rows = search.gate(spark.createDataFrame(list(enumerate(texts)), "id long, content binary")).select("id", "reason")
    assert [r.reason for r in rows.orderBy("id").collect()] == [None, None, None, "binary_nul", "high_entropy", "too_large", None]
    node = rows._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "ArrowEvalPython":
        node = node.children().apply(0)
    kept = node.children().apply(0).output()
    assert {kept.apply(i).name() for i in range(kept.size())} == {"id", "_reason", "_left"}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in (("src/a.py", b"x = 1\n"), ("src/b.bin", b"\xff\xfe"), (".git/c", b"no"), ("node_modules/d.js", b"no")):
        (tmp_path / name).write_bytes(data)
    assert {r.path for r in tables.walk(spark, str(tmp_path)).collect()} == {"src/a.py", "src/b.bin", "node_modules/d.js"}
    assert [r.path for r in tables.walk(spark, str(tmp_path), index=True, extensions=tables.SOURCE_EXTENSIONS).collect()] == ["src/a.py"]
    rows = spark.createDataFrame([("100644", "blob", "a/b", 5), ("120000", "blob", "l", 1), ("160000", "commit", "s", 1), ("100644", "blob", "../x", 1), ("100644", "blob", "big", 1 << 21)], "mode string, kind string, path string, size long")
    assert [r.path for r in tables.safe_tree_rows(rows).collect()] == ["a/b"]
    b = tables.blobs(spark.createDataFrame([("x",), ("x",), ("y",)], "content string"))
    tables.put(b, str(tmp_path / "cas"))
    assert all(r.intact for r in tables.get(spark, str(tmp_path / "cas"), b).collect())


def test_streams(spark, tmp_path):
    chunks = spark.createDataFrame([("r", 0, "event: matches\ndata: [1"), ("r", 1, ",2]\n\nevent: done\nda"), ("r", 2, "ta: {}\n\nevent: x\ndata: half")], "request string, seq int, chunk string")
    assert [(r.idx, r.event, r.data) for r in streams.parse_events(chunks).orderBy("idx").collect()] == [(0, "matches", "[1,2]"), (1, "done", "{}")]
    gaps = spark.createDataFrame([("b", 0.0), ("b", 6.0), ("b", 8.0)], "backend string, at double")
    assert [r.early for r in streams.permit_gaps(gaps, 10).orderBy("at").collect()] == [False, False, True]
    schema = "repo string, path string, content string, seq long"
    land, store = str(tmp_path / "land"), str(tmp_path / "store")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    def apply(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        streams.reindex(spark, land, store, str(tmp_path / "cp"), schema).awaitTermination()
        return {(r.repo, r.path, r.content) for r in streams.read_store(spark, store).collect()}

    assert len(apply([("a", "1", "old", 1), ("a", "2", "keep", 1), ("b", "1", "b", 1)])) == 3
    assert apply([("a", "1", "new", 2), ("a", "2", "bad\0", 5)]) == {("a", "1", "new"), ("b", "1", "b")}
    assert apply([("a", "2", "late", 3)]) == {("a", "1", "new"), ("b", "1", "b")}  # older than the deletion
    assert apply([("b", "1", None, 9)]) == {("a", "1", "new")}  # a repo without documents left
    assert apply([("b", "1", "again", 10)]) == {("a", "1", "new"), ("b", "1", "again")}


def test_cooldowns(spark, tmp_path):
    land = str(tmp_path / "limits")
    spark.createDataFrame([("x", 0.0, None), ("x", 10.0, 20.0), ("x", 100.0, 9999.0), ("y", 5.0, 1.0)], "backend string, at double, wait double").coalesce(1).write.parquet(land)
    stream = spark.readStream.schema("backend string, at double, wait double").parquet(land)
    q = streams.cooldowns(stream).writeStream.format("memory").queryName("cooldowns").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.backend, r.at, r.until) for r in spark.table("cooldowns").collect()} == {("x", 0.0, 60.0), ("x", 10.0, 60.0), ("x", 100.0, 3700.0), ("y", 5.0, 6.0)}


def test_chunks_and_hybrid(spark):
    source = "import os\n\n# doc\n@deco\ndef retry_backoff(x):\n    return x\n\nclass A:\n    def run(self):\n        return os\n"
    docs = spark.createDataFrame([("r", "a.py", source), ("r", "broken.py", "def ("), ("r", "b.txt", "fn retry_backoff() {}\n" * 70)], "repo string, path string, content string")
    got = {(r.path, r.kind, r.symbol, r.start_line, r.end_line) for r in semantic.chunks(docs).collect()}
    assert got == {("a.py", "function", "retry_backoff", 3, 6), ("a.py", "class", "A", 8, 10), ("a.py", "method", "A.run", 9, 10), ("broken.py", "window", None, 1, 1), ("b.txt", "window", None, 1, 60), ("b.txt", "window", None, 51, 70)}
    index = semantic.index_source(docs)
    v = index.where("symbol = 'A.run'").first().embedding
    assert len(v) == 256 and math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-5)
    fused = semantic.hybrid_search(docs, index, "how does the retry work", "retry_backoff").collect()
    assert fused[0].lex > 0 and fused[0].dense > 0
    assert all(r.dense == 0 for r in semantic.hybrid_search(docs, index, "retry_backoff", "retry_backoff").collect())


def test_a_search_chunks_each_document_once(spark):
    docs = spark.createDataFrame([("r", "a.py", "def f():\n    return 1\n"), ("r", "b.txt", "plain words\n" * 120), ("r", "c.txt", None), ("r", "d.txt", "")], "repo string, path string, content string")
    best = semantic.search_chunks(semantic.index_source(docs), "plain words", 9)
    assert best._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2  # syntax items and embeddings
    assert sorted((r.id, r.symbol, r.locator) for r in best.collect()) == [("r/a.py:1-2", "f", "a.py:1"), ("r/b.txt:1-60", None, "b.txt:1"), ("r/b.txt:101-120", None, "b.txt:101"), ("r/b.txt:51-110", None, "b.txt:51")]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_buckets_are_fnv():
    words = ["", "a", "foobar", "\u00e9t\u00e9", "x" * 300]

    def plain(w, h=0xCBF29CE484222325):
        for b in w.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h % 256

    assert semantic._buckets(words, 256).tolist() == [plain(w) for w in words] and plain("foobar") == 0x85944171F73967E8 % 256
    assert semantic._WORDS.findall("a_b \u00e9\u0661-c") == ["a", "b", "\u00e9\u0661", "c"]


def test_backends(spark):
    assert one(spark, backends.strip_delimiters(F.lit("/a.b/"))) == ("a.b", True) and one(spark, backends.strip_delimiters(F.lit("//"))) == ("//", False)
    assert one(spark, backends.blob_url(F.lit(" https://github.com/o/r/blob/main/src/x.rs/ "))) == ("o/r", "src/x.rs", "https://github.com/o/r/blob/main/src/x.rs")
    assert one(spark, backends.blob_url(F.lit("https://github.com/o/r/tree/x"))) is None
    assert [one(spark, backends.line_no(F.lit(x))) for x in ("  12│ x", "7: y", "x 3", "44")] == [12, 7, None, None]
    assert one(spark, backends.qualifier_value(F.lit(' a "b" '))) == '"a b"'
    assert backends.rate_limit_wait({"retry-after": "99999"}, 0) == 3600 and backends.rate_limit_wait({"x-ratelimit-reset": "110"}, 100.5) == 10
    assert backends.rate_limit_wait({"x-ratelimit-remaining": "3", "x-ratelimit-reset": "110"}, 100) is None
    assert backends.is_rate_limited(403, {"retry-after": "1"}) and not backends.is_rate_limited(403, {})
    repos = spark.createDataFrame([("a/b", "x", 1)], "repo string, what string, stars int")
    assert search.concise(repos, "search_code").columns == ["repo"] and search.match_repos(repos.withColumn("topics", F.array(F.lit("t"))).withColumn("catch", F.lit("")), " ; ").count() == 0
