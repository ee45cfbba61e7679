"""The training-data operators against brute force, round trips, held-out accuracy, and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

pytest.importorskip("quarry.llm")
from pyspark.sql import functions as F  # noqa: E402

from quarry.llm import bpe, chaining, decontaminate, language, licenses, minhash, pfor, sampling, suffix, warc  # noqa: E402
from quarry.llm import kernels as K  # noqa: E402
from quarry.llm.catalog import ORACLES, QUERIES  # noqa: E402
from quarry.llm.components import components  # noqa: E402
from quarry.llm.shared import scratch  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


EDGES = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "x"), (4, "zero\0byte é 日本 " * 3), (5, "!!! ..."), (6, "long " * 30000)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, same):
    same(QUERIES[name], ORACLES[name])


# -- 1


def removed(texts_, n):
    count = Counter(t[i : i + n] for t in texts_ for i in range(len(t) - n + 1))
    out = []
    for t in texts_:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i : i + n] = True
        out.append((len(t), int(hit.sum()), int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum()), hashlib.sha256(bytes(b for b, k in zip(t, hit, strict=True) if not k)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [3, 8, 15])
def test_transform_finds_all_long_repeats(length):
    random.seed(length)
    for _ in range(25):
        parts = [bytes(random.choice(b"ab\0c") for _ in range(random.randint(1, 80))) for _ in range(6)]
        parts += [parts[0][5:40] + parts[1][:30], parts[2]]
        count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in parts]
        assert [g.tolist() for g in suffix.long_repeats(parts, length)] == want


def test_suffix_dedup(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in suffix.op1_suffix_dedup(spark, DATA).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    ids = sorted(texts)
    assert [got[i] for i in ids] == removed([texts[i].encode() for i in ids], 400)


def test_suffix_dedup_large_buckets_and_edges(spark):
    random.seed(7)
    common = "".join(random.choice("abcdefgh ") for _ in range(90))
    rows = [(i, "".join(random.choice("abcdefgh ") for _ in range(60)) + common + "".join(random.choice("abcdefgh ") for _ in range(60))) for i in range(30)] + EDGES
    rows += [(200 + i, "".join(random.choice("abcdefgh ") for _ in range(random.randint(0, 60))) + common[random.randint(0, 20) : random.randint(70, 90)] + "".join(random.choice("abcdefgh ") for _ in range(random.randint(0, 60)))) for i in range(60)]
    for large in (1, 300, 3000, 1 << 20):  # buckets are divided to the end, some rounds, never
        clash = frame(spark, rows).withColumns({"kept": F.lit(1), "t": F.lit(2), "spans": F.lit(3), "s.t": F.lit(4)})
        out = suffix.remove_repeats(clash, length=40, anchor=10, large=large)
        assert out.columns == ["doc_id", "text", "t", "spans", "s.t", "removed", "n_bytes", "kept"]
        got = Counter((r.doc_id, r.n_bytes, sum(x.b - x.a for x in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
        want = removed([(t or "").encode() for _, t in rows], 40)
        assert got == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


# -- 2, 9


def test_bpe_equals_the_library(tokenizer, texts):
    c = bpe.Codec(bpe.default_path())
    random.seed(4)
    pieces = ["a", "th", "ing", "S", "'s", "'", "'l", "l", "r", "!", "!!", "1", "é", "É", "Σ", "ß", " ", "\n", "日", "́", "<|endoftext|>", "</w>", "²", "İ", " ", "\x1c", "ـ", "𝒳"]
    sample = [None, "", *texts.values(), "a" * 3000, *("".join(random.choice(pieces) for _ in range(random.randint(0, 30))) for _ in range(2000)), *("".join(random.choice("aabbeinst'") for _ in range(40)) for _ in range(300))]
    flat, n = c.encode(sample)
    cut = np.concatenate(([0], np.cumsum(n)))
    for k, text in enumerate(sample):
        want, got = tokenizer.encode(text or "", add_special_tokens=False).ids, flat[cut[k] : cut[k + 1]]
        assert got.tolist() == want
        assert c.decode(got.tobytes()) == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_frames(spark, tokenizer):
    rows = frame(spark, EDGES).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(rows)).collect()
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGES)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert bpe.encode(frame(spark, [])).count() == 0
    digests = {r.doc_id: r for r in bpe.op2_bpe(spark, DATA).limit(5).collect()}
    assert all(len(r.ids_sha256) == 64 for r in digests.values())


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 2, 50000, 1 << 31])
def test_blocks_round_trip(n, top):
    x = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    if n > 10:
        x[[0, n // 2]] = 4294967295
    blocks = pfor.pack(x)
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
    assert not blocks and n == 0 or (pfor.unpack(b"".join(blocks), starts) == x).all()


def test_token_files(spark, tokenizer, texts):
    rows, at = pfor.op9_token_files(spark, DATA).orderBy("doc_id").collect(), 0
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert tuple(r) == (r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(texts)
    edge = pfor.read(pfor.write(frame(spark, EDGES), scratch(spark, "t")), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in edge] == [None, 1, 2, 3, 3, 4, 5, 6] and edge[1].ids == [2]
    assert [r.start for r in edge] == np.cumsum([0, *(r.n_tokens for r in edge)])[:-1].tolist()
    assert pfor.read(pfor.write(frame(spark, []), scratch(spark, "t"))).count() == 0


# -- 3


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs)
    held_out = docs.where(language.label_hash("text", "lang") > model.cut)
    assert 50 < held_out.count() < docs.count()
    out = language.detect(held_out, model, text=F.col("text")).collect()
    assert sum(r.text_language == r.lang for r in out) / len(out) > 0.95


def test_fused_evidence_on_held_out_labels(spark):
    """Texts cut to a few letters, declarations wrong in a tenth of cases, hosts of mostly one language: together they beat each alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    langs = [x for x in model.langs if x != "und"]
    held = docs.where(language.label_hash("text", "lang") > model.cut).where(F.length("text") > 20)
    pick = lambda salt: F.element_at(F.array(*map(F.lit, langs)), (F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(len(langs))) + 1).cast("int"))
    chance = lambda salt, share: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1000)) < 1000 * share
    ask = held.select("lang", F.substring("text", 1, 7).alias("text"), F.when(chance(1, 0.1), pick(2)).otherwise(F.col("lang")).alias("said"), F.concat(F.when(chance(3, 0.2), pick(4)).otherwise(F.col("lang")), F.lit(".example.org")).alias("host"))
    out = language.detect(ask, model, text=F.col("text"), declared=F.col("said"), host=F.col("host")).collect()
    right = lambda f: sum(f(r) == r.lang for r in out) / len(out)
    text, said, fused = right(lambda r: r.text_language), right(lambda r: r.said), right(lambda r: r.language)
    assert fused > max(text, said) and fused > 0.95, (text, said, fused)


def test_language_evidence_and_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs)
    rows = [(1, None, "fr", "s"), (2, "", None, None), (3, "12 34 #!", "en", "s"), (4, "the", "en", "s"), (5, "x9q" * 4, "fr", "s")]
    ask = frame(spark, rows, "doc_id long, text string, lang string, source string").withColumn("accepted", F.lit("clash"))
    got = {r.doc_id: r for r in language.detect(ask, model, text=F.col("text"), declared=F.col("lang"), host=F.col("source")).collect()}
    assert [got[i].language for i in (1, 2, 3)] == ["und"] * 3 and not got[1].accepted and got[4].accepted and got[4].language == "en"
    assert language.detect(ask, language.Model([], np.zeros((language.BUCKETS, 0))), text=F.col("text")).where("accepted").count() == 0
    assert language.detect_documents(docs.limit(0)).count() == 0
    page = spark.range(1).select(F.lit('<html data-x="1" LANG="FR-ca"><script>x</script><p>mot</p>').alias("h"), F.lit("https://u@Sub.Example.DE:8/es/a").alias("u"))
    r = page.select(language.html_language(F.col("h")), F.trim(language.html_text(F.col("h"))), language.url_host(F.col("u")), language.url_language(F.col("u"))).first()
    assert tuple(r) == ("fr", "mot", "sub.example.de", "de")
    pages = QUERIES["language_id_pages"](spark, DATA).collect()
    assert sum(r.accepted for r in pages) >= 0.9 * len(pages)


# -- 4


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in sampling.op4_fingerprints(spark, DATA).collect()}
    ids, sep = sorted(texts), re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def bag(t):
        w = sep.split(t.lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    off, seen = [], {}
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        a, b = bag(t), bag(edited)
        off.append(got[i].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.16


def test_fingerprint_weights_and_edges(spark):
    a, b = "p q r s t " * 20 + "u v w x y", "p q r s t " * 10 + "u v w x y z"
    rows = [(i, t) for i, t in enumerate([a, b] * 150)]
    out = sampling.fingerprints(frame(spark, [(0, a), (1, b)]), ["doc_id"], samples=64).collect()
    assert len(out[0].s) == 64
    got = sampling.with_neighbours(frame(spark, rows[:2])).collect()
    assert all(0 < r.near_next < 1 for r in got)
    edge = {(r.doc_id, r.n_chars): r for r in sampling.with_neighbours(frame(spark, EDGES)).collect()}
    assert edge[(1, 0)].fingerprint == "" and edge[(1, 0)].near_edited == 1.0 and edge[(1, 0)].near_next == 1.0
    assert edge[(2, 0)].near_next == 0.0 and edge[(3, 13)].n_chars == 13 and (None, 1) in edge
    one = sampling.with_neighbours(frame(spark, [(1, "only one")])).first()
    assert one.near_next == 1.0
    assert sampling.with_neighbours(frame(spark, [])).count() == 0


# -- 5


def test_chain_score_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(2, 25)
        a, b = rng.integers(0, 60, n), rng.integers(0, 60, n)
        order, f = sorted(range(n), key=lambda i: (a[i], -b[i])), [0.0] * n
        for x, i in enumerate(order):
            f[i] = 6 + max([0, *(f[j] - 0.05 * (a[i] - a[j] + b[i] - b[j]) for j in order[:x] if a[j] < a[i] and b[j] < b[i])])
        if found := chaining.chain(a, b):
            own = found[0]
            assert abs(6 * len(own) - 0.05 * (a[own[-1]] - a[own[0]] + b[own[-1]] - b[own[0]]) - max(f)) < 1e-9
            assert all(a[i] < a[j] and b[i] < b[j] for i, j in zip(own, own[1:], strict=False))


def planted(n=40, size=70):
    random.seed(5)
    new = lambda k: [f"x{random.randint(0, 10**6)}" for _ in range(k)]
    passages, rows = [new(size) for _ in range(5)], []
    for i in range(n):
        w = new(200)
        if i < n // 2:
            p = list(passages[i % 5])
            for j in random.sample(range(size), 3):
                p[j] = new(1)[0]
            if i % 2:
                del p[33]
            w = w[:100] + p + w[100:]
        rows.append((i, " ".join(w)))
    return rows


def test_fuzzy_passages(spark):
    rows = planted()
    got = chaining.repeated_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(20))
    assert all(90 <= r.start_word <= 112 and 158 <= r.end_word <= 180 and r.partner_id % 5 == r.doc_id % 5 for r in got)
    left = {r.doc_id: len(r.text.split()) for r in chaining.cut(frame(spark, rows).withColumn("s", F.lit(1))).collect()}
    assert sum(v < 215 for k, v in left.items() if k < 20) >= 14 and all(left[i] == 200 for i in range(20, 40))
    edge = chaining.repeated_passages(frame(spark, [*EDGES, (7, rows[30][1]), (8, rows[30][1]), (None, rows[30][1])])).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.kept) for r in edge} == {(7, 0, 200, True), (8, 0, 200, False), (None, 0, 200, False)}
    assert chaining.repeated_passages(frame(spark, [])).count() == 0
    assert chaining.cut(frame(spark, EDGES)).count() == len(EDGES)


def test_wide_gaps_are_compared_exactly():
    rng = np.random.default_rng(8)
    for n, m, kinds in [(0, 5, 3), (5, 0, 3), (70, 65, 9), (250, 260, 40), (300, 220, 5000)]:
        x, y = rng.integers(0, kinds, n), rng.integers(0, kinds, m)
        row = [0] * (m + 1)
        for v in x.tolist():
            last = 0
            for j, u in enumerate(y.tolist(), 1):
                last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
        assert chaining._common(x, y) == row[m]
    assert chaining._common(np.arange(250) % 50, np.arange(250) % 50) == 250


def test_spans_of_many_partners_are_all_kept(spark):
    rows = [(1, 1000 - 10 * i, 1005 - 10 * i, 2 + i, 0, 5, 5) for i in range(100)]
    found = spark.createDataFrame(rows, "a long, a_start long, a_end long, b long, b_start long, b_end long, matched long")
    assert sorted((r.s, r.e) for r in chaining.text_spans(found).where("t = 1").collect()) == sorted((x[1], x[2]) for x in rows)


def test_passages_of_frequent_lines(spark):
    random.seed(6)
    new = lambda k: [f"x{random.randint(0, 10**6)}" for _ in range(k)]
    rows, pairs = [], []
    for _ in range(12):
        x, y = new(30), new(30)
        pairs.append((len(rows), len(rows) + 1))
        rows += [new(80) + x + y + new(80) for _ in range(2)]
        rows += [new(80) + line + new(80) for line in (x, y) for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {(r.doc_id, r.partner_id) for r in chaining.repeated_passages(frame(spark, rows)).collect() if r.start_word <= 80 and r.end_word >= 140}
    assert got == {p for a, b in pairs for p in ((a, b), (b, a))}



def test_passages_of_frequent_seeds_only(spark):
    """Forty texts with a passage of which every third is in 300 others: its seeds, and all runs of them, are frequent, and their first and last texts have a third only."""
    random.seed(11)
    new = lambda k: [f"x{random.randint(0, 10**6)}" for _ in range(k)]
    passage = new(66)
    rows = [new(30) + passage + new(30) for _ in range(40)]
    rows += [new(30) + passage[k : k + 26] + new(30) for k in (0, 20, 40) for _ in range(300)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = chaining.repeated_passages(frame(spark, rows)).collect()
    whole = [r for r in got if r.start_word <= 30 and r.end_word >= 96]
    assert {r.doc_id for r in got} == set(range(40))
    assert sum(r.kept for r in whole) == 39 and sum(not r.kept for r in whole) == 39


def test_stretches_beside_each_other_in_any_place(spark):
    # 45 words "w" in both; the second text has more of them, so nearer matches on other diagonals make chains that are no passage
    words = lambda k, n: [f"x{k}y{i}" for i in range(n)]
    rows = [[*words(k, 20), *["w"] * (45 + k % 4), *words(k + 100, 20)] for k in range(40)]
    spans = {}
    for r in chaining.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert all(spans.get(i, set()) >= set(range(20, 65 + i % 4)) for i in range(40) if i % 4 < 3)


def test_chains_keep_straight_runs(spark):
    # matches of a stretch of 45 words beside one of 48, as the cells give them: a chain prefers nearer matches on two diagonals
    rows = [(1, 2, x, y) for x, y in ((286, 345), (316, 384), (310, 369), (316, 375), (286, 354), (310, 378))]
    got = chaining.chains(spark.createDataFrame(rows, "a bigint, b bigint, pa int, pb int")).collect()
    assert len(got) == 1
    runs = {(r.a, r.b, r.n) for own in got[0].many for r in own}
    assert {b - a for a, b, n in runs if n >= 23} == {59, 68}


def test_bound_of_matched_words_loses_no_passage(spark):
    # short stretches of frequent words side by side: texts with two of them in the same order share 46 words, others never reach a passage
    rng = np.random.default_rng(11)
    vocab, rows = [f"v{i}" for i in range(6)], []
    for k in range(60):
        x = rng.permutation(6)[:4]
        rows.append([*[f"s{k}t{i}" for i in range(8)], *[w for v in x for w in [vocab[v]] * 23], *[f"e{k}t{i}" for i in range(8)]])
    spans = {}
    for r in chaining.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    at = {}
    for k, w in enumerate(rows):
        for i in range(8, len(w) - 8 - 45):
            at.setdefault(tuple(w[i : i + 46]), set()).add((k, i))
    for places in at.values():
        if len({k for k, _ in places}) > 1:
            for k, i in places:
                assert spans.get(k, set()) >= set(range(i, i + 46))


def test_pipeline_cuts_passages_of_frequent_seeds_only(spark):
    import corpus_pipeline as p

    random.seed(13)
    new = lambda k: [f"x{random.randint(0, 10**6)}" for _ in range(k)]
    rows = [new(40) + ["again"] * 80 + new(40) for _ in range(40)]
    out = p.cut_repeated_passages(spark, frame(spark, [(i, " ".join(w)) for i, w in enumerate(rows)]), DATA)
    assert sorted(r.text.count("again") > 40 for r in out.collect()) == [False] * 39 + [True]


def test_pipeline_cuts_passages_beyond_those_of_frequent_seeds(spark):
    """Two of a hundred texts with one passage have six words more in common on either side, in which there is no seed."""
    import corpus_pipeline as p

    random.seed(65)  # all seeds that these two have in common, and runs of them, are in all texts
    new = lambda k: [f"x{random.randint(0, 10**6)}" for _ in range(k)]
    passage = new(60)
    rows = [" ".join(new(100) + passage + new(100)) for _ in range(100)]
    before, after, two = new(6), new(6), (40, 60)
    for i in two:
        w = rows[i].split()
        w[94:100], w[160:166] = before, after
        rows[i] = " ".join(w)
    order = sorted(range(100), key=lambda i: int.from_bytes(hashlib.sha256(rows[i].encode()).digest()[:8], "big", signed=True))
    first, second = sorted(two, key=order.index)
    assert 9 < order.index(first) < order.index(second) < 90  # neither is a hub
    out = {r.doc_id: r.text.split() for r in p.cut_repeated_passages(spark, frame(spark, list(enumerate(rows))), DATA).collect()}
    assert len(out[second]) == 260 - 72 and not {*before, *after} & {*out[second]}
    assert {*before, *after} < {*out[first]}


def test_one_frequent_word_over_and_over(spark):
    random.seed(12)
    new = lambda k: [f"x{random.randint(0, 10**6)}" for _ in range(k)]
    sizes = [20, 30, 60, 61, 75, 400] * 15
    rows = [new(40) + (["long", "again"] * n if i % 2 else ["long"] * n)[:n] + new(40) for i, n in enumerate(sizes)]
    covered = [np.zeros(len(w), bool) for w in rows]
    for r in chaining.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect():
        covered[r.doc_id][r.start_word : r.end_word] = True
    for n, c in zip(sizes, covered, strict=True):
        assert c[42 : 38 + n].all() if n >= 60 else not c.any(), n


def test_stretches_of_a_seed():
    for p, q, u, v, step in [(3, 300, 7, 80, 1), (3, 3 + 298, 7, 7 + 298, 2), (10, 60, 100, 900, 2), (5, 6, 5, 6, 1)]:
        x, y = chaining._stretches(p, q, u, v, step)
        assert len(x) == len(y) and ((x - p) % step == 0).all() and ((y - u) % step == 0).all()
        assert (x.min(), x.max(), y.min(), y.max()) == (p, q, u, v)
        for z in (x, y):  # one place follows another closely enough to be one run
            assert np.diff(np.unique(z)).max(initial=0) <= 2 * chaining.SPARSE


# -- 6


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = frame(spark, [(1, item), (2, "tiny item"), (3, None), (4, "..."), (None, "null id here")], "item_id long, text string")
    rows = [(21, "clean " * 30), (22, "pre ALPHA, beta gamma delta epsilon zeta eta theta iota-kappa post and more words so that most of it stays clean here now"), (23, item), (24, "a tiny item " + "w " * 9), (25, "null id here " + "w " * 9), *EDGES]
    for slice_bytes in (1 << 20, 5):
        found = decontaminate.scan(frame(spark, rows).withColumn("hit_items", F.lit("clash")), bench, slice_bytes=slice_bytes)
        got = {r.doc_id: ([(x.start, x.end) for x in r.hit_spans], r.hit_items) for r in found.collect()}
        assert got[22] == ([(1, 11)], ["1"]) and got[23] == ([(0, 12)], ["1"]) and got[24] == ([(1, 3)], ["2"]) and got[25] == ([(0, 3)], [])
        assert all(not v[0] for k, v in got.items() if k not in (22, 23, 24, 25))
    kept = {r.doc_id: r.text for r in decontaminate.remove(found).collect()}
    assert 23 not in kept and kept[24].startswith("a  w") and kept[22].startswith("pre  post") and not any(t == item for t in kept.values())
    assert decontaminate.scan(frame(spark, rows), bench.limit(0)).where(F.size("hit_spans") > 0).count() == 0


# -- 7


def test_signature_estimates_weighted_similarity():
    rng, off = np.random.default_rng(1), []
    for _ in range(60):
        a = [f"w{rng.integers(0, 10**6)}" for _ in range(rng.integers(1, 900))]
        b = list(a)
        for i in rng.integers(0, len(b), max(1, len(b) // 50)):
            b[i] = f"zz{i}"
        a, b = a + a[: len(a) // 3], b + b[: len(b) // 4]
        data, o = K.column_bytes(pa.array([" ".join(a), " ".join(b)]))
        r, h, w = minhash.shingles(data, o, 0, 2)
        s, has = minhash.signatures(r, h, w, 2)
        assert has.all() and (s != 0).all()
        off.append((s[0] == s[1]).mean() - minhash._weighted_jaccard((h[r == 0], w[r == 0]), (h[r == 1], w[r == 1])))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_near_duplicates(spark):
    random.seed(9)
    base = [[f"w{random.randint(0, 10**6)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        rows.append((10 * k, " ".join(b)))
        if k < 6:
            near = list(b)
            near[150] = "edited"
            rows += [(10 * k + 1, " ".join(near)), (10 * k + 2, " ".join(b)), (10 * k + 3, " ".join(b[:200] + base[11][:100]))]
    rows += EDGES
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    got = {(r.doc_id, r.class_id, r.class_size) for r in found}
    assert {(10 * k + j, 10 * k, 3) for k in range(6) for j in range(3)} <= got and {(10 * k + 3, 10 * k + 3, 1) for k in range(1, 6)} <= got
    assert {(3, 3, 2), (1, 1, 2), (2, 1, 2), (None, None, 1)} <= got
    kept = sorted((r.doc_id or -1, r.text or "") for r in minhash.deduplicate(frame(spark, rows).withColumn("tid", F.lit(0))).collect())
    assert len(kept) == len({r.root for r in found}) and len({t for _, t in kept}) == len(kept)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0 and minhash.deduplicate(frame(spark, [])).count() == 0


def test_near_duplicates_against_brute_force(spark, texts):
    data, off = K.column_bytes(pa.array(list(texts.values())))
    bags = {}
    for lo, hi in K.slices(off):
        r, h, w = minhash.shingles(data, off, lo, hi)
        for x in range(lo, hi):
            bags[list(texts)[x]] = (h[r == x - lo], w[r == x - lo])
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if texts[i] == texts[j] or len(bags[i][0]) and len(bags[j][0]) and minhash._weighted_jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r.doc_id: r.class_id for r in minhash.op7_near_dedup(spark, DATA).collect()} == {i: root(i) for i in ids}


def edited(base, edits):
    out = list(base)
    for i in random.sample(range(len(out)), edits):
        out[i] = f"e{random.randint(0, 10**9)}"
    return " ".join(out)


def test_one_original_and_a_thousand_near_copies(spark):
    random.seed(11)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base)), *((i, edited(base, 5 + i % 4)) for i in range(1, 1001))]
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert {(r.class_id, r.class_size) for r in got.values()} == {(0, 1001)}
    assert got[0].n_links == 1000 and all(r.n_links >= 1 for r in got.values())


def test_links_of_a_large_group(spark):
    random.seed(12)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(300)] * 2
    rows = [(i, edited(base, 1 + i % 2)) for i in range(900)]
    assert {(r.class_size, r.n_links) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {(900, 899)}


def test_overlaps_equal_the_sums_of_smaller_weights():
    rng = np.random.default_rng(3)
    bags = [(np.sort(rng.choice(90, rng.integers(0, 60), replace=False)).astype(np.uint64), None) for _ in range(40)]
    bags = [(h, rng.choice([1, 1, 1, 2, 7, 30000], len(h)).astype("<u4")) for h, _ in bags]
    low = minhash._overlaps([h for h, _ in bags], [w for _, w in bags], 15)
    for i in range(15):
        for j in range(25):
            x, y = (dict(zip(h.tolist(), w.tolist(), strict=True)) for h, w in (bags[i], bags[15 + j]))
            assert low[i, j] == sum(min(x[k], y[k]) for k in x.keys() & y.keys())


def test_components(spark):
    random.seed(2)
    links = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == root(i) for i in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 8


def test_license_phrases(spark, texts):
    def base(t):
        w, at, names = words(t), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    names.add(label)
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names))

    for r in licenses.op8_license_scan(spark, DATA).collect():
        assert tuple(r)[1:6] == base(texts[r.doc_id]) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    rows = [*EDGES, (10, "x Under the MIT license under THE mit-license. cc-by nc; Apache License, version 2 under"), (11, "cc by nc cc by nc-sa 4.0 é under the mit license"), (12, "SPDX-License-Identifier: BSD-3-Clause"), (13, "licensed under the GNU General Public License version 3"), (14, "mit der in den"), (15, "under the mİt license")]
    got = Counter()
    for r in licenses.scan(frame(spark, rows).withColumn("detections", F.lit("clash"))).collect():
        own = [x for x in r.detections if x.base]
        assert (r.n_words, len(own), min((x.s for x in own), default=None), max((x.s for x in own), default=None), ",".join(sorted({x.label for x in own}))) == base(r.text)
        got[r.doc_id, ",".join(sorted({x.label for x in r.detections}))] += 1
    assert {(10, "apache-2,cc-by-nc,mit"), (11, "cc-by-nc,cc-by-nc-sa,mit"), (12, "bsd-3-clause"), (13, "gpl-3"), (14, ""), (15, "")} <= set(got)


def test_license_rules_pass_the_prefilter(spark):
    assert len(licenses.rules()) > 300
    examples = [p.replace("N", n) for _, _, p in [(0, 0, "licensed under N"), (0, 0, "under the terms of N"), (0, 0, "subject to the N"), (0, 0, "N license")] for n in ("mit", "isc", "zlib", "gpl 3 0", "bsd 3 clause", "mozilla public license version 2", "cc by sa 4 0", "boost software license 1")]
    out = licenses.scan(frame(spark, list(enumerate(examples)))).where(F.size("detections") == 0)
    assert [r.text for r in out.collect()] == []


def rule_example(pattern, last):
    """A text that a rule matches, by the first or the last of each choice."""

    def of(tokens):
        out = ""
        for op, arg in tokens:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                out += chr(arg[-1 if last else 0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][last])
            elif kind == "MAX_REPEAT":
                out += of(arg[2]) * int(min(arg[1], max(arg[0], 3)) if last else arg[0])  # of an open number three
            elif kind == "SUBPATTERN":
                out += of(arg[-1])
            elif kind == "BRANCH":
                out += of(arg[1][-1 if last else 0])
            else:
                assert kind == "ASSERT_NOT"
        return out

    return of(re._parser.parse(pattern))


def test_every_license_rule_alone_and_at_the_end(spark):
    examples = {rule_example(r[4], last) for r in licenses.rules() for last in (False, True)}
    assert all(any(re.fullmatch(r[4], e) for r in licenses.rules()) for e in examples)
    rows = list(enumerate([*examples, *(f"words before {e}" for e in examples), "apache2", "ApacheV2", "see FreeBSD", "0BSD"]))
    out = licenses.scan(frame(spark, rows)).where(F.size("detections") == 0)
    assert [r.text for r in out.collect()] == []


# -- 10


def test_archives(spark):
    long = "a" * 2000
    rows = [(1, "u", long), (2, "v\r\nX: y", long), (3, None, "b" * 999), (4, "z", "b" * 999), (5, "q", None), (2, "v", long), (None, "v", long)]
    index = warc.write(warc.assign(frame(spark, rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))), scratch(spark, "w"))
    back = Counter((r.id, r.payload_bytes, r.record_type, r.refers_to, len(r.payload)) for r in warc.read(index, with_payload=True).collect())
    assert back == Counter([("1", 2000, "revisit", "2", 0), ("2", 2000, "response", None, 2000), ("2", 2000, "response", None, 2000), ("3", 999, "response", None, 999), ("4", 999, "response", None, 999), ("5", 0, "response", None, 0), ("None", 2000, "revisit", "2", 0)])
    some = warc.read(index.where("id in ('3', '5')")).collect()
    assert {r.id for r in some} == {"3", "5"}
    assert warc.read(warc.write(warc.assign(frame(spark, [], "page_id long, url string, html string")), scratch(spark, "w"))).count() == 0


# -- pipeline


def shared_windows(texts_, n=45):
    """Per text: which words lie in a window of n words that another, different text also has; not runs of one or two words over and over."""
    kinds = {t: words(t) for t in set(texts_)}
    where = {}
    for t, w in kinds.items():
        for i in range(len(w) - n + 1):
            if len(set(w[i : i + n])) > 2:
                where.setdefault(hash(tuple(w[i : i + n])), set()).add(t)
    out = {}
    for t, w in kinds.items():
        hit = np.zeros(len(w), bool)
        for i in range(len(w) - n + 1):
            if len(where.get(hash(tuple(w[i : i + n])), ())) > 1:
                hit[i : i + n] = True
        out[t] = hit
    return out


def near_classes(texts_):
    """The smallest id of each text's class: weighted Jaccard similarity of 0.8 or more, or equal texts; all pairs that share a shingle."""
    ids = sorted(texts_)
    data, off = K.column_bytes(pa.array([texts_[i] or "" for i in ids], pa.large_string()))
    bags, owners = [], {}
    for lo, hi in K.slices(off):
        r, h, w = minhash.shingles(data, off, lo, hi)
        cut = np.searchsorted(r, np.arange(hi - lo + 1))
        for x in range(hi - lo):
            bags.append(dict(zip(h[cut[x] : cut[x + 1]].tolist(), w[cut[x] : cut[x + 1]].tolist(), strict=True)))
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    same = {}
    for k, i in enumerate(ids):
        near = {same.setdefault(texts_[i] or "", k)}
        low = Counter()
        for term, weight in bags[k].items():
            for other in owners.get(term, ()):
                low[other] += min(weight, bags[other][term])
        total = sum(bags[k].values())
        near |= {o for o, x in low.items() if x / (total + sum(bags[o].values()) - x) >= 0.8}
        if same[texts_[i] or ""] == k:
            for term in bags[k]:
                owners.setdefault(term, []).append(k)
        for o in near:
            a, b = sorted((root(k), root(o)))
            parent[b] = a
    return {i: ids[root(k)] for k, i in enumerate(ids)}


def test_near_duplicates_against_brute_force_on_a_thousand(spark):
    big = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    want = near_classes(big)
    got = {r.doc_id: r.class_id for r in minhash.op7_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_exact_passages_against_brute_force_on_a_thousand(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = shared_windows([r.text or "" for r in rows])
    got = {r.doc_id: np.zeros(len(want[r.text or ""]), bool) for r in rows}
    for r in chaining.op5_substring_dedup(spark, "/root/testdata/sf0.01").collect():
        got[r.doc_id][r.start_word : r.end_word] = True
    need = sum(int(want[r.text or ""].sum()) for r in rows)
    found = sum(int((want[r.text or ""] & got[r.doc_id]).sum()) for r in rows)
    assert need > 0 and found >= 0.99 * need, (found, need)


def test_recall_of_fuzzy_passages(spark):
    """Passages of 50 to 60 words, 92 % alike, once in each of two texts; and one passage with edits in a group of a thousand."""
    random.seed(21)
    new = lambda k: [f"x{random.randint(0, 10**7)}" for _ in range(k)]
    rows = []
    for _ in range(120):
        p = new(random.randint(50, 60))
        q = edited(p, 4).split()
        rows += [new(60) + p + new(60), new(60) + q + new(60)]
    pairs, many = len(rows), new(60)
    rows += [new(30) + edited(many, 3).split() + new(30) for _ in range(1000)]
    got = {r.doc_id for r in chaining.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in enumerate(rows)])).collect()}
    assert len([i for i in got if i < pairs]) >= 0.9 * pairs and len([i for i in got if i >= pairs]) >= 0.9 * 1000, (len([i for i in got if i < pairs]), pairs, len(got))


def test_language_fusion_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs)
    rows = docs.select("doc_id", "text", "lang", "source", language.label_hash("text", "lang").alias("h")).orderBy("doc_id").collect()
    score, has = model.score(*K.column_bytes(pa.array([r.text or "" for r in rows], pa.large_string())))
    own = language._softmax(score) * has[:, None]
    k, hosts = len(model.langs), [r.source for r in rows]
    total = own.sum(axis=0)
    flat = (total + 1) / (total.sum() + k)
    flat[-1] = language.UNKNOWN_PRIOR
    got = {r.doc_id: r for r in language.op3_language_id(spark, DATA).collect()}
    for i, r in enumerate(rows):
        at_host = sum(own[j] for j in range(len(rows)) if hosts[j] == r.source)
        of_domain = (at_host + language.SMOOTH * flat) / (at_host.sum() + language.SMOOTH)  # each host is its own domain here
        prior = np.maximum(at_host - own[i], 0) + language.SMOOTH * of_domain
        said = language._witness([r.lang if r.h > model.cut else None], model.langs, language.DECLARED_RIGHT)[0]
        post = language._softmax((score[i] + said + np.log(prior / prior.sum()))[None])[0]
        best = int(post.argmax()) if has[i] else k - 1
        assert got[r.doc_id].language == model.langs[best] and abs(got[r.doc_id].posterior - (post[best] if has[i] else 1.0)) < 1e-5


def test_pipeline_against_brute_force(spark, texts, tokenizer):
    import corpus_pipeline as p
    from quarry.llm.shared import saved, table

    docs = table(spark, DATA, "documents")
    bench = [words(r.text) for r in table(spark, DATA, "benchmark").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in bench if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    before = texts
    for name, stage in p.STAGES[:-1]:
        docs = saved(stage(spark, docs, DATA), "test-stage")
        after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        if name == "language ID":
            accepted = {r.doc_id for r in language.op3_language_id(spark, DATA).where("accepted").collect()}
            assert after == {i: t for i, t in before.items() if i in accepted}
        elif name == "MinHash near-dedup":
            assert after == {i: before[i] for i, c in near_classes(before).items() if i == c}
        elif name == "substring dedup":
            assert set(after) <= set(before) and not any(x.any() for x in shared_windows(list(after.values())).values())
            assert all(Counter(words(t)) <= Counter(words(before[i])) for i, t in after.items())
            untouched = shared_windows(list(before.values()))
            assert sum(after.get(i) == t for i, t in before.items() if not untouched[t].any()) >= 0.95 * sum(not untouched[t].any() for t in before.values())
        else:
            for i, t in before.items():
                w, hit = words(t), set()
                for n in sizes:
                    hit |= {x for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for x in range(j, j + n)}
                assert (i in after) == (len(hit) == 0 or len(hit) < 0.5 * len(w))
                if i in after:
                    assert words(after[i]) == [x for j, x in enumerate(w) if j not in hit]
        before = after
    for r in p.STAGES[-1][1](spark, docs, DATA).collect():
        ids = tokenizer.encode(before[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


LONG = "word salad of many words " * 40000


@pytest.mark.parametrize("op", ["suffix", "bpe", "language", "fingerprints", "passages", "decontaminate", "near", "license", "tokens", "warc"])
def test_long_texts_and_clashing_columns(spark, op):
    """A text of a million characters, and columns with every name that the operators use themselves, also with a dot."""
    names = "t u spans tid _tid keep _keep _t _spans _line _all h m d a c0 c1 seen smooth language n_words hit_spans ids decoded removed kept detections s.t".split()
    plain = frame(spark, [(1, LONG), (2, "short text"), (None, None)])
    docs = plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    extra = lambda out, new: [c for c in docs.columns if c not in new] == [c for c in out.columns if c not in new]
    if op == "suffix":
        out = suffix.remove_repeats(docs)
        assert extra(out, {"removed", "n_bytes", "kept"}) and {r.doc_id: (r.n_bytes, len(r.removed)) for r in out.collect()} == {1: (1_000_000, 1), 2: (10, 0), None: (0, 0)}
    elif op == "bpe":
        out = bpe.decode(bpe.encode(docs))
        assert extra(out, {"ids", "decoded"}) and {r.doc_id: len(r.ids) for r in out.collect()}[None] == 0
    elif op == "language":
        out = language.detect(docs, language.fit(spark.read.parquet(f"{DATA}/documents.parquet")), text=F.col("text"))
        assert extra(out, {"language", "posterior", "accepted", "text_language"}) and out.count() == 3
    elif op == "fingerprints":
        assert {r.doc_id: r.n_chars for r in sampling.with_neighbours(docs).collect()} == {1: 1_000_000, 2: 10, None: 0}
    elif op == "passages":
        out = chaining.cut(docs)
        assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()}[1] == LONG
    elif op == "decontaminate":
        out = decontaminate.scan(docs, frame(spark, [(7, "salad of many words word salad of many words word")], "item_id long, text string"))
        assert extra(out, {"n_words", "hit_spans", "hit_items"}) and {r.doc_id: (r.n_words, r.hit_items) for r in out.collect()} == {1: (200_000, ["7"]), 2: (2, []), None: (0, [])}
        assert {r.doc_id for r in decontaminate.remove(out).collect()} == {2, None}
    elif op == "near":
        out = minhash.deduplicate(docs.union(docs))
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, None}
    elif op == "license":
        out = licenses.scan(docs)
        assert extra(out, {"n_words", "detections"}) and {r.doc_id: r.n_words for r in out.collect()} == {1: 200_000, 2: 2, None: 0}
    elif op == "tokens":
        out = pfor.read(pfor.write(docs, scratch(spark, "t"))).collect()
        assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [None, 1, 2]
    else:
        pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[F.lit(0).alias(n) for n in ("id", "digest", "payload_bytes", "_id")])
        out = warc.read(warc.write(warc.assign(pages.union(pages)), scratch(spark, "w"))).collect()
        assert Counter((r.id, r.payload_bytes, r.record_type) for r in out) == Counter({("1", 1_000_000, "response"): 2, ("2", 10, "response"): 2, ("None", 0, "response"): 2})


def test_token_files_by_other_ids(spark):
    rows = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "x")], "doc_id string, text string")
    assert [r.doc_id for r in pfor.read(pfor.write(rows, scratch(spark, "t"))).orderBy("start").collect()] == [None, "a", "b"]
    days = rows.select(F.to_date(F.lit("2024-01-02")).alias("doc_id"), "text")
    assert pfor.read(pfor.write(days, scratch(spark, "t"))).select(F.max("doc_id").cast("string")).first()[0] == "2024-01-02"


def test_pipeline_gives_memory_back_before_a_stage(monkeypatch):
    import corpus_pipeline as p

    seen = []
    monkeypatch.setattr(p, "settle", lambda spark: seen.append(spark))
    monkeypatch.setattr(p.minhash, "deduplicate", lambda docs: (docs, list(seen)))
    assert p.drop_near_duplicates("session", "docs", DATA) == ("docs", ["session"])


def test_pipeline_encodes_and_decodes_in_one_worker(spark):
    import corpus_pipeline as p

    docs = frame(spark, [(1, "en", "s", "one two Three"), (2, None, "s", None), (3, "x", "s", "")], "doc_id long, lang string, source string, text string")
    plan = p.tokenize(spark, docs, DATA)
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = {r.doc_id: (list(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in plan.collect()} == {i: (ids, hashlib.sha256(d.encode()).hexdigest()) for i, (ids, d) in want.items()}


def test_pipeline(spark):
    import corpus_pipeline as p
    from quarry.llm.shared import saved, table

    docs = table(spark, DATA, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = saved(stage(spark, docs, DATA), "test-stage")
        assert sorted(docs.columns) == sorted(columns), name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    bench = table(spark, DATA, "benchmark")
    assert decontaminate.scan(docs, bench).where(decontaminate.n_hit() > 0).count() == 0
    out = p.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == before and p.run(spark, DATA).count() == before
    assert p.STAGES[0][1](spark, docs.limit(0), DATA).count() == 0
