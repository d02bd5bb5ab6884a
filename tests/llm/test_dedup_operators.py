"""Near-duplicates, repeated passages and searches against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import embed_dedup, jaccard, substring_dedup, topk
from gradus.llm.common import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, links):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 16))
    near = base[:30] + 0.2 * rng.standard_normal((30, 16))
    chain = base[0] + 0.12 * np.cumsum(rng.standard_normal((12, 16)), axis=0)
    group = base[1] + 0.02 * rng.standard_normal((80, 16))
    return np.concatenate([base, near, chain, group, base[:5], 3 * base[5:8]]).astype(np.float32)


def test_embeddings(spark, vectors):
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(vectors)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [None] + [1.0] * 15, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [float("inf")] * 16, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, block=64).collect()}
    x = vectors.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.9)) if i != j} | {(n + 5, n + 6), (n + 6, n + 5)}
    top = components(range(n + 8), links)
    want = {i: (sum(a == i for a, _ in links), top[i], top[i] == i) for i in range(n + 8)}
    assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_collision_count_is_calibrated():
    rng = np.random.default_rng(2)
    away = np.sqrt(0.2)
    least = embed_dedup.calibrated_count(32, 2.0, 0.9999)
    hits = (np.abs(rng.standard_normal((20000, 32)) * away) <= 2.0 * away).sum(axis=1)
    assert 0 < least < 32
    assert (hits >= least).mean() >= 0.999


def test_topk(spark, vectors):
    big = [(i, v.tolist()) for i, v in enumerate(vectors)]
    n = len(big)
    rows = big + [(n, None), (n + 1, [float("nan")] * 16), (n + 2, [1.0, 2.0]), (50, vectors[50].tolist()), (n + 3, [1e30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard=64, block=2, leaf=8).collect()
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v and np.isfinite(v).all()]
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        own = next(v for i, v in whole if i == q)
        scored = sorted(((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(own, v)))), i) for i, v in whole if i != q and len(v) == len(own)))[:5]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("copies", [1, 2, 7, 40])
def test_topk_of_repeated_queries(spark, copies):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 8))
    x[:60] = x[0] * rng.uniform(0.5, 0.99, (60, 1))
    x[0] = 4 * x[0]  # before all others
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * (copies - 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).collect())
    whole = np.floor(256 * x)
    best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[0]) if i)[:5]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [vocabulary[i] for i in rng.integers(0, 400, n)]
    base = [draw(int(n)) for n in rng.integers(20, 90, 25)]
    passage = draw(20)
    docs = [" ".join(b) for b in base]
    for b in base[:10]:  # near copies that differ in one place or two
        for _ in range(4):
            c = list(b)
            for at in rng.integers(0, len(c), int(rng.integers(1, 3))):
                c[at] = "new"
            docs.append("  ".join(c).upper() if rng.random() < 0.3 else "\n".join(c))
    docs += [" ".join(draw(15) + passage + draw(12)) for _ in range(6)]
    docs += [docs[0], docs[0], docs[3], "a b", "A B", "a", "same same same", "", " \n", "x " * 40, "x " * 60, "é ü ß " * 10]
    rows = [(i, t, "x") for i, t in enumerate(docs)] + [(500, None, "x"), (501, "word " + "q " * 20000, "x"), (3, docs[3], "x")]
    return rows


def shingles(text, n):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_jaccard(spark, texts, n, num):
    df = spark.createDataFrame(texts, "doc_id long, text string, size string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, n, num, 100).collect()}
    sets = {i: shingles(t, n) for i, t, _ in texts}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    top = components(sets, links)
    assert got == {i: (len(sets[i]), top[i]) for i in sets}


def test_jaccard_every_pair(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, size string")
    members, links = jaccard.similarity_join(df, 3, 90, 100, every_pair=True)
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = {i: shingles(t, 3) for i, t, _ in texts}
    want = {(a, b) for a in set(of.values()) for b in set(of.values()) if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == want
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def trimmed(rows, n):
    words = {i: WORDS.findall(t or "") for i, t, _ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize(("n", "batches", "fan"), [(13, 2, 4), (5, 4, 2), (3, 1, 4)])
def test_substrings(spark, texts, n, batches, fan):
    df = spark.createDataFrame(texts, "doc_id long, text string, copy string")
    got = substring_dedup.dedup(df, n, batches, texts=True, fan=fan).collect()
    want = trimmed(texts, n)
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]][:3]
        assert WORDS.findall(r["text"] or "") == want[r["doc_id"]][3]
        if not r["n_removed"]:
            assert r["text"] == next(t for i, t, _ in texts if i == r["doc_id"])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gradus_run_")]
    assert substring_dedup.dedup(df.limit(0)).count() == 0


def test_gram_hashes_see_order_and_length():
    from gradus.llm.common import gram_hashes, word_hashes

    words, starts, ends, offsets = word_hashes(pa.array(["a b c", None, "", "b  a\tlongerthaneight", "a b"]))
    assert offsets.tolist() == [0, 3, 3, 3, 6, 8]
    assert (ends - starts).tolist() == [1, 1, 1, 1, 1, 15, 1, 1]
    assert words[0] == words[4] == words[6]
    two = gram_hashes(words, 2)
    assert two[0] == two[6] != two[3]
    assert len(gram_hashes(words, 9)) == 0


def test_rows_without_an_id(spark, vectors, texts):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors[:30])] + [(None, vectors[0].tolist()), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(df).collect()
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None) == [(0, None, True)] * 2
    assert len(got) == len(rows)
    assert {r["query_id"] for r in topk.top_k(df, F.lit(True)).collect()} == set(range(30))
    named = spark.createDataFrame([*texts, (None, texts[0][1], "x"), (None, texts[0][1], "x")], "doc_id long, text string, size string")
    got = [(r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(named).collect() if r["doc_id"] is None]
    assert got == [(len(shingles(texts[0][1], 3)), None)] * 2
    got = [(r["n_removed"], r["n_words"]) for r in substring_dedup.dedup(named).collect() if r["doc_id"] is None]
    assert got == [(0, len(WORDS.findall(texts[0][1])))] * 2


def test_string_keys(spark, texts):
    rows = [(f"k{i:04d}", t, x) for i, t, x in texts]
    df = spark.createDataFrame(rows, "doc_id string, text string, copy string")
    want = trimmed(rows, 13)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(df).collect()} == {i: w[:3] for i, w in want.items()}


def test_index_outlives_a_call_and_compacts(spark, texts):
    rows = sorted({(i, t, x) for i, t, x in texts}, key=lambda r: r[0])
    half = len(rows) // 2
    table = lambda part: spark.createDataFrame(part, "doc_id long, text string, copy string")
    want = trimmed(rows, 13)
    with substring_dedup.FingerprintIndex(spark, 13) as index:
        old = substring_dedup.dedup(table(rows[:half]), index=index, batches=3)
        assert {r["doc_id"]: r["n_removed"] for r in old.collect()} == {i: want[i][1] for i, _, _ in rows[:half]}
        assert len(index.runs) == 2 and index.compactions == 1
        new = substring_dedup.dedup(table(rows[half:]), index=index, batches=2, history=table(rows[:half]))
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in new.collect()} == {i: want[i][1:3] for i, _, _ in rows[half:]}
        assert len(index.runs) == 2 and index.compactions == 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gradus_")]


def test_the_registered_batches_compact():
    assert substring_dedup.BATCHES > substring_dedup.FAN


def test_hot_fingerprints_stay_out_of_the_buckets(spark):
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(14)]
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(int(rng.integers(3, 9)))), *passage, *(f"b{i}x{k}" for k in range(5))]), "x") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy string")
    with substring_dedup.FingerprintIndex(spark, 13) as index:
        got = substring_dedup.dedup(df, index=index, batches=2)
        want = trimmed(rows, 13)
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got.collect()} == {i: w[1:3] for i, w in want.items()}
        assert sum(spark.table(t).count() for t in index.hot) >= 900


def test_suffix_filter_keeps_linked_pairs(spark):
    """Of random pairs of sets around the threshold, every linked pair passes; most distant ones do not."""
    rng = np.random.default_rng(3)
    t = jaccard.Threshold(80, 100)
    rows, truth = [], {}
    for i in range(120):
        common = rng.integers(0, 1 << 63, int(rng.integers(40, 300)), dtype=np.uint64)
        more = [rng.integers(0, 1 << 63, int(len(common) * rng.uniform(0, 0.3)), dtype=np.uint64) for _ in range(2)]
        pair = [np.unique(np.concatenate([common, m])) for m in more]
        for side, u in enumerate(pair):
            rows.append((2 * i + side, len(u), np.frombuffer(jaccard.signature(u), np.int64).tolist(), u[: t.prefix(len(u))].view(np.int64).tolist()))
        prefix = [r[3] for r in rows[-2:]]
        at = [k for k, x in enumerate(prefix[0]) if x in set(prefix[1])]
        if at:
            truth[2 * i] = (at[0], len(np.intersect1d(*pair)) * 180 >= 80 * (len(pair[0]) + len(pair[1])))
    lines = spark.createDataFrame(rows, "id long, size long, sig array<long>, prefix array<long>")
    pairs = spark.createDataFrame([(a, a + 1, p) for a, (p, _) in truth.items()], "a long, b long, p int")
    passed = {r["a"] for r in jaccard._suffixed(pairs, lines, t).collect()}
    linked = {a for a, (_, good) in truth.items() if good}
    assert linked <= passed and 0 < len(linked) < len(truth)
