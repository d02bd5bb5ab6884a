"""Importance resampling, BPE through a table of words, and hard negatives, against brute force and the library."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradus.llm import importance, negatives, queries, word_bpe, words

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    None, "", " ", "\n\n  x", "a  b\t\tc   d　e", "  z \u0085\u0085 y", "ends with spaces   ", "x<|endoftext|>y", "a  <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|>",
    "<|endoftext", "|>", "é" * 50, "数字12３四 don't we'll IT'S", "🙂🙂 👩‍👩‍👧", "w" * 30_000, "tab\x1cfile\x1fsep", "Same text again", "Same text again", "​zero﻿ width",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(word_bpe.FILE))


@pytest.mark.parametrize("most", [0, 40, words.HEAD])
def test_ids_are_the_library_s(spark, sf, library, most):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [*enumerate(ODD, 10**6), (None, "no id"), (7, None)]
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("ids", F.lit(1)).withColumn("word", F.lit(2))
    got = Counter(map(tuple, word_bpe.digests(df, most=most).collect()))
    want = Counter()
    for i, t in [*((r["doc_id"], r["text"]) for r in docs.collect()), *rows]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want
    assert word_bpe.digests(df.limit(0)).count() == 0


def test_words_end_where_the_pattern_does(library):
    """Encoded word by word, every white-space or control character in any company gives what the whole text gives."""
    spaces = [chr(c) for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0x180E, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    texts = [f"a{x}{y}b {x}c{y}{y} {x}" for x in spaces for y in [" ", "\n", " ", "　", x]]
    got, offsets = words.spaced(word_bpe.added_tokens())(pa.array(texts))
    for i, t in enumerate(texts):
        own = [w.decode() for w in got[offsets[i] : offsets[i + 1]].to_pylist()]
        assert "".join(own) == t
        assert [k for w in own for k in library.encode(w).ids] == library.encode(t).ids


def test_decoding_odd_ids(spark, library):
    rows = [(1, [50256, 0, 220]), (2, []), (3, [10**6, 65]), (4, library.encode("né").ids[:-1] + [127]), (5, [158, 248])]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in rows] + [(6, None)], "id long, ids binary")
    got = {r["id"]: r["decoded"] for r in word_bpe.decode(df).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in rows} | {6: ""}


def test_each_distinct_word_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = word_bpe.word_table(docs)
    assert table.count() == table.select("word").distinct().count()
    assert sum(len(r["word"]) * r["n"] for r in table.collect()) == sum(len((r["text"] or "").encode()) for r in docs.collect())


def resampled(rows, target, n=1, least=20, percent=10, seed=2024, buckets=importance.BUCKETS):
    def features(text):
        w = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t)[0])
    t = Counter(bucket(f) for x in target for f in features(x)[0])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (t_or(s) + buckets) / ((s[b] + 1.0) * (t_or(t) + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        own, size = features(text)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, size])
    fit = sorted((x for x in out if x[-1] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: len(fit) * percent // 100], 1):
        x[4] = k
    return Counter(tuple(x[:5]) for x in out)


def t_or(counts):
    return float(counts.total())


@pytest.mark.parametrize(("n", "most"), [(1, 0), (1, 30), (1, words.HEAD), (2, 20), (3, words.HEAD)])
def test_importance(spark, sf, n, most):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rows = [*docs, (9001, None), (9002, ""), (9003, "-- ?"), (9004, "Ünïcode ABC abc 12a " * 9), (9005, "Ünïcode ABC abc 12a " * 9), (None, "x y z " * 10), (9006, "a " * 19), (9007, "a " * 20)]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(30).collect()] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("x")).withColumn("r", F.lit(0)).repartition(3)
    against = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in importance.resample(df, against, n=n, percent=30, buckets=500, most=most, per=10).collect())
    assert got == resampled(rows, target, n=n, percent=30, buckets=500)


def test_importance_of_little(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(i % 7, "same words " * 15) for i in range(40)], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    got = importance.resample(some, none, percent=50, per=3).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))
    assert {r["n_features"] for r in got} == {30}
    again = importance.resample(some.repartition(5), none, percent=50).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def mined(rows, anchors, k=5, most=3, low=50, high=95, scale=256):
    good = [(i, np.floor(scale * np.array(v, float)), lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v, lab in good:
        if anchors(i):
            asked.setdefault((len(v), i), []).append((list(v), lab))
    out = Counter()
    for (d, i), own in asked.items():
        v, lab = min(own)
        score = [(int(np.dot(v, w)), j, other == lab) for j, w, other in good if len(w) == d and j != i]
        for ps, p, _ in sorted((x for x in score if x[2]), key=lambda x: (-x[0], x[1]))[:k]:
            fits = [x for x in score if not x[2] and low * ps <= 100 * x[0] <= high * ps]
            for rank, (ns, j, _) in enumerate(sorted(fits, key=lambda x: (-x[0], x[1]))[:most], 1):
                out[i, p, rank, j, ps, ns] += 1
    return out


@pytest.mark.parametrize(("shard", "group", "cells"), [(16, 4, 8), (64, 32, 3), (4096, 1024, 1024)])
def test_hard_negatives(spark, shard, group, cells):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8))
    rows = [(int(i), (centres[c] + 0.5 * rng.standard_normal(8)).astype(np.float32).tolist(), int(lab)) for i, (c, lab) in enumerate(zip(rng.integers(0, 6, 400), rng.integers(0, 3, 400)))]
    rows += [(400 + i, rows[5][1], i % 2) for i in range(60)] + [(10, rows[11][1], 1), (10, rows[12][1], 2), (20, rows[20][1], rows[20][2])]
    rows += [(500, None, 1), (510, [None] * 8, 1), (520, [float("nan")] * 8, 0), (530, rows[3][1], None), (None, rows[3][1], 1), (540, [1.0, 2.0], 1), (550, [1.0, 1.0], 1), (560, [0.9, 0.5], 2), (570, [], 1), (580, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x")).withColumn("s", F.lit(1)).repartition(5)
    got = Counter(map(tuple, negatives.mined(df, F.col("vec_id") % 10 == 0, shard=shard, group=group, cells=cells).collect()))
    assert got == mined(rows, lambda i: i % 10 == 0)
    assert negatives.mined(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mined(df, F.lit(False)).count() == 0


def test_pairs_of_nodes_are_pruned(spark):
    rng = np.random.default_rng(1)
    points = np.floor(256 * np.concatenate([c + 0.02 * rng.standard_normal((240, 3)) for c in rng.standard_normal((8, 3))]))
    labels, ids = np.repeat(np.arange(8), 240), np.arange(1920)
    own = np.arange(0, 1920, 10)
    floor, top = np.full((len(own), 1), -(2.0**62)), np.full((len(own), 1), 2.0**62)
    search = negatives.Search(ids[own], labels[own], floor, top, 5, True)
    scored = negatives.meet(negatives.KdTree(points[own], ids[own], 16), negatives.KdTree(points, ids, 64), labels, search)
    every = sum(x is not None for x in negatives.KdTree(points[own], ids[own], 16).rows) * sum(x is not None for x in negatives.KdTree(points, ids, 64).rows)
    assert scored < every / 3
    score = points[own] @ points.T
    score[np.arange(len(own)), own] = -np.inf
    score[labels[own][:, None] != labels[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :5]
    assert (search.who[:, 0] == order).all()


def test_scores_that_are_not_exact_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9], 1), (1, [1e9, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="not exact"):
        negatives.mined(df, F.col("vec_id") == 0).count()


def test_registered_queries_match_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(map(tuple, queries.op11_importance_resampling(spark, sf).collect())) == resampled(docs, target)
    vectors = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.op13_hard_negatives(spark, sf).collect())) == mined(vectors, lambda i: i % 50 == 0)


def test_nulls_in_slices_of_binary_columns():
    """Batches that share a buffer: offsets stay inside it, and values stay with their rows."""
    whole = pa.array([None, *(bytes([i]) * 16 for i in range(1, 99)), None], pa.binary())
    for start, size in ((0, 100), (1, 3), (37, 0), (37, 20), (90, 10)):
        part = whole.slice(start, size)
        for hidden in (np.zeros(size, bool), np.ones(size, bool), np.arange(size) % 3 == 0):
            got = importance.masked(part, hidden)
            pa.RecordBatch.from_arrays([got], ["m"]).validate(full=True)
            assert got.to_pylist() == [None if h else x for x, h in zip(part.to_pylist(), hidden)]
