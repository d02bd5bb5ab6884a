"""Trained operators: held-out accuracy on the driver's tables, exact forward-backward, edge cases; and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradus.llm import langid, quality, queries


def test_blocks_give_forward_backward():
    rng = np.random.default_rng(0)
    s, move, cuts = rng.standard_normal((300, 3)), rng.standard_normal((3, 3)), np.array([0, 1, 1, 140, 300])
    got = langid.posteriors(s, cuts, move, 16)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a == b:
            continue
        alpha, beta = [np.exp(s[a])], [np.ones(3)]
        for i in range(a + 1, b):
            v = (alpha[-1] @ np.exp(move)) * np.exp(s[i])
            alpha.append(v / v.sum())
        for i in range(b - 1, a, -1):
            v = np.exp(move) @ (np.exp(s[i]) * beta[-1])
            beta.append(v / v.sum())
        q = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(q / q.sum(1, keepdims=True), got[a:b], atol=1e-4)


def test_gradient_of_log_likelihood():
    """Expected words and moves are the numerical gradient of log Z."""
    rng = np.random.default_rng(7)
    scores, moves = rng.standard_normal((5, 12, 3)), 2 * rng.standard_normal((3, 3))

    def log_z(s, m):
        total = 0.0
        for chain in s:
            a = chain[0]
            for row in chain[1:]:
                a = np.logaddexp.reduce(a[:, None] + m, axis=0) + row
            total += np.logaddexp.reduce(a)
        return total

    gamma, pairs = langid.expectations(scores, moves)
    step = 1e-5
    for a in range(3):
        for b in range(3):
            d = np.zeros((3, 3))
            d[a, b] = step
            assert pairs[a, b] == pytest.approx((log_z(scores, moves + d) - log_z(scores, moves - d)) / (2 * step), abs=1e-5)
    for at in ((0, 0, 0), (2, 5, 1), (4, 11, 2)):
        d = np.zeros_like(scores)
        d[at] = step
        assert gamma[at] == pytest.approx((log_z(scores + d, moves) - log_z(scores - d, moves)) / (2 * step), abs=1e-5)


def test_clashing_columns_pass_through(spark, sf):
    docs = queries.table(spark, sf, "documents").select("doc_id", "text", "lang", *[F.lit(i).alias(c) for i, c in enumerate(("key", "h", "y", "c0", "id", "_key"))])
    model = langid.fit(docs, F.lit(True))
    out = langid.labelled(docs.withColumn("lang_pred", F.lit("old")), model)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    assert out.filter("lang_pred <> lang").count() <= 0.03 * docs.count()
    scored = quality.scored(docs, quality.fit(docs, queries.table(spark, sf, "labels"), F.lit(True)))
    assert scored.columns == [*docs.columns, "score", "predicted"]
    assert scored.filter("key <> 0 OR _key <> 5").count() == 0


def test_language_query(spark, sf):
    rows = queries.op5_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf, "documents").collect()}
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, sf):
    docs = queries.table(spark, sf, "documents")
    model = langid.fit(docs, F.lit(True))
    long = docs.filter("lang = 'de'").first()["text"] * 20
    df = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! --"), (4, long), (4, long)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).collect())
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    assert langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    mixed = docs.filter("lang = 'en'").first()["text"].split()[:12] + docs.filter("lang = 'es'").first()["text"].split()[:12]
    named = langid.words(spark.createDataFrame([(1, " ".join(mixed))], "doc_id long, text string"), model).first()["words"]
    assert np.mean([w["lang"] == ("en" if i < 12 else "es") for i, w in enumerate(named)]) >= 0.8


def test_long_words_count_whole(spark):
    rng = np.random.default_rng(3)
    ends = "q" * 40
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(i, ends + draw(("abcd", "efgh")[i % 2], 300) + ends, ("aa", "bb")[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 40"), F.lit(True))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()} == {i: lang for i, _, lang in rows}
    assert [[(w["word"], w["lang"]) for w in r["words"]] for r in langid.words(df.filter("doc_id = 41"), model).collect()] == [[(rows[41][1], "bb")]]


def test_pieces_hold_every_ngram_once():
    word = "".join(np.random.default_rng(1).choice(list("abcdefgh1"), 1000)).strip("1")
    whole = sorted(f for f in langid.features(word) if f[0] != "=")
    for n in (2, 3, 80, 81, 82, 158, 159, 160, 237, len(word)):
        parts = langid.pieces(f"({word[:n]})")
        got = sorted(f for p in parts for f in langid.features(langid.core(p)) if f[0] != "=")
        assert got == sorted(f for f in langid.features(langid.core(word[:n])) if f[0] != "=")
    assert len(whole) > 1900 and langid.pieces("-" * 500) == ["-"]


def test_shape_takes_whole_tokens():
    assert quality.shape("Ab1!!") == "Xx0!+"
    assert quality.shape("a" * 40 + "1" + "a" * 5000) == "x+0x+"
    pairs, offsets = quality.tokens(["Go go gone", None, "go"])
    assert offsets.tolist() == [0, 4, 5, 7]
    assert pairs[:, 1].tolist()[1] == quality.AGAIN and [pairs[i - 1, 1] for i in offsets[1:]] == [quality.END] * 3 and pairs[5, 1] != quality.AGAIN


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_quality(spark, sf).collect()
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "some words here", 5), (3, "some words here", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (3, 1), (3, None), (9, 0)], "doc_id long, quality int")
    got = quality.score(docs, labels, F.lit(True)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3]
    assert all(r["score"] == 1.0 and r["predicted"] == 1 for r in got)
    assert all(r["score"] == 0.5 for r in quality.score(docs, labels.limit(0), F.lit(True)).collect())
    assert quality.score(docs.limit(0), labels, F.lit(True)).count() == 0


def test_network_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 6))
    p = 1 / (1 + np.exp(-(x[:, 0] + 0.5 * x[:, 1] * x[:, 2])))
    y = (rng.random(3000) < p).astype(int)
    got = quality.Network(x, y).scores(x)
    for lo in (0.1, 0.3, 0.5, 0.7):
        at = (got >= lo) & (got < lo + 0.2)
        assert y[at].mean() == pytest.approx(got[at].mean(), abs=0.12)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    docs = queries.table(spark, sf, "documents")
    junk = spark.createDataFrame([(10**6, "123 456 ...", "en", "s", 11), (10**6 + 1, None, None, None, None)], docs.schema)
    copy = docs.filter("doc_id = 0").withColumn("doc_id", F.lit(10**6 + 2).cast("long"))
    docs = docs.unionByName(junk).unionByName(copy)
    kept = docs
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, sf).toPandas().astype({"n_chars": "int64"}), docs.schema)
        assert kept.columns == docs.columns, name
        now = {r["doc_id"] for r in kept.collect()}
        assert now <= before
        before = now
    assert not before & {10**6, 10**6 + 1, 10**6 + 2}
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r["doc_id"] for r in packed.collect()} == before


def test_pipeline_stages_against_brute_force(spark, sf):
    """Near-duplicates, passages and packing on a small frame with clashing columns; the first two stages by their operators."""
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(12)
    base = [list(rng.choice(words, int(n))) for n in rng.integers(15, 60, 20)]
    passage = list(rng.choice(words, 25))
    texts = [" ".join(b) for b in base]
    for b in base[:8]:
        for _ in range(3):
            near = list(b)
            near[int(rng.integers(0, len(near)))] = "new"
            texts.append("  ".join(near))
    texts += [" ".join([*b[:9], *passage, *b[9:]]) for b in base[8:14]] + [texts[0], "", "a"]
    rows = [(i, t, "en", "s", len(t), -i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, _key string")

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own = {i: sets(t) for i, t, *_ in rows}
    top = {i: i for i in own}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in own:
        for b in own:
            if a < b and own[a] and own[b] and 10 * len(own[a] & own[b]) >= 8 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    want = {i: t for i, t, *_ in rows if find(i) == i}
    assert {r["doc_id"]: (r["text"], r["id"], r["_key"]) for r in kept.collect()} == {i: (t, -i, "x") for i, t in want.items()}
    first = {}
    for i, t in sorted(want.items()):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    cut = {}
    for i, t in want.items():
        w = t.split()
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        cut[i] = [x for j, x in enumerate(w) if j not in gone]
    trimmed = corpus_pipeline.repeated_passages(spark, spark.createDataFrame(kept.collect(), docs.schema), sf)
    got = trimmed.collect()
    assert trimmed.columns == docs.columns and {r["doc_id"]: r["text"].split() for r in got} == cut
    assert any(len(cut[i]) < len(want[i].split()) for i in want)
    assert all(r["n_chars"] == len(r["text"]) and r["id"] == -r["doc_id"] for r in got)
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(got, docs.schema), sf).collect()
    assert {r["doc_id"] for r in packed} == set(cut) and len({r["sequence_id"] for r in packed}) == 1
    lang = {r["doc_id"] for r in langid.predict(docs, langid.fit(docs, ~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2))).filter("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf).collect()} == lang == {r[0] for r in rows if r[1]}


def test_pipeline_of_empty_tables_and_its_files(spark, sf, tmp_path):
    docs = queries.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    rows = corpus_pipeline.run(spark, sf).count()
    assert 0 < rows <= docs.count() * 1.2
    assert {x.split("-")[0] for x in set(os.listdir(shared)) - before} == {"packed"}


def test_pipeline_keeps_documents_without_an_id_of_their_own(spark, sf):
    words = [f"w{i}" for i in range(600)]
    rng = np.random.default_rng(6)
    text = lambda: " ".join(rng.choice(words, 30))
    t = [text() for _ in range(9)]
    passage = " ".join(words[:20])
    late = f"{t[8]} {passage} end"
    rows = [(1, t[0]), (1, t[1]), (1, t[1]), (None, t[2]), (None, t[3]), (None, t[3]), (None, t[0]), (2, t[1].upper()), (3, f"{t[7]} {passage}"), (None, late), (-4, t[4])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], queries.table(spark, sf, "documents").schema)
    want = {(1, t[0]), (1, t[1]), (None, t[2]), (None, t[3]), (3, f"{t[7]} {passage}"), (None, late), (-4, t[4])}
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(want) and set(got) == want
    cut = [(r["doc_id"], r["text"]) for r in corpus_pipeline.repeated_passages(spark, docs.filter(F.col("doc_id").isNull() | (F.col("doc_id") != 2)), sf).collect()]
    assert len(cut) == len(rows) - 1
    assert (3, f"{t[7]} {passage}") in cut and (None, f"{t[8]} end") in cut and (None, t[2]) in cut and (1, t[1]) in cut
    assert cut.count((None, "")) == 1  # the copy of t[0], which id 1 holds


def test_pipeline_judges_each_row_without_an_id(spark, sf):
    docs = queries.table(spark, sf, "documents")
    german = docs.filter("lang = 'de'").first()["text"]
    odd = spark.createDataFrame([(None, "123 456 ...", "en", "s", 11), (None, german, "de", "s", len(german)), (0, "123 ---", "en", "s", 7)], docs.schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.language(spark, docs.unionByName(odd), sf).collect()]
    assert (None, german) in kept and not {(None, "123 456 ..."), (0, "123 ---")} & set(kept)
    good = corpus_pipeline.good_quality(spark, docs.unionByName(odd), sf)
    assert good.columns == docs.columns and good.count() > 0.5 * docs.count()
