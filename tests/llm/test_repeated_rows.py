"""Rows that repeat, ids with several texts or vectors, very long training texts, files left behind."""

import hashlib
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import embed_dedup, langid, quality, queries, substring_dedup, url_filter
from gradus.llm.common import Scratch, settings, stored


def folder(spark):
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    return {x for x in os.listdir(at) if not x.count("-") == 4}  # without Spark's own


def test_texts_under_one_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    c = " ".join(b.split()[:15]) + " tail"
    rows = [(3, a), (5, a), (5, b), (9, b), (9, c), (5, None), (None, a), (7, c)]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(3, 20, 0), (5, 20, 20), (5, 20, 0), (9, 20, 20), (9, 16, 16), (5, 0, 0), (0, 20, 0), (7, 16, 15)])


def test_one_id_holds_many_texts(spark):
    rows = [(1, f"own {i} " * 3 + "shared words that all of these texts hold in the very same order here") for i in range(300)] + [(2, "x shared words that all of these texts hold in the very same order here")]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.count("*"), F.sum("n_removed")).collect()
    assert sorted(map(tuple, got)) == [(1, 300, 0), (2, 1, 14)]


def test_runs_merge_as_they_lie(spark):
    docs = spark.range(200).select("id", F.lit(0).cast("long").alias("h"), F.expr("array_join(transform(sequence(1, 40), i -> concat('w', (id * 7 + i) % 900)), ' ')").alias("text"))
    with substring_dedup.FingerprintIndex(spark, fan=3) as index:
        index.add(docs.filter("id % 2 = 0"))
        index.add(docs.filter("id % 2 = 1"))
        with settings(spark, **substring_dedup.ORDERED, spark__sql__adaptive__enabled="false"):
            plan = index.merged(*index.runs)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert all(os.path.isdir(p.removeprefix("file:")) and "warehouse" not in p for p in index.paths.values())
        paths = list(index.paths.values())
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_files_left_behind(spark, sf):
    before, tables = folder(spark), spark.catalog.listTables()
    with Scratch(spark):
        for name in ("op3_substring_dedup", "op9_best_fit", "op10_url_rules", "op11_importance_resampling", "op13_hard_negatives"):
            queries.queries()[name](spark, sf).count()
    assert folder(spark) == before and spark.catalog.listTables() == tables


def test_owners_of_other_threads(spark):
    held, go, out = threading.Event(), threading.Event(), {}

    def other():
        with Scratch(spark):
            out["df"] = stored(spark.range(5).toDF("x"), "mine")
            held.set()
            go.wait(60)
            out["n"] = out["df"].count()

    t = threading.Thread(target=other)
    t.start()
    held.wait(60)
    with Scratch(spark) as scratch:
        scratch.result(spark.range(3).toDF("x"), "theirs")
    go.set()
    t.join()
    assert out["n"] == 5


def test_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0]), (3, [1.0, 0.01]), (3, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [0.01, 1.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1, True), (3, 1, 1, False), (3, 2, 3, True), (5, 2, 3, False), (6, 2, 3, False)]


@pytest.fixture(scope="module")
def speech(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "text", "lang")


@pytest.mark.parametrize("seed", [1, 2])
def test_language_of_few_texts_beside_a_repeated_row(spark, speech, seed):
    few = speech.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(3)) == 0)
    hot = spark.range(2_000_000).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("the very same row again and again").alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(few.unionByName(hot), F.lit(True))
    assert model.languages == sorted(r[0] for r in few.unionByName(hot.limit(1)).select("lang").distinct().collect())
    got = langid.predict(few, model).join(few.select("doc_id", "lang"), "doc_id").filter("lang_pred <> 'und'")
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count() > 0


def test_all_languages_of_very_long_texts(spark, speech):
    by = speech.groupBy("lang").agg(F.array_join(F.collect_list("text"), " ").alias("t")).filter(F.length("t") > 2000).orderBy("lang").limit(2)
    long = by.select("lang", F.expr("repeat(concat(t, ' '), cast(ceil(2000000 / length(t)) as int))").alias("t")).crossJoin(spark.range(6).withColumnRenamed("id", "k"))
    docs = long.select(F.xxhash64("lang", "k").alias("doc_id"), F.concat(F.col("k").cast("string"), F.lit(" "), F.col("t")).alias("text"), "lang")
    for chars in (langid.CHARS, 50_000):
        model = langid.fit(docs, F.lit(True), chars=chars)
        assert len(model.languages) == 2
    assert langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang_pred <> lang").count() == 0


def test_a_rare_language_is_learned(spark, speech):
    langs = sorted(r[0] for r in speech.select("lang").distinct().collect())
    many = speech.filter(F.col("lang") == langs[0]).join(spark.range(300).withColumnRenamed("id", "k")).select(F.col("k").alias("doc_id"), F.concat("text", F.lit(" "), F.col("k").cast("string")).alias("text"), "lang")
    rare = speech.filter(F.col("lang") == langs[1]).limit(3)
    model = langid.fit(many.unionByName(rare), F.lit(True))
    assert model.languages == langs[:2]


def test_long_training_texts_give_runs_from_everywhere():
    text = " ".join(f"w{i}" for i in range(40_000))
    got = langid._part(text, 12345, 20_000)
    at = np.array([int(w[1:]) for w in got.split()])
    assert 10_000 < len(got) < 40_000 and at.min() < 8000 and at.max() > 32_000
    assert langid._part("short text", 1, 20_000) == "short text"


def test_columns_that_clash_in_another_case(spark, sf, speech):
    df = speech.limit(20).withColumns({"Score": F.lit("mine"), "LANG_PRED": F.lit(0), "Predicted": F.lit(7)})
    model = langid.fit(speech, F.lit(True))
    out = langid.labelled(df, model)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "Predicted", "lang_pred", "score"]) and out.filter("score >= 0").count() == 20
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.scored(df, quality.fit(speech, labels, F.lit(True)))
    assert sorted(kept.columns) == sorted(["doc_id", "text", "lang", "LANG_PRED", "score", "predicted"]) and kept.filter("score >= 0").count() == 20
    pages = spark.createDataFrame([(1, "http://a.org/x", "h", "p")], "page_id long, url string, Host string, PATH string")
    assert url_filter.judge(pages, queries.URL_RULES).select("host", "path", "rule").first() == ("a.org", "/x", "org/")


def test_digest_of_what_is_kept(spark):
    rows = [(1, "a b c"), (1, "a b c")]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["kept_sha256"] for r in got} == {hashlib.sha256(b"a b c").hexdigest()} and len(got) == 2
