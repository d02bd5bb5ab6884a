"""Queries and operators that do the whole job where a given SQL fixes a smaller one."""

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_bootstrap_takes_1000_draws(spark, sf):
    from gradus.operators import metrics, resampling
    from gradus.plans.views import Views

    rows = Views(spark, sf).evb.select("model", metrics.hit(F.col("gold"), F.col("pred")).alias("v"))
    drawn = resampling.resampled(rows, ["model"], F.col("v")).groupBy("model", "d").agg(F.sum("m").alias("n")).collect()
    sizes = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}
    assert len(drawn) == 1000 * len(sizes) and all(r["n"] == sizes[r["model"]] for r in drawn)


def test_matrix_is_sorted_whole(spark):
    from gradus.plans.views import Views

    sf = "/root/testdata/sf0.01"
    n = Views(spark, sf).cells.select("sample").distinct().count()
    rows = entry.queries()["matrix_sort"](spark, sf).collect()
    assert len(rows) == n > 25 and rows == sorted(rows, key=lambda r: (-r["score"], r["sample"]))
    assert entry.queries()["matrix_sort_all"](spark, sf).count() == n


def test_preview_prints_all_features(spark, sf):
    rows = entry.queries()["csv_preview"](spark, sf).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert len(rows) == 10 and all(len(r["line"].split(",")) == min(200, len(vectors[r["vec_id"]])) > 3 for r in rows)
    lines = entry.queries()["csv_preview_200"](spark, sf).collect()
    assert len(lines) == 64 and all(len(r["line"].split(",")) == 10 for r in lines)
