"""Progress of runs as a stream, usage of clients, discovery in one scan, metrics by name."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gradus.operators import metrics, predict, registry
from gradus.sources import tables
from gradus.streaming import live

SCHEMA = "ts timestamp, model string, latency double"


def test_stream_of_cells_equals_batch_and_silent_runs_end(spark, tmp_path):
    batches = [
        [("2024-01-01 00:00:00", "a", 2.0), ("2024-01-01 00:10:00", "b", 4.0), ("2024-01-01 00:20:00", "a", None)],
        [("2024-01-01 01:00:00", "a", 4.0), ("2024-01-01 01:01:00", "a", 6.0)],
        [("2024-01-01 09:00:00", "a", 8.0)],
        [("2024-01-01 09:30:00", "a", 10.0)],
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("ts", "model", "latency"), r))) for r in rows))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files come in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(str(tmp_path / "in"))
    q = live.live_runs(stream, planned=100, late="10 minutes").writeStream.format("memory").queryName("live_progress").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = [tuple(r) for r in spark.table("live_progress").collect()]
    of = lambda model: sorted(x[1:] for x in got if x[0] == model)
    assert of("b") == [(1, 4.0, 99, 6.6, False), (1, 4.0, 99, 6.6, True)]  # heard of once, then silent
    last = {m: max((x for x in got if x[0] == m and not x[5]), key=lambda x: x[1]) for m in "ab"}
    cells = spark.createDataFrame([r for b in batches for r in b if r[2] is not None], "ts string, model string, latency double")
    batch = cells.groupBy("model").agg(F.count("*").alias("done"), F.sum("latency").alias("s")).select("model", "done", *live.progress(F.col("done"), F.col("s"), 100)).collect()
    assert {m: x[:5] for m, x in last.items()} == {r["model"]: tuple(r) for r in batch}
    assert [x[0] for x in of("a") if not x[4]] == [1, 3, 4, 5]


def test_usage_reasoning_and_calls_at_once(spark):

    def client(prompts):
        return [predict.Answer(f"<think> why {p} </think> A", None, len(p), 3) if p != "plain" else "B" for p in prompts]

    df = spark.createDataFrame([("xx", None), ("plain", None), ("kept", "C")], "prompt string, pred string").repartition(8)
    out = predict.predicted(df, client, usage=True, at_once=2)
    assert out.rdd.getNumPartitions() == 2
    got = {r["prompt"]: (r["pred"], r["reasoning"], r["input_tokens"], r["output_tokens"], r["error"]) for r in out.collect()}
    assert got == {"xx": ("A", "why xx", 2, 3, None), "plain": ("B", None, None, None, None), "kept": ("C", None, None, None, None)}
    assert predict.predicted(df, usage=True).columns == out.columns


def test_discovery_counts_in_one_scan(spark, tmp_path):
    for task, n in (("one", 3), ("two", 4)):
        spark.range(n).select(F.when(F.col("id") % 2 == 0, "mcq").alias("format"), "id").write.parquet(str(tmp_path / f"{task}/x_test.parquet"))
    spark.range(7).write.parquet(str(tmp_path / "one/x_train.parquet"))
    got = {r["label"]: (r["formats"], r["n_test"], r["n_train"]) for r in tables.discovered(spark, str(tmp_path)).collect()}
    assert got == {"one": (["mcq"], 3, 7), "two": (["mcq"], 4, 0)}
    (tmp_path / "none/empty").mkdir(parents=True)
    assert tables.discovered(spark, str(tmp_path / "none")).count() == 0


def test_metrics_by_name(spark):
    rows = [("m", "A", "A", "Accuracy", None), ("m", "A", "B", "accuracy", None), ("m", "A", "C", "off-by-one accuracy", None), ("m", "A", "B", "Off-By-One Accuracy", None), ("m", "x", "y", "MAE", 2.0), ("m", "x", "y", "mae", float("nan")), ("n", "A", "A", None, 1.0)]
    df = spark.createDataFrame(rows, "model string, gold string, pred string, metric string, error double")
    got = {r["model"]: (r["accuracy"], r["balanced_accuracy"], r["off_by_one_accuracy"], r["mae"]) for r in metrics.by_name(df, ["model"]).collect()}
    assert got == {"m": (0.5, None, 0.25, 2.0), "n": (None, None, None, None)}


def test_registered_tasks_solvers_and_metrics(spark):
    @registry.task("colours")
    def colours(spark, path):
        return spark.createDataFrame([(1, "sky", "blue", "x"), (2, "sea", "blue", "x"), (3, "fire", "red", "y"), (4, "?", None, "y")], "id int, prompt string, gold string, kind string")

    @registry.metric("hits")
    def hits(df, by):
        return df.groupBy(*by).agg(F.count_if(F.col("gold") == F.col("pred")).alias("hits"))

    got = {r["kind"]: r["accuracy"] for r in registry.evaluate(spark, "colours", "majority", "", by=["kind"]).collect()}
    assert got == {"x": 1.0, "y": 0.0}
    asked = registry.asking(lambda prompts: ["red" if p == "fire" else "blue" for p in prompts])
    assert registry.evaluate(spark, "colours", asked, "", counts="hits").first()["hits"] == 3
    assert registry.evaluate(spark, "colours", "random letter", "", counts="hits").first()["hits"] == 0
    with pytest.raises(KeyError, match="no solver 'nobody'; there are majority"):
        registry.evaluate(spark, "colours", "nobody", "")
    with pytest.raises(KeyError, match="no task"):
        registry.evaluate(spark, "none", "majority", "")
