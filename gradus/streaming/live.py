"""Streaming extension: counts per event type and window with late data cut off, a last-wins cell table, and the progress of runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradus.operators.sampling import last_per_key


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per tumbling window; works on batch and streaming frames."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def upsert_cells(target: str):
    """A foreachBatch writer: merges a micro-batch of cells into a Parquet table; the later position wins.

    Each batch writes a new version beside the last one, so that a failed batch leaves the table whole."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName()[1:].isdigit()) if fs.exists(path) else []
        older = [v for v in versions if v < number]
        rows = batch.unionByName(spark.read.parquet(f"{target}/v{older[-1]}")) if older else batch
        last_per_key(rows, ["model", "sample"], "pos").write.mode("overwrite").parquet(f"{target}/v{number}")

    return write


#: Samples that a run has in all, unless told otherwise.
PLANNED = 100_000


def progress(done: Column, seconds: Column, planned: int = PLANNED) -> list[Column]:
    """mean_seconds, left_over, minutes_left of a run by what is done and the seconds that it took."""
    left = F.lit(planned) - done
    return [F.round(seconds / done, 4).alias("mean_seconds"), left.alias("left_over"), F.round(seconds / done * left / 60, 4).alias("minutes_left")]


def live_runs(cells: DataFrame, run: str = "model", at: str = "ts", seconds: str = "latency", planned: int = PLANNED, late: str = "1 hour", silence_ms: int = 3_600_000) -> DataFrame:
    """(run, done, mean_seconds, left_over, minutes_left, ended) of a stream of finished samples: a row for each run that a micro-batch changes.

    A run's state is its number of samples, their seconds and the last time. A run that nothing was heard of for ``silence_ms`` of event
    time after its last sample ends: its last row says so, and its state goes. Samples without seconds do not count."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, total, last = state.get if state.exists else (0, 0.0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "done": [done], "total": [total], "ended": [True]})
            return
        for part in parts:
            done, total, last = done + len(part), total + float(part["s"].sum()), max(last, int(part["ms"].max()))
        state.update((done, total, last))
        state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"run": [key[0]], "done": [done], "total": [total], "ended": [False]})

    rows = cells.filter(F.col(seconds).isNotNull()).withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    rows = rows.select(F.col(run).alias("run"), F.col(seconds).cast("double").alias("s"), F.unix_millis("at").alias("ms"), "at")
    kept = rows.groupBy("run").applyInPandasWithState(step, "run string, done long, total double, ended boolean", "done long, total double, last long", "update", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.col("run").alias(run), "done", *progress(F.col("done"), F.col("total"), planned), "ended")
