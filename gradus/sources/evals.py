"""Evaluation logs: a data source over ``.eval`` archives and JSON logs, one partition for each.

An archive is a ZIP file that holds ``header.json`` (what ran: eval, status, results) and one JSON file for each sample. A log may also
be one JSON file with all of that. Files are listed once, when a read is planned; archives are opened where their partition runs, in
any store that Arrow knows. Only the header is read of a log whose model or task is not asked for, and where no sample column is
asked for; samples are read one at a time.

    evals.read(spark, "s3://logs", models=["m1"])           # a row per sample
    evals.cells(evals.read(spark, folder))                  # answer, score, pass, tokens, trace of each
    evals.latest(evals.cells(evals.read(spark, folder)))    # one per sample and model: the last log wins

A file that is no log has one row, with ``error`` and the columns of the file alone.
"""

from __future__ import annotations

import json
import math
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from gradus.functions import labels
from gradus.functions import text as T
from gradus.operators.sampling import last_per_key

#: Columns of a log, and of each of its samples.
HEADER = "path string, error string, eval_id string, model_id string, task string, lb_id string, status string, created string, scores map<string,double>"
SAMPLE = "sample_id string, epoch int, input array<struct<role:string,content:string>>, target string, completion string, total_tokens long, output_tokens long, value string, mae double, latency_s double, reasoning string, metadata string"
#: Names of the columns that need the samples.
OF_SAMPLES = {c.split()[0] for c in SAMPLE.split(", ")}


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class EvaluationLogs(DataSource):
    """Options: ``path``, a file or folder; ``models`` and ``tasks``, JSON lists of what to read; ``known``, a JSON object from parts of
    the task argument parquet_path to the lb_id that they stand for."""

    @classmethod
    def name(cls) -> str:
        return "evaluation_logs"

    def schema(self) -> str:
        return f"{HEADER}, {SAMPLE}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(dict(self.options), [f.name for f in schema.fields])


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.models, self.tasks = (set(json.loads(options[k])) if options.get(k) else None for k in ("models", "tasks"))
        self.known = json.loads(options.get("known") or "{}")

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        store, top = located(self.path)
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        return [Archive(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith((".eval", ".json"))]

    def read(self, partition: Archive) -> Iterator[tuple]:
        store, _ = located(self.path)
        try:
            with store.open_input_file(partition.path) as f:
                yield from self.rows(partition.path, f)
        except (ValueError, KeyError, zipfile.BadZipFile) as e:
            row = {"path": partition.path, "error": f"{type(e).__name__}: {e}"}
            yield tuple(row.get(c) for c in self.columns)

    def rows(self, path: str, f) -> Iterator[tuple]:
        whole = None
        if path.endswith(".eval"):
            archive = zipfile.ZipFile(f)
            head = json.loads(archive.read("header.json"))
        else:
            head = whole = json.load(f)
            if "eval" not in head:
                raise ValueError("no evaluation log")
        log = header(head, self.known) | {"path": path}
        if (self.models is not None and log["model_id"] not in self.models) or (self.tasks is not None and log["task"] not in self.tasks):
            return
        if not OF_SAMPLES & set(self.columns):
            yield tuple(log.get(c) for c in self.columns)
            return
        samples = whole.get("samples") or [] if whole else (json.loads(archive.read(n)) for n in sorted(archive.namelist()) if n.startswith("samples/") and n.endswith(".json"))
        for s in samples:
            row = log | sample(s)
            yield tuple(row.get(c) for c in self.columns)


def located(path: str):
    """(Arrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def header(head: dict, known: dict[str, str]) -> dict:
    """The columns of a log. The model is the task argument model_name, else the last part of the model's path."""
    e = head["eval"]
    args = e.get("task_args") or {}
    file = str(args.get("parquet_path") or "")
    lb_id = next((v for k, v in known.items() if k in file), args.get("lb_id") or "unknown")
    scores = {name: m.get("value") for s in (head.get("results") or {}).get("scores") or [] for name, m in (s.get("metrics") or {}).items()}
    return {
        "eval_id": e.get("eval_id"), "model_id": args.get("model_name", (e.get("model") or "unknown").split("/")[-1]), "task": e.get("task") or "", "lb_id": lb_id, "status": head.get("status") or "complete", "created": e.get("created") or "",
        "scores": {k: None if v is None or math.isnan(v) else round(float(v), 4) for k, v in scores.items()},
    }


def plain(content) -> str | None:
    """A message's content as text: parts with text are joined by a space."""
    return content if content is None or isinstance(content, str) else " ".join(p.get("text", "") if isinstance(p, dict) else str(p) for p in content)


def sample(s: dict) -> dict:
    """The columns of a sample. ``value`` is the first score's value as JSON text."""
    given, out, meta = s.get("input") or [], s.get("output") or {}, s.get("metadata") or {}
    usage, scores = out.get("usage") or {}, s.get("scores") or {}
    first = next(iter(scores.values()), {})
    choice = (out.get("choices") or [{}])[0].get("message") or out.get("message") or {}
    target = s.get("target")
    mae, late = (first.get("metadata") or {}).get("mae"), meta.get("latency_s")
    return {
        "sample_id": None if s.get("id") is None else str(s["id"]), "epoch": s.get("epoch"), "input": [("user", given)] if isinstance(given, str) else [(m.get("role"), plain(m.get("content"))) for m in given],
        "target": None if not target else str(target).strip(), "completion": out.get("completion") or plain(choice.get("content")), "total_tokens": usage.get("total_tokens"), "output_tokens": usage.get("output_tokens"),
        "value": None if first.get("value") is None else json.dumps(first["value"]), "mae": None if mae is None else float(mae), "latency_s": None if late is None else float(late),
        "reasoning": choice.get("reasoning_content") if out else None, "metadata": json.dumps(meta) if meta else None,
    }


def read(spark: SparkSession, path: str, models: list[str] | None = None, tasks: list[str] | None = None, known: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A row per sample of every log below ``path``, or per log where ``columns`` names none of a sample."""
    spark.dataSource.register(EvaluationLogs)
    reader = spark.read.format("evaluation_logs")
    for k, v in (("models", models), ("tasks", tasks), ("known", known)):
        if v is not None:
            reader = reader.option(k, json.dumps(v))
    if columns is not None:
        every = {f.name: f for f in StructType.fromDDL(f"{HEADER}, {SAMPLE}").fields}
        reader = reader.schema(StructType([every[c] for c in columns]))
    return reader.load(path)


def runs(spark: SparkSession, path: str, **options) -> DataFrame:
    """A row per log, from headers alone."""
    return read(spark, path, columns=[c.split()[0] for c in HEADER.split(", ")], **options)


def cell(completion: Column, total: Column, output: Column, truth: Column, number: Column, mae: Column, native: Column, other: Column) -> list[Column]:
    """pred, tokens, score, pass, mae, trace: the trimmed answer, total or else output tokens, the score of a truth value or a number, a
    native trace or else another one."""
    return [
        F.nullif(T.stripped(completion), F.lit("")).alias("pred"), F.coalesce(F.nullif(total, F.lit(0)), output).alias("tokens"), F.coalesce(truth.cast("double"), number).alias("score"),
        F.coalesce(truth, number >= 0.5).alias("pass"), F.round(mae, 2).alias("mae"), labels.truthy(native, other).alias("trace"),
    ]


def cells(samples: DataFrame) -> DataFrame:
    """Samples as cells: what was asked, the right answer, and :func:`cell`. A score that is text is the answer."""
    value, meta = F.col("value"), F.col("metadata")
    truth = F.when(value.isin("true", "false"), value == "true")
    said = F.when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string").v)
    fields = cell(F.col("completion"), F.col("total_tokens"), F.col("output_tokens"), truth, F.when(truth.isNull(), value.try_cast("double")), F.col("mae"), F.col("reasoning"), F.get_json_object(meta, "$.reasoning"))
    out = samples.filter("error IS NULL").select("path", "created", "model_id", "sample_id", F.coalesce(F.nullif(F.get_json_object(meta, "$.lb_id"), F.lit("")), "lb_id").alias("lb_id"), F.get_json_object(meta, "$.format").alias("format"), F.col("target").alias("gold"), T.of_role(F.col("input"), "user", True).alias("question"), T.of_role(F.col("input"), "system").alias("system"), "latency_s", said.alias("_said"), *fields)
    return out.withColumn("pred", F.coalesce("_said", "pred")).withColumn("reasoning_present", F.col("trace").isNotNull()).drop("_said")


def latest(cells: DataFrame) -> DataFrame:
    """One cell per sample and model: of several logs the one made last, then the last by path."""
    return last_per_key(cells.withColumn("_at", F.struct("created", "path")), ["sample_id", "model_id"], "_at").drop("_at")
