"""Readers and writers: delimited and JSON tables, prompts, logs, datasets; rules for unknown layouts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

PROMPT = "lb_id string, pool string, display_name string, display_group string, domain string, format string, metric string, units string, messages array<struct<role:string,content:string>>, task string, has_reasoning boolean, metadata string"
MESSAGES = "array<struct<role:string,content:string>>"
# Names that tell what a column holds.
ID_HINTS = ["sample", "id", "subject", "patient"]
LABEL_HINTS = ["age", "label", "group", "diagnosis", "outcome", "target"]
META_HINTS = ["sex", "gender", "batch", "tissue", "organ", "study", "date"]


#: Characters at the start of a file that tell its delimiter.
HEAD = 4096


def delimiter_of(head: str) -> str:
    """Of comma, tab and semicolon the one that cuts all lines alike, most cuts first; else a tab if there is one, else a comma.

    A last line that the head cuts short does not count. Signs inside double quotes are no delimiters."""
    bare = re.sub(r'"[^"]*"', "", head)
    lines = bare.split("\n")
    lines = [x for x in (lines[:-1] if len(head) >= HEAD and len(lines) > 1 else lines) if x.strip()]
    alike = {d: counts.pop() for d in "\t,;" if len(counts := {x.count(d) for x in lines}) == 1}
    best = max(alike, key=alike.get, default="")
    return best if best and alike[best] else "\t" if "\t" in head else ","


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """By the file's ending in any case, else by its first characters."""
    if path.lower().endswith(".tsv"):
        return "\t"
    if path.lower().endswith(".csv"):
        return ","
    lines = spark.read.text(path).select(F.left("value", F.lit(HEAD)).alias("value")).limit(200).collect()
    return delimiter_of("\n".join(r["value"] for r in lines)[:HEAD])


def read_delimited(spark: SparkSession, path: str, schema: str | None = None, delimiter: str | None = None) -> DataFrame:
    """A table with a header. Without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("sep", delimiter or sniff_delimiter(spark, path)).option("enforceSchema", False if schema is None else True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records, with the text of lines that are not JSON in ``_corrupt_record``; blank lines are skipped."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that is a list of records or holds one under ``records``."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    rows = F.when(F.col("value").startswith("["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.from_json("value", f"records array<struct<{schema}>>").records)
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_prompts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Prompt records; messages stored as JSON text are parsed."""
    df = spark.read.parquet(path)
    if dict(df.dtypes)["messages"] == "string":
        df = df.withColumn("messages", F.from_json("messages", MESSAGES))
    return df if kind is None else df.filter(F.col("format") == kind)


def write_prompts(df: DataFrame, parquet: str, lines: str | None = None) -> None:
    """Parquet with messages as JSON text, and JSON lines with them nested."""
    df.withColumn("messages", F.to_json("messages")).write.mode("overwrite").parquet(parquet)
    if lines:
        df.write.mode("overwrite").json(lines)


def write_ordered_lines(df: DataFrame, path: str, order: str = "row_index") -> None:
    """JSON lines in the order of ``order``, in files whose names sort as their rows do."""
    df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").json(path)


def write_mirrored(df: DataFrame, path: str, mirror: str) -> None:
    """Parquet, and a public copy made from what was written, so that the frame is computed once."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.read.schema(df.schema).parquet(path).write.mode("overwrite").parquet(mirror)


def _finite(x: Column, kind: DataType) -> Column:
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~(F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), x)
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda y: _finite(y, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(x, lambda _, y: _finite(y, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(x.isNotNull(), F.struct(*[_finite(x[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    return x


def scrubbed(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, inside arrays, maps and structs too."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def write_cells(df: DataFrame, path: str) -> None:
    """Log cells by model, so that a reader of one model reads its folder alone."""
    scrubbed(df).write.mode("overwrite").partitionBy("model").parquet(path)


def write_cache(entries: DataFrame, path: str) -> None:
    """Cache entries under ``entries``, and their manifest, one row (generated_at, n_entries), under ``manifest``."""
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    written = entries.sparkSession.read.schema(entries.schema).parquet(f"{path}/entries")
    written.agg(F.current_timestamp().alias("generated_at"), F.count("*").alias("n_entries")).write.mode("overwrite").parquet(f"{path}/manifest")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation logs in all folders below ``path``, with ``model_id``: the task argument model_name, else the last part of the model's path."""
    logs = spark.read.option("recursiveFileLookup", True).parquet(path)
    model = F.when(F.coalesce(F.col("model"), F.lit("")) == "", "unknown").otherwise(F.col("model"))
    named = F.coalesce(F.map_contains_key("task_args", "model_name"), F.lit(False))
    return logs.withColumn("model_id", F.when(named, F.col("task_args")["model_name"]).otherwise(F.element_at(F.split(model, "/"), -1)))


def summary(rows: list[dict], path: str | None = None) -> str:
    """Sorted JSON of a bounded list of metric rows."""
    text = json.dumps(rows, indent=2, sort_keys=True)
    if path:
        with open(path, "w") as f:
            f.write(text)
    return text


def layout(columns: list[str], rows: list[list[str]] | None = None) -> str:
    """``maf`` by its identification columns; ``wide`` beyond 500 columns or where more than five columns after the first hold more
    than ten numbers among the first twenty ``rows``; else ``generic``."""
    low = {c.lower() for c in columns}
    if {"metabolite_identification", "mass_to_charge"} <= low:
        return "maf"
    numeric = [sum(_number(r[i]) for r in (rows or [])[:20]) > 10 for i in range(1, len(columns))]
    return "wide" if len(columns) > 500 or sum(numeric) > 5 else "generic"


def _number(x: str | None) -> bool:
    try:
        return x is not None and float(x) == float(x)
    except ValueError:
        return False


def layout_of(df: DataFrame) -> str:
    """Layout of a table of strings, by its header and its first twenty rows."""
    return layout(df.columns, [list(r) for r in df.limit(20).collect()])


def read_models(path: str) -> dict[str, dict]:
    """The model registry of a YAML file: settings by name. Needs the yaml package."""
    import yaml

    with open(path) as f:
        return dict((yaml.safe_load(f) or {}).get("models") or {})


def siblings(name: str) -> tuple[str | None, str]:
    """(train, test) file names of a split by either of them; a name that is neither is a test file without a sibling."""
    test, train = "_test.parquet", "_train.parquet"
    if name.endswith(train):
        return name, name[: -len(train)] + test
    return (name[: -len(test)] + train if name.endswith(test) else None), name


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(label, test, train, formats, n_test, n_train) of every task folder below ``root``.

    A task's files lie in its folder ``processed``, else in its own; of several the first by name counts, and test files whose
    name ends in ``_30`` or ``_100`` are parts of others."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def found(pattern: str) -> list[str]:
        return sorted(str(x.getPath()) for x in fs.globStatus(fs_path(pattern)) or [])

    rows = []
    for task in found(f"{root}/[!.]*"):
        for folder in (f"{task}/processed", task):
            test, train = found(f"{folder}/*_test.parquet"), found(f"{folder}/*_train.parquet")
            if test or train:
                rows.append((task.rsplit("/", 1)[-1], test[0] if test else None, train[0] if train else None))
                break
    listed = spark.createDataFrame(rows, "label string, test string, train string")
    files = [f for r in rows for f in r[1:] if f]
    if not files:
        return listed.select("*", F.array().cast("array<string>").alias("formats"), F.lit(0).cast("long").alias("n_test"), F.lit(0).cast("long").alias("n_train"))
    # One scan counts all files; a file's rows are those whose path begins with it, as it may be a folder of parts.
    at = F.element_at(F.filter(F.lit([f.split(":", 1)[-1].lstrip("/") for f in files]), lambda f: F.contains(F.col("_metadata.file_path"), f)), 1)
    every = spark.read.schema("format string").parquet(*files)
    counts = every.groupBy(at.alias("_file")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("format")).alias("kinds"))
    of = lambda c, n: F.col(f"{n}._file") == F.ltrim(F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:", ""), "^/+", ""))
    met = listed.join(counts.alias("t"), of("test", "t"), "left").join(counts.alias("u"), of("train", "u"), "left")
    return met.select("label", "test", "train", F.coalesce("t.kinds", F.array().cast("array<string>")).alias("formats"), F.coalesce("t.n", F.lit(0)).alias("n_test"), F.coalesce("u.n", F.lit(0)).alias("n_train"))


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """Path of the file that was changed last; of several the last by name."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def column_roles(columns: list[str]) -> dict[str, str]:
    """id, label, meta or feature for every column; in wide tables only the first 20 columns can be anything but features."""
    roles = {}
    for i, c in enumerate(columns):
        words = set(re.split(r"[^a-z]+", c.lower()))
        if len(columns) > 500 and i >= 20:
            roles[c] = "feature"
        elif i == 0:
            roles[c] = "id"
        elif words & set(LABEL_HINTS):
            roles[c] = "label"
        elif words & set(META_HINTS):
            roles[c] = "meta"
        else:
            roles[c] = "id" if words & set(ID_HINTS) and len(columns) <= 500 else "feature"
    return roles


def sample_columns(columns: list[str], annotations: list[str]) -> list[str]:
    """Columns that look like sample names: short, without spaces, neither annotation nor unnamed."""
    return [c for c in columns if len(c) <= 20 and " " not in c and c not in annotations and not c.lower().startswith("unnamed")]


def long_features(df: DataFrame, samples: list[str], name: str) -> DataFrame:
    """(feature, sample, value) of a matrix with one row per feature."""
    return df.select(name, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in samples]).unpivot(name, samples, "sample", "value").withColumnRenamed(name, "feature")
