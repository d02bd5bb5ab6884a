"""Tasks, solvers and metrics by name, so that an evaluation is three words: what to ask, who answers, how it counts.

    @task("colours", metric="accuracy")
    def colours(spark, path): ...            # rows (id, prompt, gold) and whatever the solver wants

    evaluate(spark, "colours", "majority", path, by=["format"])

A task gives rows with an id, a prompt and the right answer; a solver adds ``pred``; a metric turns (gold, pred) rows into a frame
with a row per group. All three are DataFrame to DataFrame, so that an evaluation is one Spark job over the whole dataset.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.operators import metrics, predict

Rows = Callable[[SparkSession, str], DataFrame]
Solver = Callable[[DataFrame], DataFrame]
Metric = Callable[[DataFrame, list[str]], DataFrame]


@dataclass
class Task:
    name: str
    rows: Rows
    metric: str


TASKS: dict[str, Task] = {}
SOLVERS: dict[str, Solver] = {}
METRICS: dict[str, Metric] = {
    "accuracy": metrics.accuracy, "balanced accuracy": metrics.balanced_accuracy, "macro f1": metrics.macro_f1, "regression": metrics.regression, "spearman": metrics.spearman,
    "off-by-one accuracy": lambda df, by: df.groupBy(*by).agg(F.round(F.avg(metrics.off_by_one_score(F.col("gold"), F.col("pred"))), 6).alias("off_by_one_accuracy")),
    "confusion": metrics.confusion_matrix,
}


def known(table: dict, kind: str, name: str):
    if name not in table:
        raise KeyError(f"no {kind} {name!r}; there are {', '.join(sorted(table)) or 'none'}")
    return table[name]


def task(name: str, metric: str = "accuracy") -> Callable[[Rows], Rows]:
    def register(f: Rows) -> Rows:
        TASKS[name] = Task(name, f, metric)
        return f

    return register


def solver(name: str) -> Callable[[Solver], Solver]:
    def register(f: Solver) -> Solver:
        SOLVERS[name] = f
        return f

    return register


def metric(name: str) -> Callable[[Metric], Metric]:
    def register(f: Metric) -> Metric:
        METRICS[name] = f
        return f

    return register


def asking(client: predict.Client, **options) -> Solver:
    """A solver that asks a client; see :func:`gradus.operators.predict.predicted`."""
    return lambda rows: predict.predicted(rows.withColumn("pred", F.lit(None).cast("string")), client, **options)


@solver("majority")
def majority(rows: DataFrame) -> DataFrame:
    """The most frequent right answer, ties by order; what an evaluation has to beat."""
    counts = rows.filter("gold IS NOT NULL").groupBy("gold").agg(F.count("*").alias("n"))
    best = counts.agg(F.min_by("gold", F.struct(-F.col("n"), "gold")).alias("pred"))
    return rows.join(F.broadcast(best))  # one row


@solver("random letter")
def random_letter(rows: DataFrame) -> DataFrame:
    """One of the letters A to C by the md5 of the id."""
    pick = metrics.uniform(F.concat_ws("|", F.lit("42"), F.lit("random"), "id"), F.lit(3))
    return rows.withColumn("pred", F.element_at(F.array(*map(F.lit, "ABC")), pick.cast("int") + 1))


def evaluate(spark: SparkSession, name: str, by_whom: str | Solver, path: str, by: list[str] | None = None, counts: str | None = None) -> DataFrame:
    """The metric of a task's rows, answered by a solver, per group of ``by`` or over all; ``counts`` names another metric than the task's."""
    what = known(TASKS, "task", name)
    answered = (known(SOLVERS, "solver", by_whom) if isinstance(by_whom, str) else by_whom)(what.rows(spark, path))
    keys = by or ["task"]
    out = known(METRICS, "metric", counts or what.metric)(answered if by else answered.withColumn("task", F.lit(name)), keys)
    return out
