"""Reading rules, registries, discovery, reports, clients: fixtures in temporary folders."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import metrics, predict, sampling, splits
from gradus.sources import report, tables


@pytest.mark.parametrize(("head", "want"), [("a;b;c\nd;e,x;f\n", ";"), ("a\tb,c\nd\te\n", "\t"), ("PC(16:0|18:1),x\ny,z\n", ","), ('"a,b";c\n"d";e\n', ";"), ("alone\n", ","), ("a\tb\nc\n", "\t"), ("", ",")])
def test_delimiters(head, want):
    assert tables.delimiter_of(head) == want


def test_endings_in_any_case(spark):
    assert tables.sniff_delimiter(spark, "/nowhere/a.TSV") == "\t" and tables.sniff_delimiter(spark, "/nowhere/a.Csv") == ","


def test_layouts():
    numbers = [["s", *["1.5"] * 6]] * 11
    assert tables.layout(["id", *"abcdef"], numbers) == "wide"
    assert tables.layout(["id", *"abcdef"], numbers[:10]) == "generic"
    assert tables.layout(["id", *"abcde"], [r[:6] for r in numbers]) == "generic"


def test_nested_numbers_are_scrubbed(spark):
    bad = float("nan")
    df = spark.createDataFrame([(bad, [1.0, float("inf")], {"k": bad}, (bad, "x"))], "a double, b array<double>, c map<string,double>, d struct<e:double,f:string>")
    r = tables.scrubbed(df).first()
    assert (r["a"], r["b"], r["c"], tuple(r["d"])) == (None, [1.0, None], {"k": None}, (None, "x"))


def test_lines_in_order_and_mirrors(spark, tmp_path):
    df = spark.range(100).select((99 - F.col("id")).alias("row_index"), F.lit("x").alias("v")).repartition(7)
    tables.write_ordered_lines(df, str(tmp_path / "lines"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*")))
    assert [json.loads(x)["row_index"] for x in text.splitlines()] == list(range(100))
    tables.write_mirrored(df, str(tmp_path / "a"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count() == 100


def test_registry(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("models:\n  one:\n    type: baseline\n    args: {think: false}\n  two: {}\n")
    assert tables.read_models(str(tmp_path / "m.yaml")) == {"one": {"type": "baseline", "args": {"think": False}}, "two": {}}


def test_siblings():
    assert tables.siblings("a_test.parquet") == ("a_train.parquet", "a_test.parquet") == tables.siblings("a_train.parquet")
    assert tables.siblings("a.parquet") == (None, "a.parquet")


def test_discovery(spark, tmp_path):
    put = lambda at, n: spark.range(n).select("id", F.lit("mcq").alias("format")).write.parquet(str(tmp_path / at))
    put("one/processed/x_test.parquet", 3), put("one/processed/x_test_30.parquet", 1), put("one/z_train.parquet", 9), put("one/processed/x_train.parquet", 5)
    put("two/b_train.parquet", 2), (tmp_path / "three").mkdir(), (tmp_path / ".hidden").mkdir()
    got = {r["label"]: (r["test"] and r["test"].rsplit("/", 1)[1], r["train"].rsplit("/", 1)[1], r["formats"], r["n_test"], r["n_train"]) for r in tables.discovered(spark, str(tmp_path)).collect()}
    assert got == {"one": ("x_test.parquet", "x_train.parquet", ["mcq"], 3, 5), "two": (None, "b_train.parquet", [], 0, 2)}


def test_latest_file(spark, tmp_path):
    import os

    for k, name in enumerate("bca"):
        (tmp_path / f"{name}.log").write_text("x")
        os.utime(tmp_path / f"{name}.log", (1_700_000_000 + k, 1_700_000_000 + k))
    assert tables.latest_file(spark, str(tmp_path / "*.log")).endswith("a.log")


def test_report_sections(spark):
    ev = spark.createDataFrame([("m", "A", "A"), ("m", "A", "B"), ("m", "B", "B"), ("m", "C", "A"), ("n", "B", "A")], "model string, gold string, pred string")
    n = metrics.confusion_counts(ev, ["model"])
    bounds = spark.createDataFrame([("mcq", "m", 0.25, 1.0)], "format string, model string, ci_low double, ci_high double")
    text = report.analysis({"mcq": metrics.accuracy(ev, ["model"])}, n, n.filter("gold <> pred"), bounds, spark.createDataFrame([("mcq", 5)], "format string, n long"))
    assert "| m | 4 | 0.500 | [0.250, 1.000] |" in text and "| n | 1 | 0.000 | — |" in text
    assert "### Confusion of m" in text and "| A | 1 | 1 | 0 |" in text and "* A taken for B: 1" in text


def test_client_failures_stay_with_their_rows(spark):
    df = spark.createDataFrame([("a", "good", None), ("b", "bad", None), ("c", "known", "Z"), ("d", "late", None), ("e", "never", None)], "id string, prompt string, pred string").coalesce(1)

    def client(prompts):
        if any(p == "bad" for p in prompts):
            raise predict.Refused("refused")
        if any(p == "never" for p in prompts):
            raise OSError("down")
        if prompts == ["late"] and not hasattr(time, "_once"):
            time._once = True
            raise OSError("busy")
        return [p.upper() for p in prompts]

    got = {r["id"]: (r["pred"], r["error"]) for r in predict.predicted(df, client, tries=2, wait=lambda k: 0.0).collect()}
    assert got == {"a": ("GOOD", None), "b": (None, "refused"), "c": ("Z", None), "d": ("LATE", None), "e": (None, "down")}


def test_running_counts_over_ranges(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(int(g), float(x)) for g, x in zip(rng.integers(0, 2, 3000), np.round(rng.standard_normal(3000) ** 3, 3))})
    per = spark.createDataFrame([(g, x, int(i % 4) + 1) for i, (g, x) in enumerate(rows)], "g int, x double, k long")
    got = {(r["g"], r["x"]): r["below"] for r in metrics.counted_below(per, ["g"], "x", "k", most=50).collect()}
    want, total = {}, {}
    for i, (g, x) in enumerate(rows):
        want[g, x] = total.get(g, 0)
        total[g] = want[g, x] + i % 4 + 1
    assert got == want


def test_names_repeat_by_what_was_made(spark):
    rows = [(1, "a", "_1"), (2, "a", "_2"), (3, "a_2", "_3"), (4, "a_2_3", "_4"), (5, "b", "_5"), (6, "b_9", "_6"), (7, "b", "_9")]
    df = spark.createDataFrame(rows, "pos long, name string, s string")
    got = {r["pos"]: r["unique_name"] for r in sampling.unique_names(df, "name", F.col("s"), "pos").collect()}
    seen, want = set(), {}
    for pos, name, s in rows:
        want[pos] = name + s if name in seen else name
        seen.add(want[pos])
    assert got == want and want[4] == "a_2_3_4" and want[6] == "b_9"


def test_greedy_split_of_many_groups(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("acc"), (F.col("id") % 3).cast("string").alias("kind"))
    got = splits.greedy_split(df, "acc", "kind").join(df, "acc").groupBy("kind").agg(F.avg((F.col("split") == "test").cast("int")).alias("share")).collect()
    assert len(got) == 3 and all(0.19 <= r["share"] <= 0.25 for r in got)
