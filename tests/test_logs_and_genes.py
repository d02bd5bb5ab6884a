"""The evaluation-log source on archives made here, and the look-up of genes."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gradus.operators import genes
from gradus.sources import evals


def archive(path, model, created, samples, args=None, task="t", results=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    head = {"eval": {"eval_id": path.stem, "model": model, "task": task, "created": created, "task_args": args or {}}, "status": "success", "results": results}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("header.json", json.dumps(head))
        for i, s in enumerate(samples):
            z.writestr(f"samples/{i}_epoch_1.json", json.dumps(s))


def one(i, completion, value, **more):
    return {"id": i, "epoch": 1, "target": " A ", "input": [{"role": "system", "content": "S"}, {"role": "user", "content": "first"}, {"role": "user", "content": [{"type": "text", "text": "last"}, {"type": "image"}]}],
            "output": {"completion": completion, "usage": {"total_tokens": 0, "output_tokens": 7}}, "scores": {"s": {"value": value, "metadata": {"mae": 1.23456}}}} | more


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    at = tmp_path_factory.mktemp("logs")
    archive(at / "a/x.eval", "org/m1", "2024-01-01", [one(1, " B ", True), one(2, "", 0.25)], results={"scores": [{"metrics": {"acc": {"value": 0.123456}, "bad": {"value": float("nan")}}}]})
    archive(at / "b/deep/y.eval", "org/m1", "2024-02-01", [one(1, "C", False, metadata={"latency_s": 1.5, "lb_id": "own", "format": "mcq", "reasoning": "because"})], {"parquet_path": "/d/task_x/f.parquet", "lb_id": "given"})
    archive(at / "z.eval", None, "2024-01-15", [one("q", "x", "said so"), one(1, "D", 1)], {"model_name": "m2"}, task="u")
    (at / "w.json").write_text(json.dumps({"eval": {"model": "p/m3", "created": "2023"}, "samples": [{"id": 9, "input": "plain", "output": {"choices": [{"message": {"content": "ok", "reasoning_content": "native"}}]}}]}))
    (at / "broken.eval").write_bytes(b"no archive")
    (at / "list.json").write_text('{"x": 1}')
    (at / "notes.txt").write_text("not a log")
    return at


def test_a_row_per_sample(spark, logs):
    df = evals.read(spark, str(logs), known={"task_x": "known"})
    assert df.rdd.getNumPartitions() == 6
    rows = {(r["path"].rsplit("/", 1)[-1], r["sample_id"]): r for r in df.collect()}
    assert set(rows) == {("x.eval", "1"), ("x.eval", "2"), ("y.eval", "1"), ("z.eval", "q"), ("z.eval", "1"), ("w.json", "9"), ("broken.eval", None), ("list.json", None)}
    assert [rows[k]["model_id"] for k in (("x.eval", "1"), ("z.eval", "q"), ("w.json", "9"))] == ["m1", "m2", "m3"]
    assert [rows[k]["lb_id"] for k in (("x.eval", "1"), ("y.eval", "1"))] == ["unknown", "known"]
    assert rows["x.eval", "1"]["scores"] == {"acc": 0.1235, "bad": None} and rows["w.json", "9"]["status"] == "complete"
    assert rows["broken.eval", None]["error"] and "no evaluation log" in rows["list.json", None]["error"]


def test_cells_and_last_wins(spark, logs):
    cells = {(r["path"].rsplit("/", 1)[-1], r["sample_id"]): r for r in evals.cells(evals.read(spark, str(logs))).collect()}
    a = cells["x.eval", "1"]
    assert (a["pred"], a["score"], a["pass"], a["tokens"], a["mae"], a["gold"], a["question"], a["system"]) == ("B", 1.0, True, 7, 1.23, "A", "last ", "S")
    b = cells["x.eval", "2"]
    assert (b["pred"], b["score"], b["pass"], b["trace"], b["reasoning_present"]) == (None, 0.25, False, None, False)
    c = cells["y.eval", "1"]
    assert (c["lb_id"], c["format"], c["latency_s"], c["trace"], c["pass"]) == ("own", "mcq", 1.5, "because", False)
    assert cells["z.eval", "q"]["pred"] == "said so" and cells["z.eval", "q"]["score"] is None
    assert (cells["w.json", "9"]["trace"], cells["w.json", "9"]["pred"], cells["w.json", "9"]["question"]) == ("native", "ok", "plain")
    last = {(r["sample_id"], r["model_id"]): r["pred"] for r in evals.latest(evals.cells(evals.read(spark, str(logs)))).collect()}
    assert last == {("1", "m1"): "C", ("2", "m1"): None, ("q", "m2"): "said so", ("1", "m2"): "D", ("9", "m3"): "ok"}


def test_models_columns_and_headers(spark, logs, monkeypatch):
    assert {r["model_id"] for r in evals.read(spark, str(logs), models=["m2"]).filter("error IS NULL").collect()} == {"m2"}
    assert evals.read(spark, f"file://{logs}", tasks=["u"], columns=["sample_id", "task"]).filter("task IS NOT NULL").count() == 2
    few = evals.read(spark, str(logs / "a/x.eval"), columns=["sample_id", "completion"])
    assert few.columns == ["sample_id", "completion"] and sorted(few.collect()) == [("1", " B "), ("2", None)]
    got = evals.runs(spark, str(logs)).filter("error IS NULL").collect()
    assert sorted(r["model_id"] for r in got) == ["m1", "m1", "m2", "m3"]
    read = []
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, f=zipfile.ZipFile.read: read.append(name) or f(self, name))
    for options in ({"models": '["other"]'}, {}):
        source = evals.LogReader({"path": str(logs / "a"), **options}, ["model_id"])
        assert len([r for p in source.partitions() for r in source.read(p)]) == (not options)
    assert read == ["header.json"] * 2


DIMENSION = [
    ("TP53", ["P53", "LFS1"], 9606, 7157), ("Trp53", ["p53"], 10090, 22059), ("ABC1", ["X1"], 9606, 50), ("ABC2", ["X1"], 9606, 40), ("ABC3", ["X1"], 10090, 1),
    ("daf-2", None, 6239, 3), ("lost", ["L"], 7, 9), ("", ["E"], 9606, 2), ("abc1", [], 9606, 60), ("X1", [], 4932, 99), ("DUP", ["D1", None, ""], 9606, 5), ("DUP", ["D1"], 9606, 5),
]


@pytest.mark.parametrize("most", [10**6, 0])
def test_precedence_and_ambiguity(spark, most):
    dim = spark.createDataFrame(DIMENSION, "symbol string, aliases array<string>, taxid int, entrez_id long")
    asked = spark.createDataFrame([(x,) for x in ["TP53", "trp53", "p53", "P53", "X1", "x1", "DAF-2", "L", "lost", "E", "ABC1", "Abc1", "D1", "none", "TP53", None]], "name string")
    got = {r["name"]: (r["verified"], r["symbol"], r["species"], r["entrez_id"], r["ambiguous"]) for r in genes.looked_up(asked, dim, most=most).collect()}
    assert got["TP53"] == (True, "TP53", "human", 7157, False)
    assert got["trp53"] == (True, "Trp53", "mouse", 22059, False)
    assert got["p53"] == (True, "Trp53", "mouse", 22059, False) and got["P53"] == (True, "TP53", "human", 7157, False)  # same spelling first
    assert got["X1"] == got["x1"] == (True, "X1", "yeast", 99, False)  # a symbol before aliases
    assert got["DAF-2"][1] == "daf-2" and got["D1"] == (True, "DUP", "human", 5, False)
    assert got["ABC1"] == (True, "ABC1", "human", 50, False) and got["Abc1"] == (True, "ABC1", "human", 50, True)  # two symbols in another case
    assert [got[x][0] for x in ("L", "lost", "E", "none", None)] == [False] * 5
    alias = genes.looked_up(asked, dim.filter("symbol <> 'X1'"), most=most).filter("name = 'X1'").first()
    assert (alias["symbol"], alias["entrez_id"], alias["ambiguous"]) == ("ABC2", 40, True)


def test_known_names_of_texts(spark):
    dim = spark.createDataFrame(DIMENSION, "symbol string, aliases array<string>, taxid int, entrez_id long")
    texts = spark.createDataFrame([(1, ["TP53", "p53", "no", "TP53"]), (2, []), (3, ["no"]), (4, ["DUP"])], "id int, names array<string>")
    got = {r["id"]: (r["genes"], r["known"]) for r in genes.known_counts(texts, "id", F.col("names"), dim, F.col("name") != "DUP").collect()}
    assert got == {1: (3, 2), 2: (0, 0), 3: (1, 0), 4: (1, 0)}
