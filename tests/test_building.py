"""Prompts, sources, splits, statistics, perturbations and streaming."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.functions import perturb, prompts
from gradus.operators import predict, splits, stats
from gradus.sources import report, tables
from gradus.streaming import live


def test_treatment_texts(spark):
    cases = [
        ("rapamycin", "none", "MTOR", None, "treatment with rapamycin (targeting MTOR)"), ("siJUN1", "nan", "JUN", "none", "siRNA knockdown of JUN"), ("shABC", "", None, None, "shRNA knockdown of ABC"),
        ("X_CRISPR", "5", None, None, "CRISPR knockout of X at dose 5"), ("Y_OE", None, None, None, "overexpression of Y"), ("LNAz", None, None, None, "LNA antisense inhibition of z"),
        ("q", None, "G", None, "knockdown of G"), ("q", None, None, "H", "overexpression of H"), ("heat", None, None, None, "treatment with heat"),
    ]
    df = spark.createDataFrame(cases, "t string, dose string, down string, up string, want string")
    got = df.withColumn("got", prompts.treatment_text(F.col("t"), F.col("dose"), F.col("down"), F.col("up"))).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_prompt_and_variants(spark):
    df = spark.createDataFrame([("f", [("a", 3.01), ("b", None), ("c", 1000.0)])], "sex string, x array<struct<name:string,value:double>>").withColumn("profile", prompts.profile_text(F.col("x")))
    m = prompts.with_prompt(df, "age", F.lit(54)).first()["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant"]
    assert "Profile: a: 3.01, c: 1000\n" in m[1]["content"] and m[2]["content"] == "54"
    v = prompts.variants(spark.createDataFrame([("m", "g", "t")], "metadata string, genera string, metabolites string"))
    shown = {r["variant"]: (r["metadata"], r["genera"], r["metabolites"]) for r in v.collect()}
    assert shown["combined"] == (None, "g", "t") and shown["full"] == ("m", "g", "t") and len(shown) == 5


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("id;x|y;z\n1;2;3\n")
    assert tables.sniff_delimiter(spark, str(tmp_path / "a.txt")) == ";"
    assert tables.read_delimited(spark, str(tmp_path / "a.txt")).first().asDict() == {"id": "1", "x|y": "2", "z": "3"}
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nbroken\n')
    rows = tables.read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    assert sorted((r["a"], r["_corrupt_record"]) for r in rows if r["a"] is not None) == [(1, None)] and any(r["_corrupt_record"] == "broken" for r in rows)
    for name, body in (("c", [{"a": 1}, {"a": 2}]), ("d", {"records": [{"a": 1}, {"a": 2}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        assert sorted(r["a"] for r in tables.read_records(spark, str(tmp_path / f"{name}.json"), "a int").collect()) == [1, 2]
    df = spark.createDataFrame([("mcq", [("user", "hi")], float("nan"))], f"format string, messages {tables.MESSAGES}, x double")
    tables.write_prompts(df, str(tmp_path / "p"), str(tmp_path / "j"))
    assert tables.read_prompts(spark, str(tmp_path / "p"), "mcq").first()["messages"][0]["content"] == "hi"
    assert tables.scrubbed(df).first()["x"] is None
    tables.write_table(df.select("format"), str(tmp_path / "t"), "\t")
    tables.write_cells(spark.createDataFrame([("m1", 1.0), ("m2", float("inf"))], "model string, x double"), str(tmp_path / "cells"))
    assert spark.read.parquet(str(tmp_path / "cells")).filter("model = 'm2'").first()["x"] is None


def test_layout_rules():
    assert tables.layout(["mass_to_charge", "Metabolite_identification", "s1"]) == "maf"
    assert tables.layout(["a"] * 501) == "wide"
    assert tables.column_roles(["s", "age", "batch", "f1"]) == {"s": "id", "age": "label", "batch": "meta", "f1": "feature"}
    assert tables.sample_columns(["S1", "a long name of a column", "database_identifier", "Unnamed: 3"], ["database_identifier"]) == ["S1"]


def test_long_features(spark):
    df = spark.createDataFrame([("x", "1.5", "n/a")], "name string, s1 string, s2 string")
    assert sorted((r["sample"], r["value"]) for r in tables.long_features(df, ["s1", "s2"], "name").collect())[0] == ("s1", 1.5)


def test_splits(spark):
    rows = [(g, "ab"[i % 2], i) for g in range(20) for i in range(g % 5 + 1)]
    df = spark.createDataFrame(rows, "g int, kind string, i int")
    for got in (splits.greedy_split(df, "g", "kind"), splits.signature_split(df, "g", "kind", least_train=5)):
        split = {r["g"]: r["split"] for r in got.collect()}
        assert set(split) == set(range(20))
        test = sum(split[g] == "test" for g, _, _ in rows)
        assert 0 < test <= 0.4 * len(rows)
    again = splits.greedy_split(df.repartition(7), "g", "kind")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in splits.greedy_split(df, "g", "kind").collect()}


def test_groups_of_a_profile_are_taken_together():
    """Plans over profiles choose as one would group by group."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        kinds = "abc"[: rng.integers(1, 4)]
        histogram = {tuple(sorted((k, int(n)) for k, n in zip(kinds, rng.integers(0, 4, len(kinds))) if n)): int(rng.integers(1, 30)) for _ in range(6)}
        histogram = sorted(((dict(p), m) for p, m in histogram.items() if p), key=lambda x: splits.order_of(x[0]))
        lacking = {k: round(n * 0.2) for k, n in splits.totals(histogram).items()}
        one = [0] * len(histogram)
        while any(v > 0 for v in lacking.values()):
            want = min((k for k, v in lacking.items() if v > 0), key=lambda k: (-lacking[k], k))
            at = min((i for i, (p, m) in enumerate(histogram) if want in p and one[i] < m), key=lambda i: (sum(histogram[i][0].values()), -histogram[i][0][want], i), default=None)  # noqa: B023
            if at is None:
                break
            one[at] += 1
            for k, n in histogram[at][0].items():
                lacking[k] -= n
        assert splits.greedy_plan(histogram, 0.2) == one


def by_signature(rows, fraction, least, stage="signature"):
    """The split group by group."""
    groups: dict = {}
    for g, k in rows:
        groups.setdefault(g, {}).setdefault(k, 0)
        groups[g][k] += 1
    total = {k: sum(p.get(k, 0) for p in groups.values()) for _, k in rows}
    room = {k: min(round(n * fraction), max(0, n - least)) for k, n in total.items()}
    test = set()
    for sig in sorted({tuple(sorted(p)) for p in groups.values()}, key=lambda s: (-len(s), s)):
        own = sorted((hashlib.md5(f"42|{stage}|{g}".encode()).hexdigest(), g) for g, p in groups.items() if tuple(sorted(p)) == sig)
        for _, g in own[: round(len(own) * fraction)]:
            if any(n > room[k] for k, n in groups[g].items()):
                break
            test.add(g)
            for k, n in groups[g].items():
                room[k] -= n
    return test


@pytest.mark.parametrize(("fraction", "least", "few"), [(0.2, 5, 4096), (0.5, 50, 4096), (0.3, 5, 1), (0.9, 0, 2)])
def test_signatures_count_rows(spark, fraction, least, few):
    rng = np.random.default_rng(8)
    rows = [(int(g), str(k)) for g in range(300) for k in rng.choice(["x", "y", "z"], rng.integers(1, 4), replace=False) for _ in range(rng.integers(1, 6))]
    df = spark.createDataFrame(rows, "g int, k string")
    got = {r["g"] for r in splits.signature_split(df, "g", "k", fraction, least, few=few).collect() if r["split"] == "test"}
    assert got == by_signature(rows, fraction, least)
    left = df.filter(~F.col("g").isin(list(got))).groupBy("k").count().collect()
    assert all(r["count"] >= min(least, sum(k == r["k"] for _, k in rows)) for r in left)


def test_splits_of_nothing_and_of_nulls(spark):
    none = spark.createDataFrame([], "g int, k string")
    assert splits.greedy_split(none, "g", "k").count() == 0 and splits.signature_split(none, "g", "k").count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, None), (1, None), (2, "a"), (3, "a")] * 4, "g int, k string")
    for got in (splits.greedy_split(odd, "g", "k", 0.3), splits.signature_split(odd, "g", "k", 0.5, 0)):
        assert sorted(str(r["g"]) for r in got.collect()) == ["1", "2", "3", "None"]


@pytest.mark.parametrize(("rho", "n", "p"), [(-0.41, 29, 0.0272), (0.5, 10, 0.1411), (0.0, 20, 1.0), (1.0, 5, 0.0), (0.3, 2, 1.0)])
def test_correlation_p(rho, n, p):
    assert stats.correlation_p(rho, n) == pytest.approx(p, abs=5e-4)


def test_perturbations(spark):
    df = spark.createDataFrame([("FOXO3 increases lifespan extension; FOXO3 and TP53", ["FOXO3", "TP53", "X"]), (None, None)], "t string, g array<string>")
    got = df.select(perturb.flipped(F.col("t")).alias("f"), perturb.wrong_genes(F.col("t"), F.col("g")).alias("w")).collect()
    assert got[0]["f"] == "FOXO3 decreases lifespan shortening; FOXO3 and TP53"
    assert got[0]["w"] == "XYZQ1 increases lifespan extension; FOXO3 and FAKE7"
    assert got[1]["f"] is None and got[1]["w"] is None


def test_predictions(spark):
    p = spark.createDataFrame([("m", "a", "p1"), ("m", "b", "p2"), ("m", "c", "bad")], "model string, id string, prompt string")
    cache = spark.createDataFrame([("m", "a", "A"), ("m", "b", "")], "model string, id string, pred string")
    cached = predict.with_cache(p, cache, ["model", "id"])
    assert {r["id"]: r["pred"] for r in predict.predicted(cached).collect()} == {"a": "A", "b": None, "c": None}

    def client(asked):
        if "bad" in asked:
            raise ValueError("no")
        return ["B"] * len(asked)

    got = {r["id"]: (r["pred"], r["error"]) for r in predict.predicted(cached.repartition(3, "id"), client).collect()}
    assert got["a"] == ("A", None) and got["c"] == (None, "no")


def test_report(spark):
    df = spark.createDataFrame([("b", 0.12345), ("a", None)], "model string, x double")
    assert report.markdown(df, "T", ["model"]) == "## T\n\n| model | x |\n|---|---|\n| a | — |\n| b | 0.123 |\n"
    assert report.interval(0.1, None) == "[0.100, —]"


def test_stream_equals_batch(spark, sf, tmp_path):
    stream = live.windowed_counts(live.read_events(spark, sf))
    q = stream.writeStream.format("memory").queryName("live_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = live.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    assert {tuple(r) for r in spark.table("live_counts").collect()} == {tuple(r) for r in batch.collect()}


def test_upserts(spark, tmp_path):
    write = live.upsert_cells(str(tmp_path / "cells"))
    write(spark.createDataFrame([("m", 1, 5, 0.1), ("m", 2, 6, 0.2)], "model string, sample int, pos int, score double"), 0)
    write(spark.createDataFrame([("m", 1, 9, 0.9), ("m", 2, 3, 0.7)], "model string, sample int, pos int, score double"), 1)
    got = {(r["sample"]): r["score"] for r in spark.read.parquet(str(tmp_path / "cells/v1")).collect()}
    assert got == {1: 0.9, 2: 0.2}
