"""Members of the survey that are operators only: A31, R05, S10, K09."""

import hashlib

import numpy as np

from gradus.operators import metrics, sampling
from gradus.sources import tables


def test_pairs_by_tissue(spark):
    rows = [(i, "abcd"[k], ) for i, k in enumerate([0] * 2 + [1] * 30 + [2] * 12 + [3] * 5)]
    df = spark.createDataFrame(rows, "pair long, organ string")
    count = lambda target: {r["organ"]: r["count"] for r in sampling.tissue_balanced_pairs(df, target, "s").groupBy("organ").count().collect()}
    assert count(40) == {"a": 2, "b": 23, "c": 10, "d": 5}
    assert count(100) == {"a": 2, "b": 30, "c": 12, "d": 5}


def test_logs_and_cache(spark, tmp_path):
    for k, row in enumerate([("p/q", {"model_name": "n"}), ("p/q", {}), (None, None)]):
        spark.createDataFrame([row], "model string, task_args map<string,string>").write.parquet(str(tmp_path / f"logs/x{k}/y"))
    assert sorted(r["model_id"] for r in tables.read_logs(spark, str(tmp_path / "logs")).collect()) == ["n", "q", "unknown"]
    tables.write_cache(spark.range(3).selectExpr("id", "'A' AS pred"), str(tmp_path / "cache"))
    manifest = spark.read.parquet(str(tmp_path / "cache/manifest")).collect()
    assert [r["n_entries"] for r in manifest] == [3] and manifest[0]["generated_at"] is not None
