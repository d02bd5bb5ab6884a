"""Ranks of large groups, put together from buckets."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from gradus.operators import sampling


def test_ranks_come_from_buckets(spark):
    rows = [(i, None if i % 11 == 0 else "ab"[i % 7 == 0]) for i in range(6000)]
    df = spark.createDataFrame(rows, "rid long, label string")
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42|s|{r[0]}".encode()).hexdigest(), r[0]))
    groups = {g: [i for i, x in order if x == g] for g in (None, "a", "b")}
    got = {r["rid"]: (r["label"], r["rn"]) for r in sampling.bucket_ranked(df, "label", "s", "rid").collect()}
    assert got == {i: (g, k + 1) for g, ids in groups.items() for k, i in enumerate(ids)}
    half = {r["rid"]: r["half"] for r in sampling.half_partition(df, "label", "s").collect()}
    assert half == {i: int(k >= len(groups[g]) // 2) for g in groups for k, i in enumerate(groups[g])}
    least = min(map(len, groups.values()))
    assert {r["rid"] for r in sampling.equalize(df, "label", "s").collect()} == {i for ids in groups.values() for i in ids[:least]}


def test_no_class_is_sorted_in_one_task(spark):
    df = spark.createDataFrame([(1, "a")], "rid long, label string")
    for got in (sampling.half_partition(df, "label", "s"), sampling.equalize(df, "label", "s")):
        windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", got._jdf.queryExecution().optimizedPlan().toString())
        assert windows and all("_bucket" in w for w in windows)


@pytest.mark.parametrize("quota", [0, 1, 7, 500, 10_000])
def test_quotas_take_the_first_rows_of_the_order(spark, quota):
    rows = [(None if i % 5 == 0 else "ab"[i % 2], i) for i in range(3000)] + [("few", 9001), ("few", 9002)]
    df = spark.createDataFrame(rows, "g string, rid long").repartition(3)
    got = {(r["g"], r["rid"]) for r in sampling.within_quota(df, ["g"], lambda sizes: sizes.withColumn("quota", F.lit(quota)), "s").collect()}
    want = set()
    for g in (None, "a", "b", "few"):
        own = sorted((hashlib.md5(f"42|s|{i}".encode()).hexdigest(), i) for x, i in rows if x == g)
        want |= {(g, i) for _, i in own[:quota]}
    assert got == want


def test_only_rows_near_the_quota_are_ranked(spark):
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("rid"))
    keyed, ends = sampling.prefix_cuts(df, ["g"], lambda sizes: sizes.withColumn("quota", F.lit(100)), "s", "rid")
    near = sampling._meeting(keyed, ends, ["g"]).filter("_bucket <= _end")
    assert 200 <= near.count() < 1000
    plan = sampling.within_quota(df, ["g"], lambda sizes: sizes.withColumn("quota", F.lit(100)), "s")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[plan.index("Window [row_number"):]
    assert "Join" in above.split("Window [row_number", 2)[1]  # the window stands on the filtered join
    assert sampling.within_quota(df, ["g"], lambda sizes: sizes.withColumn("quota", F.lit(100)), "s").count() == 200
    assert {r["half"]: r["count"] for r in sampling.half_partition(df, "g", "s").groupBy("half").count().collect()} == {0: 100_000, 1: 100_000}
