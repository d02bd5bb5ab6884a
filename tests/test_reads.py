"""How often texts and rows are read: plans that grow with the input must not repeat its costly steps."""

import numpy as np
from pyspark.sql import functions as F

from gradus.functions import perturb, trace
from gradus.operators import metrics, sampling
from gradus.plans import traces
from gradus.plans.views import Views


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_directions_are_flipped_by_one_pattern(spark):
    df = spark.createDataFrame([("Increases, not İncrease; lifespan extension ",)], "t string")
    got = df.select(perturb.flipped(F.col("t")).alias("f"))
    assert "regexp_replace" not in plan(got)
    assert got.first()["f"].startswith("decreases, not decrease; lifespan shortening ")


def test_candidates_come_from_one_scan(spark, sf):
    v = Views(spark, sf)
    assert plan(v.trace.select(trace.gene_candidates(F.col("t")).alias("g"))).count("regexp_extract_all") == 1
    assert plan(traces.gene_score(v)).count("regexp_extract_all(concat_ws") == 1


def test_ranks_come_from_counts_of_pairs(spark):
    df = spark.range(100).select(F.lit("a").alias("g"), F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    assert "Range" not in plan(metrics.rank_correlation(df, ["g"], "x", "y"))


def test_large_groups_stay_where_they_lie(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("rid"))
    assert "strategy=broadcast" in plan(sampling.half_partition(df, "g", "s"))


def test_ranks_of_many_values_come_from_ranges(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, 900).tolist(), np.round(rng.standard_normal(900) ** 3, 2).tolist()
    rows = [("a" if i % 3 else None, None if i % 50 == 7 else x[i], None if i % 40 == 9 else float("nan") if i % 40 == 11 else y[i] + x[i] / 4) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x long, y double")

    def places(values):
        keys = [(v is None, v is not None and v != v, 0 if v is None or v != v else v) for v in values]
        return [sum(o < k for o in keys) + (sum(o == k for o in keys) + 1) / 2 for k in keys]

    for most in (40, 10_000):
        for a, b in (("x", "y"), ("y", "x")):
            got = {r["g"]: (r["n"], r["rho"]) for r in metrics.rank_correlation(df, ["g"], a, b, most=most).collect()}
            for g in ("a", None):
                mine = [r for r in rows if r[0] == g]
                want = np.corrcoef(places([r[1] for r in mine]), places([r[2] for r in mine]))[0, 1]
                assert got[g][0] == len(mine) and abs(got[g][1] - want) < 1e-12
    with sampling.kept(df) as rows:
        assert "Scan parquet" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 900


def test_claims_are_judged_where_texts_lie(spark, sf):
    v = Views(spark, sf)
    p = plan(traces.claims(v))
    assert p.count("Join") == 1 and "strategy=broadcast" in p
    assert plan(traces.counted(v.trace)).count("found(") == 1
    df = spark.createDataFrame([("it does not increase, no effect",), (None,), ("",), ("É increas ÎNCREAS",)], "t string")
    got = [(r["up"], r["none"]) for r in traces.counted(df).collect()]
    assert got == [(-1, 1), (0, 0), (0, 0), (1, 0)]
