"""Resamples from counts and exact quantiles, against exact distributions, row-by-row draws and sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import metrics, resampling
from gradus.operators.quantiles import quantiles


def exact_quantile(u, n, p):
    total = 0.0
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        if total >= u:
            return k
    return n


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (7, 0.3), (40, 0.02), (300, 0.77), (2000, 0.999), (5000, 1e-4)])
def test_binomial_quantiles(n, p):
    u = np.concatenate([(np.arange(50) + 0.5) / 50, [1e-9, 1 - 1e-9]])
    assert resampling.binomial_quantile(u, np.full(len(u), n), p).tolist() == [exact_quantile(x, n, p) for x in u]


def test_binomials_of_many_rows():
    n, p = 10**11, 0.3
    u = (np.arange(99) + 1) / 100
    got = resampling.binomial_quantile(u, np.full(99, n), p)
    sd = math.sqrt(n * p * (1 - p))
    assert abs(got[49] - n * p) < 2 and abs((got[83] - n * p) / sd - 0.99446) < 1e-3 and (np.diff(got) > 0).all()
    assert resampling.binomial_quantile(np.array([0.5]), np.array([0]), 0.3)[0] == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_draws_hold_all_rows_and_follow_the_counts(spark, block):
    k = {0: 5, 1: 20, 2: 1, 3: 60, 4: 14}
    df = spark.createDataFrame([("a" if g else None, v) for g in (0, 1) for v, n in k.items() for _ in range(n)], "g string, v int")
    got = resampling.resampled(df, ["g"], F.col("v"), draws=400, block=block).collect()
    sums, means = {}, {}
    for r in got:
        sums[r["g"], r["d"]] = sums.get((r["g"], r["d"]), 0) + r["m"]
        means[r["g"], r["v"]] = means.get((r["g"], r["v"]), 0) + r["m"] / 400
    assert len(sums) == 800 and set(sums.values()) == {100}
    for (_, v), m in means.items():
        assert abs(m - k[v]) < 5 * math.sqrt(k[v] * (1 - k[v] / 100) / 400)


def test_intervals_are_those_of_rows_drawn_one_by_one(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(np.round(x + y, 1))) for x, y in np.round(rng.standard_normal((60, 2)), 1)]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, gold double, pred double")
    own = np.array(rows)[rng.integers(0, 60, (4000, 60))]

    def ranks(v):
        return (v[:, None, :] < v[:, :, None]).sum(axis=2) + ((v[:, None, :] == v[:, :, None]).sum(axis=2) + 1) / 2

    a, b = ranks(own[:, :, 0]), ranks(own[:, :, 1])
    rho = np.array([np.corrcoef(x, y)[0, 1] for x, y in zip(a, b)])
    for block in (16, 4096):
        near = lambda r, v, most=0.3: np.allclose([r["ci_low"], r["ci_high"]], np.percentile(v, [2.5, 97.5]), atol=most * np.std(v))
        assert near(metrics.bootstrap_spearman(df, ["model"], block=block).first(), rho)
        assert near(resampling.bootstrap(df, ["model"], F.col("gold"), block=block).first(), own[:, :, 0].mean(axis=1))
        assert near(resampling.bootstrap_of(df, ["model"], metrics.regression, "mae", block=block).first(), np.abs(own[:, :, 0] - own[:, :, 1]).mean(axis=1))
        assert near(resampling.bootstrap_of(df, ["model"], metrics.regression, "median_ae", block=block).first(), np.median(np.abs(own[:, :, 0] - own[:, :, 1]), axis=1), 1)  # steps of 0.1


def test_a_draw_costs_classes_not_rows(spark):
    df = spark.range(2_000_000).select(F.lit("m").alias("model"), (F.col("id") % 3 == 0).cast("int").alias("v"))
    drawn = resampling.resampled(df, ["model"], F.col("v"), draws=50)
    assert drawn.count() == 100 and "Generate explode" not in drawn.filter("m < 0")._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    got = resampling.bootstrap(df, ["model"], F.col("v")).first()
    sd = math.sqrt(2 / 9 / 2_000_000)
    assert abs((got["ci_low"] - 1 / 3) / sd + 1.96) < 0.25 and abs((got["ci_high"] - 1 / 3) / sd - 1.96) < 0.25


@pytest.mark.parametrize("bins", [2, 16, 1024])
def test_quantiles_by_selection(spark, bins):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(3000), np.zeros(2000), np.exp(40 * rng.standard_normal(1000)), np.full(700, 3.5)])
    g = rng.integers(0, 3, len(x))
    rows = [(None if i == 2 else int(i), float(v), float(-v * i)) for i, v in zip(g, x)] + [(9, 1.0, 2.0), (9, 3.0, None), (8, None, None)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(7)
    wanted = {"a": (F.col("x"), 0.5), "b": (F.col("x"), 0.975), "c": (F.col("y"), 0.01), "d": (F.abs("y"), 0.333)}
    got = {r["g"]: r for r in quantiles(df, ["g"], wanted, small=40, bins=bins).collect()}
    assert set(got) == {0, 1, None, 8, 9} and got[8]["a"] is None and got[9]["a"] == 2.0
    for i in (0, 1, 2):
        v = x[g == i]
        want = [np.percentile(v, 50), np.percentile(v, 97.5), np.percentile(-v * i, 1), np.percentile(np.abs(v * i), 33.3)]
        assert np.allclose([got[None if i == 2 else i][c] for c in "abcd"], want, rtol=1e-9, atol=1e-12)
    whole = quantiles(df, [], {"a": (F.col("x"), 0.25)}, small=40, bins=bins).collect()
    assert len(whole) == 1 and math.isclose(whole[0]["a"], np.percentile([r[1] for r in rows if r[1] is not None], 25), abs_tol=1e-12)
