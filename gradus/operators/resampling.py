"""Bootstrap from counts: a resample is how often each class of equal values is drawn, not which rows.

n draws with replacement from n rows give the classes a multinomial count. It is drawn class by class: the next class takes a
binomial share of the draws that are left, the inverse of the binomial distribution function at a hash of (seed, draw, place of the
class). A draw thus costs the number of classes, whatever the number of rows, and any engine can draw the same.

Groups with more than ``BLOCK`` classes are dealt into blocks of about as many: the blocks' totals are drawn first, in the same way, then the classes
inside each block, block by block and chunk by chunk of draws in parallel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

DRAWS, SEED = 1000, 42
#: Classes of a block, draws of a chunk, cells of a table of probabilities.
BLOCK, CHUNK, CELLS = 4096, 125, 4_000_000


def binomial_quantile(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """For each u the least k whose binomial distribution function reaches it.

    Probabilities come from ratios of neighbours within ten deviations and more of the mean, where all but 1e-20 of them lie, so
    that nothing underflows at any n."""
    n = np.asarray(n, np.int64)
    if p <= 0:
        return np.zeros(len(n), np.int64)
    if p >= 1:
        return n.copy()
    reach = np.ceil(10 * np.sqrt(n * p * (1 - p)) + 30).astype(np.int64)
    first = np.maximum(0, np.floor((n + 1) * p).astype(np.int64) - reach)
    out = np.empty(len(n), np.int64)
    step = max(1, CELLS // int(2 * reach.max(initial=0) + 2))
    odds = np.log(p) - np.log1p(-p)
    for a in range(0, len(n), step):
        some = slice(a, a + step)
        k = first[some, None] + np.arange(2 * int(reach[some].max()) + 2)[None, :]
        left = np.maximum(n[some, None] - k, 0)
        with np.errstate(divide="ignore"):
            up = np.log(left) - np.log(k + 1) + odds  # from k to k + 1; minus infinity at k = n
        log = np.cumsum(np.concatenate([np.zeros((len(k), 1)), up[:, :-1]], axis=1), axis=1)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        reached = np.cumsum(weight, axis=1)
        out[some] = first[some] + (reached / reached[:, -1:] < u[some, None]).sum(axis=1)
    return np.minimum(out, n)


def uniforms(prefix: str, draws: np.ndarray, place: int) -> np.ndarray:
    """Numbers between 0 and 1 from the first 32 bits of md5('prefix|draw|place')."""
    h = [int.from_bytes(hashlib.md5(f"{prefix}|{d}|{place}".encode()).digest()[:4], "big") for d in draws.tolist()]
    return (np.array(h, np.float64) + 0.5) / 4294967296.0


def multiplicities(counts: np.ndarray, totals: np.ndarray, draws: np.ndarray, prefix: str) -> np.ndarray:
    """(classes x draws): how often each draw of ``totals`` picks falls on each class."""
    out = np.zeros((len(counts), len(draws)), np.int64)
    left, rest = totals.astype(np.int64), int(counts.sum())
    for j, k in enumerate(counts.tolist()):
        out[j] = left if k == rest else binomial_quantile(uniforms(prefix, draws, j), left, k / rest)
        left, rest = left - out[j], rest - k
    return out


def resampled(df: DataFrame, by: list[str], value: Column, draws: int = DRAWS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(by, d, v, m): in draw d the value v occurs m times, m > 0; as many values in all as the group has rows."""
    names = [f"_by{i}" for i in range(len(by))]
    classes = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], value.alias("v")).groupBy(*names, "v").agg(F.count("*").alias("k"))
    chunks = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-draws // CHUNK) - 1)))).alias("chunk")
    sizes = classes.groupBy(*names).agg(F.sum("k").alias("n"), F.count("*").alias("c"))
    kinds = [StructField(c, classes.schema[c].dataType) for c in names]
    many = (sizes.agg(F.max("c")).first()[0] or 0) > block

    def expanded(t: pa.Table, m: np.ndarray, d: np.ndarray) -> pa.Table:
        j, i = np.nonzero(m)
        return pa.table([*[t.column(c).take(pa.array(j)) for c in names], pa.array(d[i], pa.int32()), t.column("v").take(pa.array(j)), pa.array(m[j, i])], [*names, "d", "v", "m"])

    def chunk_of(t: pa.Table) -> np.ndarray:
        a = t.column("chunk")[0].as_py() * CHUNK
        return np.arange(a, min(draws, a + CHUNK))

    out = StructType([*kinds, StructField("d", IntegerType()), StructField("v", classes.schema["v"].dataType), StructField("m", LongType())])
    if not many:
        placed = classes.withColumn("j", F.row_number().over(Window.partitionBy(*names).orderBy("v")))  # ``block`` classes at most

        def whole(t: pa.Table) -> pa.Table:
            t = t.sort_by("j")
            d, k = chunk_of(t), t.column("k").to_numpy()
            return expanded(t, multiplicities(k, np.full(len(d), k.sum()), d, str(seed)), d)

        got = placed.select("*", chunks).groupBy(*names, "chunk").applyInArrow(whole, out)
    else:
        deal = sizes.select(*[F.col(c).alias(f"{c}_") for c in names], F.ceil(F.col("c") / block).alias("blocks"))
        met = classes.join(deal, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names]) if names else classes.join(F.broadcast(deal))  # one row
        dealt = met.withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).select(*names, "b", "v", "k")
        totals = dealt.groupBy(*names, "b").agg(F.sum("k").alias("k"))

        def blocks(t: pa.Table) -> pa.Table:
            t = t.sort_by("b")
            d, k = chunk_of(t), t.column("k").to_numpy()
            m = multiplicities(k, np.full(len(d), k.sum()), d, f"{seed}|block")
            return pa.table([*[t.column(c) for c in names], t.column("b"), t.column("chunk"), pa.array(m.tolist(), pa.list_(pa.int64()))], [*names, "b", "chunk", "totals"])

        drawn = totals.select("*", chunks).groupBy(*names, "chunk").applyInArrow(blocks, StructType([*kinds, StructField("b", IntegerType()), StructField("chunk", IntegerType()), StructField("totals", ArrayType(LongType()))]))
        placed = dealt.withColumn("j", F.row_number().over(Window.partitionBy(*names, "b").orderBy("v"))).select("*", chunks)
        keys = [*names, "b", "chunk"]

        def inside(t: pa.Table, total: pa.Table) -> pa.Table:
            t = t.sort_by("j")
            d = chunk_of(t)
            return expanded(t, multiplicities(t.column("k").to_numpy(), np.array(total.column("totals")[0].as_py(), np.int64), d, f"{seed}|{t.column('b')[0].as_py()}"), d)

        got = placed.groupBy(*keys).cogroup(drawn.groupBy(*keys)).applyInArrow(inside, out)
    return got.select(*[F.col(n).alias(c) for c, n in zip(by, names)], "d", "v", "m")


def interval(values: DataFrame, by: list[str], column: str, digits: int = 6) -> DataFrame:
    """(by, ci_low, ci_high): 2.5 and 97.5 percent points over the draws; null and NaN values are left out."""
    good = values.filter(F.col(column).isNotNull() & ~F.isnan(column))
    return good.groupBy(*by).agg(F.round(F.percentile(column, 0.025), digits).alias("ci_low"), F.round(F.percentile(column, 0.975), digits).alias("ci_high"))


def bootstrap(df: DataFrame, by: list[str], value: Column, draws: int = DRAWS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Percentile interval of the mean of ``value`` over resamples with replacement; null values do not count into a mean."""
    drawn = resampled(df, by, value, draws, seed, block).filter("v IS NOT NULL")
    return interval(drawn.groupBy(*by, "d").agg((F.sum(F.col("v") * F.col("m")) / F.sum("m")).alias("mean")), by, "mean")


def bootstrap_of(df: DataFrame, by: list[str], metric, column: str, draws: int = DRAWS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Percentile interval of a metric of (gold, pred) pairs: ``metric(frame, by, weight)`` gives ``column``, null or NaN where a draw fails."""
    pairs = resampled(df, by, F.struct("gold", "pred"), draws, seed, block).select(*by, "d", "v.gold", "v.pred", "m")
    return interval(metric(pairs, [*by, "d"], "m"), by, column)
