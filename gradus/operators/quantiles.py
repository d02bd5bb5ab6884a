"""Exact quantiles of groups of any size, by selection instead of sorting.

A group of up to ``SMALL`` values is sorted in one buffer. A larger one is narrowed down: the values in reach of a wanted rank are
counted in ``BINS`` ranges of equal width, the range that holds the rank becomes the next reach, and so on until what is left is
small, or one value. Each pass is an aggregate with a partial step; what crosses the network is a number per range. Where equal widths
do not help, because most values lie close together, the next ranges are cut at approximate quantiles.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a group that one buffer may hold; ranges of a pass.
SMALL, BINS = 500_000, 1024


def together(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Two frames with one row per group, side by side; null keys meet."""
    if not by:
        return a.join(F.broadcast(b))  # one row each
    other = b.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in b.columns if c not in by])
    return a.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], how).drop(*[f"_{c}" for c in by])


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]], digits: int | None = None, small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(by, one column for each of ``wanted``): quantile ``share`` of a column's non-null values, linear between neighbours, in double."""
    columns = list({str(x): x for x, _ in wanted.values()}.values())
    at = {str(x): i for i, x in enumerate(columns)}
    rows = df.select(*by, *[x.cast("double").alias(f"_x{i}") for i, x in enumerate(columns)])
    sizes = rows.groupBy(*by).agg(*[F.count(f"_x{i}").alias(f"n{i}") for i in range(len(columns))], *[f(f"_x{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("lo", F.min), ("hi", F.max))])
    large = reduce(lambda a, b: a | b, [F.col(f"n{i}") > small for i in range(len(columns))])
    big = sizes.filter(large).collect()  # a row for each ``small`` rows of input at most
    named = lambda x, name: (x if digits is None else F.round(x, digits)).alias(name)
    plain = lambda frame: frame.groupBy(*by).agg(*[named(F.percentile(f"_x{at[str(x)]}", q), name) for name, (x, q) in wanted.items()])
    if not big:
        return plain(rows)
    spark = df.sparkSession
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in by]
    keys = spark.createDataFrame([(*[r[c] for c in by], g) for g, r in enumerate(big)], ", ".join([*kinds, "_g int"]))
    marked = [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in by] or [F.lit(True)]
    keyed = rows.join(F.broadcast(keys.select(*[F.col(c).alias(f"_k{c}") for c in by], "_g")), marked, "left").drop(*[f"_k{c}" for c in by])
    # State of a search: [group, column, rank, low, high, values below low, values from low to high].
    state: dict[tuple[int, int, int], list] = {}
    for g, r in enumerate(big):
        for x, q in wanted.values():
            i = at[str(x)]
            if (n := r[f"n{i}"]):
                for rank in {math.floor((n - 1) * q), math.ceil((n - 1) * q)}:
                    state[g, i, rank] = [r[f"lo{i}"], r[f"hi{i}"], 0, n]
    values = keyed.filter("_g IS NOT NULL").select("_g", F.posexplode(F.array(*[f"_x{i}" for i in range(len(columns))])).alias("_i", "_v")).filter("_v IS NOT NULL")
    even = True
    while open_ := {k: s for k, s in state.items() if s[0] < s[1] and s[3] > small}:
        spans = sorted({(k[0], k[1], s[0], s[1], s[2]) for k, s in open_.items()})
        table = spark.createDataFrame([(g, i, n, lo, hi) for n, (g, i, lo, hi, _) in enumerate(spans)], "_g int, _i int, _s int, _lo double, _hi double")
        met = values.join(F.broadcast(table), ["_g", "_i"]).filter("_v BETWEEN _lo AND _hi")
        if even:  # halves of the ends, as their difference may overflow
            place = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins).cast("int"))
        else:
            cut = met.groupBy("_s").agg(F.percentile_approx("_v", [k / 100 for k in range(1, 100)], 10_000).alias("_cuts"))
            met = met.join(F.broadcast(cut), "_s")
            place = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))  # a value that is a cut has a range of its own
        found: dict[int, list] = {}
        for r in met.groupBy("_s", place.alias("_b")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
            found.setdefault(r["_s"], []).append((r["_b"], r["n"], r["lo"], r["hi"]))
        shrunk = True
        for n, (g, i, lo, hi, below) in enumerate(spans):
            for key, s in open_.items():
                if (key[0], key[1], s[0], s[1]) == (g, i, lo, hi):
                    under, before = below, s[3]
                    for _, count, low, high in sorted(found[n]):
                        if key[2] < under + count:
                            state[key] = [low, high, under, count]
                            break
                        under += count
                    shrunk = shrunk and state[key][3] < before / 2
        even = shrunk if even else True
    left = [(g, i, rank, s[0], s[1], rank - s[2]) for (g, i, rank), s in state.items() if s[0] < s[1]]
    got = {k: s[0] for k, s in state.items() if s[0] == s[1]}
    if left:  # ``small`` values each at most
        table = spark.createDataFrame([(n, *x) for n, x in enumerate(left)], "_s int, _g int, _i int, _rank long, _lo double, _hi double, _place int")
        met = values.join(F.broadcast(table), ["_g", "_i"]).filter("_v BETWEEN _lo AND _hi")
        for r in met.groupBy("_s").agg(F.first("_place").alias("p"), F.sort_array(F.collect_list("_v")).alias("all")).select("_s", F.get("all", F.col("p")).alias("v")).collect():
            g, i, rank = left[r["_s"]][:3]
            got[g, i, rank] = r["v"]
    done = []
    for g, r in enumerate(big):
        line: list = [r[c] for c in by]
        for x, q in wanted.values():
            i = at[str(x)]
            n = r[f"n{i}"]
            place = (n - 1) * q
            a, b = (got[g, i, f(place)] for f in (math.floor, math.ceil)) if n else (None, None)
            line.append(None if a is None else a if a == b else a * (math.ceil(place) - place) + b * (place - math.floor(place)))
        done.append(tuple(line))
    exact = spark.createDataFrame(done, ", ".join([*kinds, *[f"{n} double" for n in wanted]]))
    exact = exact.select(*by, *[named(F.col(n), n) for n in wanted])
    return exact if not by else plain(keyed.filter("_g IS NULL")).unionByName(exact)
