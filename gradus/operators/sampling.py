"""Deterministic sampling: random order is the md5 of seed, stage and row key, so every engine and partitioning agrees."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def order_key(stage: str, key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), key.cast("string")).cast("binary"))


def ranked(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def cap_per_group(df: DataFrame, by: list[str], most: int, stage: str, key: str = "rid") -> DataFrame:
    """At most ``most`` random rows of each group."""
    return ranked(df, by, order_key(stage, F.col(key)), F.col(key)).filter(F.col("rn") <= most).drop("rn")


def first_per_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """First row per key in file order: a partial aggregate, so that a key with many rows is never sorted in one task."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), position).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def last_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Last write wins, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def bucket_ranked(df: DataFrame, by: str | list[str], stage: str, key: str) -> DataFrame:
    """:func:`ranked` in random order for groups of any size: rows are ranked inside buckets of the order key's first digits,
    after the counts of the buckets before. Only the counts, 4096 at most for a group, meet in one task."""
    by = [by] if isinstance(by, str) else by
    keyed = df.withColumn("_order", order_key(stage, F.col(key))).withColumn("_bucket", F.substring("_order", 1, 3))
    named = [f"_by{i}" for i in range(len(by))]
    up = Window.partitionBy(*named).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(*[F.col(c).alias(n) for c, n in zip(by, named)], F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = sizes.select(*named, "_b", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    inside = ranked(keyed, [*by, "_bucket"], F.col("_order"), F.col(key))
    same = F.col("_bucket") == F.col("_b")
    for c, n in zip(by, named):
        same = same & F.col(c).eqNullSafe(F.col(n))
    met = inside.join(before, same)
    return met.withColumn("rn", F.col("rn") + F.col("_before")).select(*df.columns, "rn")


def numbered(df: DataFrame, stage: str, key: str) -> DataFrame:
    """Adds rn, the place of every row of the whole table in random order, without sorting it in one task."""
    return bucket_ranked(df.withColumn("_all", F.lit(0)), ["_all"], stage, key).drop("_all")


def placed(df: DataFrame, key: str, per: int = 100_000) -> DataFrame:
    """Adds rn, the place of every row of the whole table in the order of ``key``: ranges of it are counted, then numbered one by one."""
    ranges = max(1, -(-df.count() // per))
    cuts = df.agg(F.percentile_approx(F.col(key).cast("double"), [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    place = F.size(F.filter(F.lit(sorted(set(cuts or []))).cast("array<double>"), lambda c: c <= F.col(key).cast("double"))) if cuts else F.lit(0)
    dealt = df.withColumn("_range", place)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    return ranked(dealt, ["_range"], F.col(key)).join(F.broadcast(before), "_range").withColumn("rn", F.col("rn") + F.col("_before")).select(*df.columns, "rn")


def settled(df: DataFrame) -> DataFrame:
    """``df`` without its history, in the session's ``spark.checkpoint.dir``; as it is where none is set."""
    sc = df.sparkSession.sparkContext
    at = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        return df
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return df.checkpoint()


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as Parquet in the session's ``spark.checkpoint.dir``, computed once, until the ``with`` ends; as it is where none is set."""
    spark = df.sparkSession
    at = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        yield df
        return
    path = f"{at}/kept-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def unique_names(df: DataFrame, name: str, suffix: Column, pos: str) -> DataFrame:
    """Adds unique_name: a name seen before, as given or as made, gets its row's suffix; two alike may come out of that.

    A row repeats a name if it is not the first with it, or if an earlier row's suffixed name equals it. The second kind can
    follow from itself, so that it is found in rounds, each over the first rows of their names alone and from what the last one left."""
    rows = df.withColumns({"_suffix": suffix, "_first": F.min(pos).over(Window.partitionBy(name))})
    made = rows.filter(F.col(pos) != F.col("_first")).select(F.concat(name, "_suffix").alias("_made"), F.col(pos).alias("_at"))
    firsts = rows.filter(F.col(pos) == F.col("_first")).select(F.col(name).alias("_name"), F.concat(name, "_suffix").alias("_next"), F.col(pos).alias("_pos"))
    seen = None
    while True:
        hit = settled(firsts.join(made, (F.col("_name") == F.col("_made")) & (F.col("_at") < F.col("_pos")), "left_semi"))
        if hit.isEmpty():
            break
        seen = hit.select("_pos") if seen is None else seen.unionByName(hit.select("_pos"))
        firsts = settled(firsts.join(hit.select("_pos"), "_pos", "left_anti"))
        made = hit.select(F.col("_next").alias("_made"), F.col("_pos").alias("_at"))
    again = F.col(pos) != F.col("_first")
    if seen is not None:
        rows = rows.join(seen.select(F.col("_pos").alias(pos), F.lit(True).alias("_again")).distinct(), pos, "left")
        again = again | F.coalesce("_again", F.lit(False))
    return rows.withColumn("unique_name", F.when(again, F.concat(name, "_suffix")).otherwise(F.col(name))).select(*df.columns, "unique_name")


def prefix_cuts(df: DataFrame, by: list[str], quota, stage: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their order key and its prefix, and for each group the prefix that holds the rank ``quota`` and how many rows of
    that prefix are within it: what lies before needs no rank, what lies behind none either.

    ``quota(sizes)`` adds the column quota to the (by, n) sizes of the groups. Counts per prefix, 4096 at most for a group, come
    from one aggregate."""
    keyed = df.withColumn("_order", order_key(stage, F.col(key))).withColumn("_bucket", F.substring("_order", 1, 3))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    wanted = quota(counts.groupBy(*by).agg(F.sum("_n").alias("n")))
    named = [f"_by{i}" for i in range(len(by))]
    other = wanted.select(*[F.col(c).alias(n) for c, n in zip(by, named)], "quota")
    met = counts.join(other, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, named)]) if by else counts.join(F.broadcast(other))  # one row
    up = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    steps = met.withColumn("_to", F.sum("_n").over(up)).filter(F.col("_to") >= F.col("quota"))
    cut = F.min(F.struct("_bucket", (F.col("quota") - F.col("_to") + F.col("_n")).alias("rest")))
    ends = steps.groupBy(*by).agg(cut.alias("_cut"))
    return keyed, ends.select(*[F.col(c).alias(n) for c, n in zip(by, named)], F.col("_cut._bucket").alias("_end"), F.col("_cut.rest").alias("_rest"))


#: Most groups whose ends are broadcast.
MOST_ENDS = 100_000


def _meeting(keyed: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the end of their group: a group of any size stays where it lies, unless there are very many groups."""
    named = [f"_by{i}" for i in range(len(by))]
    ends = settled(ends)
    if by and ends.count() <= MOST_ENDS:
        ends = F.broadcast(ends)
    met = keyed.join(ends, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, named)], "left") if by else keyed.join(F.broadcast(ends), how="left")
    return met.drop(*named)


def within_quota(df: DataFrame, by: list[str], quota, stage: str, key: str = "rid") -> DataFrame:
    """The first ``quota`` rows of each group in random order; a group with fewer gives all. See :func:`prefix_cuts`.

    Only rows whose prefix may hold them are ranked, and these inside their prefix."""
    keyed, ends = prefix_cuts(df, by, quota, stage, key)
    near = _meeting(keyed, ends, by).filter(F.col("_end").isNull() | (F.col("_bucket") <= F.col("_end")))
    inside = ranked(near, [*by, "_bucket"], F.col("_order"), F.col(key))
    return inside.filter(F.col("_end").isNull() | (F.col("_bucket") < F.col("_end")) | (F.col("rn") <= F.col("_rest"))).select(*df.columns)


def equalize(df: DataFrame, label: str, stage: str, key: str = "rid") -> DataFrame:
    """Every class cut to the size of the smallest."""
    smallest = lambda sizes: sizes.join(F.broadcast(sizes.agg(F.min("n").alias("quota"))))  # noqa: E731  one row
    return within_quota(df, [label], smallest, stage, key)


def fill_to_target(chosen: DataFrame, pool: DataFrame, target: int, stage: str, key: str = "rid") -> DataFrame:
    """Tops ``chosen`` up to ``target`` rows from what is left of the pool."""
    left = pool.join(chosen.select(key), key, "left_anti")
    missing = chosen.agg((F.lit(target) - F.count("*")).alias("missing"))
    best = left.orderBy(order_key(stage, F.col(key)), key).limit(target)
    r = best.withColumn("rn", F.row_number().over(Window.orderBy(order_key(stage, F.col(key)), key)))  # at most ``target`` rows
    return chosen.unionByName(r.join(F.broadcast(missing)).filter("rn <= missing").select(*chosen.columns))


def half_partition(df: DataFrame, label: str, stage: str, key: str = "rid") -> DataFrame:
    """Adds half: 0 for the first floor(n / 2) rows of each class in random order, else 1. Only the rows of the prefix that holds the
    middle are ranked."""
    keyed, ends = prefix_cuts(df, [label], lambda sizes: sizes.withColumn("quota", F.floor(F.col("n") / 2)), stage, key)
    met = _meeting(keyed, ends, [label])
    sure = met.filter(F.col("_bucket") != F.col("_end")).withColumn("half", (F.col("_bucket") > F.col("_end")).cast("int"))
    edge = ranked(met.filter(F.col("_bucket") == F.col("_end")), [label, "_bucket"], F.col("_order"), F.col(key)).withColumn("half", (F.col("rn") > F.col("_rest")).cast("int"))
    return sure.select(*df.columns, "half").unionByName(edge.select(*df.columns, "half"))


def proportional_cap(df: DataFrame, strata: str, target: int, stage: str, key: str) -> DataFrame:
    """About ``target`` rows with each stratum in its share; a stratum never gives more than it has."""

    def shares(sizes: DataFrame) -> DataFrame:
        total = sizes.agg(F.sum("n").alias("total"))
        return sizes.join(F.broadcast(total)).withColumn("quota", F.least(F.bround(F.lit(float(target)) * F.col("n") / F.col("total")), F.col("n")))  # one row

    return within_quota(df, [strata], shares, stage, key)


def tissue_balanced(df: DataFrame, target: int, stage: str, organ: str = "organ", label: str = "direction", key: str = "rid") -> DataFrame:
    """Equal share per label; within a label equal shares per organ, shortfalls passed on to organs with rows to spare, in order."""

    def shares(counts: DataFrame) -> DataFrame:
        dims = counts.agg(F.countDistinct(label).alias("nl"), F.countDistinct(organ).alias("no"))
        share = F.floor(F.floor(F.lit(target) / F.col("nl")) / F.col("no"))
        q = counts.join(F.broadcast(dims)).select(label, organ, "n", F.floor(F.lit(target) / F.col("nl")).alias("each"), F.least("n", share).alias("base"))
        per = Window.partitionBy(label)
        q = q.withColumn("spare", F.col("n") - F.col("base")).withColumn("need", F.col("each") - F.sum("base").over(per))
        before = F.coalesce(F.sum("spare").over(per.orderBy(organ).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return q.withColumn("quota", F.col("base") + F.greatest(F.lit(0), F.least("spare", F.col("need") - before)))

    return within_quota(df, [label, organ], shares, stage, key)


def pair_extremes(df: DataFrame, by: str, gap: float, most: int, key: str = "rid") -> DataFrame:
    """i-th largest with i-th smallest |logfc| of a group, where they differ by ``gap`` at least; the first ``most`` pairs."""
    size = F.abs(F.col("logfc"))
    per = Window.partitionBy(by)
    r = df.withColumns({"up": F.row_number().over(per.orderBy(size.desc(), F.col(key))), "down": F.row_number().over(per.orderBy(size, F.col(key).desc())), "n": F.count("*").over(per)})
    big = r.filter(F.col("up") <= F.floor(F.col("n") / 2)).select(by, F.col("up").alias("i"), F.col(key).alias("large"), size.alias("a"))
    small = r.filter(F.col("down") <= F.floor(F.col("n") / 2)).select(by, F.col("down").alias("i"), F.col(key).alias("small"), size.alias("b"))
    pairs = big.join(small, [by, "i"]).filter(F.col("a") - F.col("b") >= gap)
    return ranked(pairs, [by], F.col("i")).filter(F.col("rn") <= most).select(by, "large", "small", F.col("rn").alias("pair"))


def tissue_balanced_pairs(pairs: DataFrame, target: int, stage: str, organ: str = "organ", key: str = "pair") -> DataFrame:
    """About ``target`` random pairs in equal shares per organ; what is missing comes from organs with pairs to spare, the largest first."""

    def shares(counts: DataFrame) -> DataFrame:
        every = Window.partitionBy()  # a row per organ
        q = counts.withColumn("base", F.least("n", F.floor(F.lit(target) / F.count("*").over(every))))
        q = q.withColumn("spare", F.col("n") - F.col("base")).withColumn("need", F.lit(target) - F.sum("base").over(every))
        before = F.coalesce(F.sum("spare").over(Window.orderBy(F.desc("n"), organ).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return q.withColumn("quota", F.col("base") + F.greatest(F.lit(0), F.least("spare", F.col("need") - before)))

    return within_quota(pairs, [organ], shares, stage, key)
