"""Sampling, balancing, pairing and baseline predictors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators import sampling
from gradus.operators.metrics import uniform
from gradus.plans.catalogue import query
from gradus.plans.core import DIRECTION, KEPT, labelled
from gradus.plans.views import Views

L = f"l AS (SELECT *, {DIRECTION} AS direction FROM dx WHERE {KEPT})"


def h(stage: str, key: str = "rid") -> str:
    return f"md5(concat_ws('|', '42', '{stage}', {key})), {key}"


@query(f"WITH {L} SELECT rid FROM l QUALIFY row_number() OVER (PARTITION BY direction, gene ORDER BY {h('gene')}) <= 3")
def cap_per_gene(v: Views) -> DataFrame:
    return sampling.cap_per_group(labelled(v), ["direction", "gene"], 3, "gene").select("rid")


CAPPED = f"""{L}, g AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY direction, gene ORDER BY {h('gene')}) <= 3),
c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY direction, comparison ORDER BY {h('comparison')}) <= 5)"""


def capped(v: Views) -> DataFrame:
    return sampling.cap_per_group(sampling.cap_per_group(labelled(v), ["direction", "gene"], 3, "gene"), ["direction", "comparison"], 5, "comparison")


@query(f"WITH {CAPPED} SELECT rid, direction FROM c")
def cap_gene_then_comparison(v: Views) -> DataFrame:
    return capped(v).select("rid", "direction")


@query(f"""WITH {CAPPED}, n AS (SELECT min(k) AS most FROM (SELECT count(*) AS k FROM c GROUP BY direction))
SELECT rid, direction FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY {h('class')}) AS rn FROM c), n WHERE rn <= most""")
def balanced_subsample(v: Views) -> DataFrame:
    return sampling.equalize(capped(v), "direction", "class").select("rid", "direction")


@query(f"WITH {L} SELECT rid, direction, CAST(row_number() OVER (PARTITION BY direction ORDER BY p, abs(logfc) DESC, rid) AS INTEGER) AS rn FROM l WHERE abs(logfc) <= 10 AND direction <> 'no_change' QUALIFY rn <= 300")
def topk_significant(v: Views) -> DataFrame:
    pool = labelled(v).filter((F.abs("logfc") <= 10) & (F.col("direction") != "no_change"))
    return sampling.ranked(pool, ["direction"], F.col("p").asc_nulls_last(), F.abs("logfc").desc_nulls_last(), F.col("rid")).filter("rn <= 300").select("rid", "direction", "rn")


@query(f"WITH {L} SELECT rid FROM l WHERE direction = 'no_change' ORDER BY abs(logfc), p DESC, rid LIMIT 300")
def topk_unchanged(v: Views) -> DataFrame:
    pool = labelled(v).filter("direction = 'no_change'")
    return pool.orderBy(F.abs("logfc").asc_nulls_last(), F.col("p").desc_nulls_last(), "rid").limit(300).select("rid")


@query(f"""WITH {L}, r AS (SELECT comparison, rid, abs(logfc) AS a, row_number() OVER (PARTITION BY comparison ORDER BY abs(logfc) DESC, rid) AS up, row_number() OVER (PARTITION BY comparison ORDER BY abs(logfc), rid DESC) AS down,
count(*) OVER (PARTITION BY comparison) AS n FROM l),
p AS (SELECT x.comparison, x.rid AS large, y.rid AS small, x.up AS i FROM r x JOIN r y ON x.comparison = y.comparison AND x.up = y.down WHERE x.up <= x.n // 2 AND y.down <= y.n // 2 AND x.a - y.a >= 0.5)
SELECT comparison, large, small, CAST(row_number() OVER (PARTITION BY comparison ORDER BY i) AS INTEGER) AS pair, ('0x' || substr(md5(concat_ws('|', '42', 'swap', large)), 1, 8))::BIGINT % 2 AS swapped FROM p QUALIFY pair <= 3""")
def pairwise_pairs(v: Views) -> DataFrame:
    pairs = sampling.pair_extremes(labelled(v), "comparison", 0.5, 3)
    return pairs.withColumn("swapped", uniform(F.concat_ws("|", F.lit("42"), F.lit("swap"), "large"), F.lit(2)))


@query(f"WITH {L} SELECT rid, direction FROM l QUALIFY row_number() OVER (PARTITION BY direction ORDER BY {h('strata')}) <= 30")
def stratified_sample(v: Views) -> DataFrame:
    return sampling.cap_per_group(labelled(v), ["direction"], 30, "strata").select("rid", "direction")


FILL = f"""{L}, c AS (SELECT rid FROM l QUALIFY row_number() OVER (PARTITION BY direction ORDER BY {h('strata')}) <= 30),
m AS (SELECT rid, row_number() OVER (ORDER BY {h('fill')}) AS rn FROM l WHERE rid NOT IN (SELECT rid FROM c))"""


@query(f"WITH {FILL} SELECT rid FROM c UNION ALL SELECT rid FROM m WHERE rn <= 120 - (SELECT count(*) FROM c)")
def fill_to_target(v: Views) -> DataFrame:
    pool = labelled(v).select("rid", "direction")
    chosen = sampling.cap_per_group(pool, ["direction"], 30, "strata")
    return sampling.fill_to_target(chosen, pool, 120, "fill").select("rid")


@query(f"""WITH {L}, n AS (SELECT direction, organ, count(*) AS n FROM l GROUP BY ALL), d AS (SELECT count(DISTINCT direction) AS nl, count(DISTINCT organ) AS no FROM n),
b AS (SELECT direction, organ, n, 2000 // nl AS each, least(n, (2000 // nl) // no) AS base FROM n, d), s AS (SELECT *, n - base AS spare, each - sum(base) OVER (PARTITION BY direction) AS need FROM b),
q AS (SELECT direction, organ, base + greatest(0, least(spare, need - coalesce(sum(spare) OVER (PARTITION BY direction ORDER BY organ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM s)
SELECT rid, direction, organ FROM (SELECT *, row_number() OVER (PARTITION BY direction, organ ORDER BY {h('tissue')}) AS rn FROM l) JOIN q USING (direction, organ) WHERE rn <= quota""")
def tissue_balanced_sample(v: Views) -> DataFrame:
    return sampling.tissue_balanced(labelled(v), 2000, "tissue").select("rid", "direction", "organ")


@query(f"""WITH n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), q AS (SELECT c_mktsegment, least(round_even(200.0::DOUBLE * n / (SELECT sum(n) FROM n), 0), n) AS quota FROM n)
SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {h('share', 'c_custkey')}) AS rn FROM customer) JOIN q USING (c_mktsegment) WHERE rn <= quota""")
def proportional_undersample(v: Views) -> DataFrame:
    return sampling.proportional_cap(v.table("customer"), "c_mktsegment", 200, "share", "c_custkey").select("c_custkey", "c_mktsegment")


@query(f"WITH {L} SELECT rid, direction, CASE WHEN row_number() OVER (PARTITION BY direction ORDER BY {h('half')}) <= count(*) OVER (PARTITION BY direction) // 2 THEN 0 ELSE 1 END AS half FROM l")
def half_partition(v: Views) -> DataFrame:
    return sampling.half_partition(labelled(v), "direction", "half").select("rid", "direction", "half")


@query("SELECT p_partkey, CASE WHEN row_number() OVER w = 1 THEN p_name ELSE p_name || '_' || (row_number() OVER w - 1) END AS unique_name FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def dup_name_suffix(v: Views) -> DataFrame:
    r = sampling.ranked(v.table("part"), ["p_name"], F.col("p_partkey"))
    return r.select("p_partkey", F.when(F.col("rn") == 1, F.col("p_name")).otherwise(F.concat_ws("_", "p_name", (F.col("rn") - 1).cast("string"))).alias("unique_name"))


@query("""WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), s AS (SELECT p_brand, n, sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(n) OVER ()::DOUBLE AS share FROM n)
SELECT p_brand, n, round(share, 6) AS share FROM s""")
def cumulative_share(v: Views) -> DataFrame:
    n = v.table("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    up = Window.orderBy(F.desc("n"), "p_brand").rowsBetween(Window.unboundedPreceding, 0)  # a row per brand
    return n.select("p_brand", "n", F.round(F.sum("n").over(up) / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("""WITH c AS (SELECT task, gold, count(*) AS n, min(id) AS pos FROM ev GROUP BY ALL), m AS (SELECT task, gold AS pred FROM c QUALIFY row_number() OVER (PARTITION BY task ORDER BY n DESC, pos) = 1)
SELECT ev.task, m.pred, count(*) AS n, round(avg((ev.gold = m.pred)::INT), 6) AS accuracy FROM ev JOIN m USING (task) GROUP BY ALL""")
def majority_label(v: Views) -> DataFrame:
    c = v.ev.groupBy("task", "gold").agg(F.count("*").alias("n"), F.min("id").alias("pos"))
    major = sampling.ranked(c, ["task"], F.desc("n"), F.col("pos")).filter("rn = 1").select("task", F.col("gold").alias("majority"))
    both = v.ev.join(F.broadcast(major), "task")  # one row per task
    return both.groupBy("task", F.col("majority").alias("pred")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("gold") == F.col("majority")).cast("int")), 6).alias("accuracy"))


@query("""SELECT id, (['A', 'B', 'C'])[CAST(('0x' || substr(md5(concat_ws('|', '42', 'random', id)), 1, 8))::BIGINT % 3 AS INTEGER) + 1] AS pred FROM ev""")
def random_baseline(v: Views) -> DataFrame:
    pick = uniform(F.concat_ws("|", F.lit("42"), F.lit("random"), "id"), F.lit(3))
    return v.ev.select("id", F.element_at(F.array(*map(F.lit, "ABC")), pick.cast("int") + 1).alias("pred"))


PRIOR = """w AS (SELECT p_size AS age, count(*) AS w FROM part GROUP BY 1), c AS (SELECT age, sum(w) OVER (ORDER BY age) AS hi, sum(w) OVER (ORDER BY age) - w AS lo FROM w),
u AS (SELECT c_custkey, ('0x' || substr(md5(concat_ws('|', '42', 'prior', c_custkey)), 1, 8))::BIGINT % (SELECT sum(w) FROM w)::BIGINT AS u FROM customer)"""


@query(f"WITH {PRIOR} SELECT c_custkey, age FROM u JOIN c ON u >= lo AND u < hi")
def population_prior_draw(v: Views) -> DataFrame:
    w = v.table("part").groupBy(F.col("p_size").alias("age")).agg(F.count("*").alias("w"))
    up = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)  # a row per age
    steps = w.withColumn("hi", F.sum("w").over(up)).withColumn("lo", F.col("hi") - F.col("w"))
    table = steps.agg(F.sort_array(F.collect_list(F.struct("lo", "age"))).alias("steps"), F.max("hi").alias("total"))
    drawn = v.table("customer").select("c_custkey").join(F.broadcast(table))  # one row with a step per age
    u = uniform(F.concat_ws("|", F.lit("42"), F.lit("prior"), "c_custkey"), F.col("total"))
    return drawn.withColumn("u", u).select("c_custkey", F.element_at(F.filter("steps", lambda s: s.lo <= F.col("u")), -1).age.alias("age"))


@query("SELECT model, coalesce(CAST(trunc(min(gold)) AS INTEGER), 20) AS lo, coalesce(CAST(trunc(max(gold)) AS INTEGER), 90) AS hi FROM evr GROUP BY model")
def regression_range(v: Views) -> DataFrame:
    return v.evr.groupBy("model").agg(F.coalesce(F.min("gold").cast("int"), F.lit(20)).alias("lo"), F.coalesce(F.max("gold").cast("int"), F.lit(90)).alias("hi"))


@query("SELECT model, CAST(CAST(round_even(avg(gold), 0) AS BIGINT) AS VARCHAR) AS answer FROM evr GROUP BY model")
def majority_mean(v: Views) -> DataFrame:
    return v.evr.groupBy("model").agg(F.bround(F.avg("gold")).cast("long").cast("string").alias("answer"))


@query("SELECT printf('LB-SEN-%04d', row_number() OVER (ORDER BY md5(concat_ws('|', '42', 'ids', item_id)), item_id)) AS lb_id, item_id FROM benchmark")
def sequential_ids(v: Views) -> DataFrame:
    return sampling.numbered(v.table("benchmark"), "ids", "item_id").select(F.format_string("LB-SEN-%04d", F.col("rn").cast("int")).alias("lb_id"), "item_id")
