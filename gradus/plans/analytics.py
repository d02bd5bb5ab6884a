"""Crosstabs, quantiles, correlations, intervals, leaderboards and the sample by model matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.operators import metrics, resampling, sampling
from gradus.operators.quantiles import quantiles, together
from gradus.plans.catalogue import query
from gradus.plans.core import DIRECTION, KEPT, labelled
from gradus.plans.views import Views

L = f"l AS (SELECT *, {DIRECTION} AS direction FROM dx WHERE {KEPT})"


@query(f"WITH {L} SELECT coalesce(CAST(organ AS VARCHAR), 'all') AS organ, coalesce(direction, 'all') AS direction, count(*) AS n FROM l GROUP BY CUBE (l.organ, l.direction)")
def crosstab_cube(v: Views) -> DataFrame:
    total = labelled(v).cube("organ", "direction").agg(F.count("*").alias("n"))
    return total.select(F.coalesce(F.col("organ").cast("string"), F.lit("all")).alias("organ"), F.coalesce("direction", F.lit("all")).alias("direction"), "n")


@query(f"""WITH {L} SELECT gene, count(*) AS n, count(*) FILTER (direction = 'upregulated') AS n_up, count(*) FILTER (direction = 'downregulated') AS n_down, count(*) FILTER (direction = 'no_change') AS n_nc,
count(DISTINCT comparison) AS comparisons FROM l GROUP BY gene ORDER BY n DESC, gene LIMIT 20""")
def conditional_topn(v: Views) -> DataFrame:
    is_ = lambda d: F.count_if(F.col("direction") == d)
    return labelled(v).groupBy("gene").agg(F.count("*").alias("n"), is_("upregulated").alias("n_up"), is_("downregulated").alias("n_down"), is_("no_change").alias("n_nc"), F.countDistinct("comparison").alias("comparisons")).orderBy(F.desc("n"), "gene").limit(20)


@query(f"WITH {L}, g AS (SELECT comparison, count(*) AS n FROM l GROUP BY 1) SELECT quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, min(n) AS lo, max(n) AS hi FROM g")
def group_size_quantiles(v: Views) -> DataFrame:
    g = labelled(v).groupBy("comparison").agg(F.count("*").alias("n"))
    ends = g.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return together(quantiles(g, [], {f"q{int(q * 100)}": (F.col("n"), q) for q in (0.25, 0.5, 0.75)}), ends, [])


@query(f"WITH {L} SELECT direction, round(avg(logfc), 6) AS mean, round(quantile_cont(logfc, 0.5), 6) AS median, round(min(logfc), 6) AS lo, round(max(logfc), 6) AS hi, round(avg(abs(logfc)), 6) AS mean_size, round(quantile_cont(abs(logfc), 0.5), 6) AS median_size, round(min(abs(logfc)), 6) AS lo_size, round(max(abs(logfc)), 6) AS hi_size FROM l GROUP BY direction")
def describe_by_label(v: Views) -> DataFrame:
    r, x, size = lambda c: F.round(c, 6), F.col("logfc"), F.abs("logfc")
    rows = labelled(v).select("direction", "logfc")
    sums = rows.groupBy("direction").agg(*[r(f(c)).alias(f"{name}{end}") for c, end in ((x, ""), (size, "_size")) for f, name in ((F.avg, "mean"), (F.min, "lo"), (F.max, "hi"))])
    return together(sums, quantiles(rows, ["direction"], {"median": (x, 0.5), "median_size": (size, 0.5)}, 6), ["direction"])


@query(f"""WITH {L} SELECT gene, organ, coalesce(treatment, '__NA__') AS treatment, count(*) AS n, array_to_string(list_sort(list(DISTINCT direction)), ',') AS labels FROM l
GROUP BY ALL HAVING count(DISTINCT direction) > 1""")
def contradictions(v: Views) -> DataFrame:
    g = labelled(v).groupBy("gene", "organ", F.coalesce("treatment", F.lit("__NA__")).alias("treatment")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("direction")).alias("s"))
    return g.filter(F.size("s") > 1).select("gene", "organ", "treatment", "n", F.array_join("s", ",").alias("labels"))


@query("SELECT count(*) AS n, count(*) - count(text) AS text_nulls, count(*) - count(lang) AS lang_nulls, count(*) - count(source) AS source_nulls, count(*) - count(n_chars) AS n_chars_nulls FROM documents")
def null_counts(v: Views) -> DataFrame:
    return v.table("documents").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in ("text", "lang", "source", "n_chars")])


@query("SELECT model, gold, count(*) AS n, count(DISTINCT format) AS formats FROM evb GROUP BY ALL")
def dataset_summary(v: Views) -> DataFrame:
    return v.evb.groupBy("model", "gold").agg(F.count("*").alias("n"), F.countDistinct("format").alias("formats"))


@query(f"WITH {L} SELECT direction, count(*) AS n, count(*) FILTER (acc % 5 = 0) AS n_test, count(*) FILTER (acc % 5 <> 0) AS n_train, round(avg((acc % 5 = 0)::INT), 4) AS test_fraction, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS target FROM l GROUP BY direction")
def split_report(v: Views) -> DataFrame:
    t = F.col("acc") % 5 == 0
    return labelled(v).groupBy("direction").agg(F.count("*").alias("n"), F.count_if(t).alias("n_test"), F.count_if(~t).alias("n_train"), F.round(F.avg(t.cast("int")), 4).alias("test_fraction"), F.bround(F.count("*") * 0.2).cast("long").alias("target"))


@query(f"WITH {L} SELECT gene FROM l WHERE acc % 5 = 0 INTERSECT SELECT gene FROM l WHERE acc % 5 <> 0")
def leakage_intersect(v: Views) -> DataFrame:
    x = labelled(v)
    return x.filter("acc % 5 = 0").select("gene").intersect(x.filter("acc % 5 <> 0").select("gene"))


@query(f"WITH {L} SELECT gene FROM l WHERE acc % 5 <> 0 EXCEPT SELECT gene FROM l WHERE acc % 5 = 0")
def leakage_except(v: Views) -> DataFrame:
    x = labelled(v)
    return x.filter("acc % 5 <> 0").select("gene").subtract(x.filter("acc % 5 = 0").select("gene"))


@query("""WITH s AS (SELECT sample, list_sort(list(DISTINCT fmt)) AS f FROM cells GROUP BY sample)
SELECT count(*) FILTER (list_contains(f, 0) AND list_contains(f, 1)) AS f01, count(*) FILTER (list_contains(f, 1) AND list_contains(f, 2)) AS f12, count(*) FILTER (list_contains(f, 0) AND list_contains(f, 1) AND list_contains(f, 2)) AS f012 FROM s""")
def cross_task_overlap(v: Views) -> DataFrame:
    s = v.cells.groupBy("sample").agg(F.collect_set("fmt").alias("f"))
    has = lambda *k: F.count_if(F.size(F.array_intersect("f", F.array(*[F.lit(x).cast("long") for x in k]))) == len(k))
    return s.agg(has(0, 1).alias("f01"), has(1, 2).alias("f12"), has(0, 1, 2).alias("f012"))


@query("""WITH r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY gold) + (count(*) OVER (PARTITION BY model, gold) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0::DOUBLE AS b FROM evr)
SELECT model, count(*) AS n, round(CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) ELSE 0 END, 6) AS rho FROM r GROUP BY model""")
def spearman_by_model(v: Views) -> DataFrame:
    return metrics.spearman(v.evr, ["model"])


def drawn_sql(src: str, value: str, by: str = "model", draws: int = 1000) -> str:
    """CTEs up to ``w``: for each group and draw, how often every class of equal values occurs, m, by inverse binomials in the order of the classes."""
    return f"""WITH RECURSIVE k AS (SELECT {by}, {value} AS v, count(*) AS k FROM {src} GROUP BY ALL),
c AS MATERIALIZED (SELECT {by}, v, k, CAST(row_number() OVER (PARTITION BY {by} ORDER BY v) - 1 AS BIGINT) AS j, CAST(sum(k) OVER (PARTITION BY {by} ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM k),
w AS (SELECT {by}, CAST(d AS BIGINT) AS d, CAST(-1 AS BIGINT) AS j, CAST(0 AS BIGINT) AS m, rest AS n FROM c, generate_series(0, {draws - 1}) AS t(d) WHERE j = 0
UNION ALL SELECT {by}, d, j, m, n - m FROM (SELECT {by}, d, j, n, CASE WHEN k = rest THEN n ELSE CAST(len(list_filter(range(1, n + 1), lambda i: list_sum(pm[1:i]) < u)) AS BIGINT) END AS m FROM
(SELECT {by}, d, c.j, w.n, k, rest, (('0x' || substr(md5('42|' || d || '|' || c.j), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u,
list_transform(range(0, w.n + 1), lambda i: exp(lgamma(w.n + 1) - lgamma(i + 1) - lgamma(w.n - i + 1) + i * ln(k / rest::DOUBLE) + (w.n - i) * ln(greatest(1 - k / rest::DOUBLE, 1e-300)))) AS pm
FROM w JOIN c USING ({by}) WHERE c.j = w.j + 1)))"""


def _bootstrap_sql(src: str, value: str, by: str = "model") -> str:
    return drawn_sql(src, value, by) + f""", m AS (SELECT {by}, d, sum(v * m) / sum(m)::DOUBLE AS mean FROM w JOIN c USING ({by}, j) GROUP BY ALL)
SELECT {by}, round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high FROM m GROUP BY ALL"""


@query(_bootstrap_sql("evb", "(gold = pred)::INT"))
def bootstrap_ci_accuracy(v: Views) -> DataFrame:
    return resampling.bootstrap(v.evb, ["model"], metrics.hit(F.col("gold"), F.col("pred")))


@query(_bootstrap_sql("evb", "abs(ascii(gold) - ascii(pred))"))
def bootstrap_ci_mae(v: Views) -> DataFrame:
    return resampling.bootstrap(v.evb, ["model"], F.abs(F.ascii("gold") - F.ascii("pred")))


@query(_bootstrap_sql("evb", "(gold = pred)::INT", "model, format"))
def bootstrap_ci_accuracy_1000(v: Views) -> DataFrame:
    """Intervals of every model and format."""
    return resampling.bootstrap(v.evb, ["model", "format"], metrics.hit(F.col("gold"), F.col("pred")))


@query(_bootstrap_sql("(SELECT l_linenumber AS line, least(l_quantity, 12) - l_linenumber AS gap FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 97 = s_nationkey)", "abs(CAST(gap AS INT))", "line"))
def bootstrap_ci_mae_1000(v: Views) -> DataFrame:
    """Intervals of a mean error that has a dozen values."""
    rows = v.table("lineitem").join(v.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).filter("l_orderkey % 97 = s_nationkey")
    return resampling.bootstrap(rows.withColumnRenamed("l_linenumber", "line"), ["line"], F.abs((F.least("l_quantity", F.lit(12)) - F.col("line")).cast("int")))


@query(drawn_sql("evb", "{'gold': gold, 'pred': pred}") + """, r AS (SELECT model, d, v.gold AS gold, sum(m * (v.gold = v.pred)::INT) / sum(m)::DOUBLE AS r FROM w JOIN c USING (model, j) WHERE m > 0 GROUP BY ALL), b AS (SELECT model, d, round(avg(r), 6) AS m FROM r GROUP BY ALL)
SELECT model, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM b GROUP BY model""")
def bootstrap_ci_balanced(v: Views) -> DataFrame:
    return resampling.bootstrap_of(v.evb, ["model"], metrics.balanced_accuracy, "balanced_accuracy")


@query("""WITH c AS (SELECT model, gold, pred, count(*) AS n FROM ev WHERE gold <> pred GROUP BY ALL) SELECT model, gold, pred, n FROM c QUALIFY row_number() OVER (PARTITION BY model ORDER BY n DESC, gold DESC, pred DESC) <= 3""")
def most_confused_top3(v: Views) -> DataFrame:
    c = metrics.confusion_counts(v.ev.filter("gold <> pred"), ["model"])
    return sampling.ranked(c, ["model"], F.desc("n"), F.desc("gold"), F.desc("pred")).filter("rn <= 3").drop("rn")


SCORES = "s AS (SELECT model, task, avg(CASE abs(ascii(gold) - ascii(pred)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE) AS m FROM ev GROUP BY ALL)"


#: A task whose score is an error: the smaller one wins.
ERROR_TASK = "BUILDING"


def scores(v: Views) -> DataFrame:
    return v.ev.groupBy("model", "task").agg(F.avg(metrics.off_by_one_score(F.col("gold"), F.col("pred"))).alias("m"))


@query(f"""WITH {SCORES} SELECT a.task, a.model AS model_a, b.model AS model_b, round(a.m - b.m, 6) AS delta, CASE WHEN abs(a.m - b.m) < 0.001 THEN 'tie' WHEN (a.m > b.m) <> (a.task = 'BUILDING') THEN a.model ELSE b.model END AS winner
FROM s a JOIN s b ON a.task = b.task AND a.model < b.model""")
def head_to_head(v: Views) -> DataFrame:
    s = scores(v)
    a, b = (s.select("task", F.col("model").alias(f"model_{k}"), F.col("m").alias(f"m_{k}")) for k in "ab")
    d = F.col("m_a") - F.col("m_b")
    return a.join(b, "task").filter("model_a < model_b").select("task", "model_a", "model_b", F.round(d, 6).alias("delta"), F.when(F.abs(d) < 0.001, "tie").when((d > 0) != (F.col("task") == ERROR_TASK), F.col("model_a")).otherwise(F.col("model_b")).alias("winner"))


@query(f"""WITH {SCORES}, r AS (SELECT model, avg(m) AS m FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY m DESC, model) AS k FROM r)
SELECT max(model) FILTER (k = 1) AS best, max(model) FILTER (k = 2) AS second, round(max(m) FILTER (k = 1) - max(m) FILTER (model = 'P'), 6) AS over_baseline FROM k""")
def best_vs_baseline(v: Views) -> DataFrame:
    r = scores(v).groupBy("model").agg(F.avg("m").alias("m"))
    k = r.withColumn("k", F.row_number().over(Window.orderBy(F.desc("m"), "model")))  # a row per model
    return k.agg(F.max(F.when(F.col("k") == 1, F.col("model"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("model"))).alias("second"), F.round(F.max(F.when(F.col("k") == 1, F.col("m"))) - F.max(F.when(F.col("model") == "P", F.col("m"))), 6).alias("over_baseline"))


@query(f"WITH {SCORES} SELECT task, model AS leader, round(m, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY task ORDER BY m DESC, model) = 1")
def format_leaders(v: Views) -> DataFrame:
    return sampling.ranked(scores(v), ["task"], F.desc("m"), F.col("model")).filter("rn = 1").select("task", F.col("model").alias("leader"), F.round("m", 6).alias("score"))


LATEST = "c AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY model, sample ORDER BY pos DESC) = 1)"


def latest(v: Views) -> DataFrame:
    return sampling.last_per_key(v.cells, ["model", "sample"], "pos")


@query("SELECT model, count(*) AS n, count(*) FILTER (score >= 0.5) AS passed, round(avg(score), 6) AS mean_score, round(avg(coalesce(nullif(score, 0), 0)), 6) AS mean_or_zero FROM cells GROUP BY model")
def pass_counts(v: Views) -> DataFrame:
    return v.cells.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("passed"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.coalesce("score", F.lit(0))), 6).alias("mean_or_zero"))


def _by_sample(v: Views) -> DataFrame:
    ok = F.col("score") >= 0.5
    return latest(v).groupBy("sample").agg(F.bool_or(~ok).alias("any_fail"), F.bool_or((F.col("model") == "view") & ok).alias("own"), F.bool_or((F.col("model") == "view") & ~ok).alias("own_fail"), F.bool_or(~F.col("model").isin("view", "error") & ~ok).alias("other_fail"))


@query(f"WITH {LATEST} SELECT DISTINCT sample FROM c WHERE score < 0.5")
def matrix_fails(v: Views) -> DataFrame:
    return _by_sample(v).filter("any_fail").select("sample")


@query(f"WITH {LATEST} SELECT sample FROM c GROUP BY sample HAVING bool_or(model = 'view' AND score >= 0.5) AND bool_or(model NOT IN ('view', 'error') AND score < 0.5)")
def matrix_llm_wins(v: Views) -> DataFrame:
    return _by_sample(v).filter("own AND other_fail").select("sample")


@query(f"WITH {LATEST} SELECT sample FROM c WHERE model = 'view' AND score < 0.5")
def matrix_llm_fails(v: Views) -> DataFrame:
    return _by_sample(v).filter("own_fail").select("sample")


MODELS = ["click", "error", "purchase", "signup", "view"]


@query(f"WITH {LATEST} SELECT sample, " + ", ".join(f"max(score) FILTER (model = '{m}') AS {m}" for m in MODELS) + " FROM c GROUP BY sample")
def pivot_matrix(v: Views) -> DataFrame:
    return latest(v).groupBy("sample").pivot("model", MODELS).agg(F.max("score"))


@query("SELECT model, task, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy FROM ev GROUP BY GROUPING SETS ((model), (model, task))")
def global_and_task_grouping_sets(v: Views) -> DataFrame:
    m, t = F.col("model"), F.col("task")
    return v.ev.groupingSets([[m], [m, t]], m, t).agg(F.count("*").alias("n"), F.round(F.avg(metrics.hit(F.col("gold"), F.col("pred"))), 6).alias("accuracy"))


@query(f"WITH {LATEST} SELECT model, sample, pos, score FROM c")
def cache_last_wins(v: Views) -> DataFrame:
    return latest(v).select("model", "sample", "pos", "score")


@query(f"WITH {LATEST} SELECT o_orderkey, coalesce(CAST(c.tokens AS VARCHAR), 'miss') AS pred FROM orders LEFT JOIN c ON c.sample = o_custkey AND c.model = 'view'")
def cache_lookup(v: Views) -> DataFrame:
    hit = latest(v).filter("model = 'view'").select(F.col("sample").alias("o_custkey"), "tokens")
    return v.table("orders").join(hit, "o_custkey", "left").select("o_orderkey", F.coalesce(F.col("tokens").cast("string"), F.lit("miss")).alias("pred"))


@query("SELECT model, count(*) AS n, round(avg(latency), 6) AS mean_latency, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (score >= 0.5) AS passed FROM cells GROUP BY model")
def model_latency_summary(v: Views) -> DataFrame:
    return v.cells.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.sum("tokens").alias("tokens"), F.count_if(F.col("score") >= 0.5).alias("passed"))


@query("""SELECT fmt, count(*) AS n, count(*) FILTER (model <> 'error') AS completed, count(*) FILTER (model = 'error') AS errors, arg_min(model, CASE WHEN model = 'error' THEN 1 ELSE 0 END * 1000000000 + pos) AS first_model FROM cells GROUP BY fmt""")
def task_summary(v: Views) -> DataFrame:
    bad = F.col("model") == "error"
    return v.cells.groupBy("fmt").agg(F.count("*").alias("n"), F.count_if(~bad).alias("completed"), F.count_if(bad).alias("errors"), F.min_by("model", F.struct(bad, "pos")).alias("first_model"))


@query("SELECT c_mktsegment, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def value_shares(v: Views) -> DataFrame:
    n = v.table("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return n.select("c_mktsegment", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # a row per segment


@query("SELECT r_regionkey, m.model, coalesce(n, 0) AS n FROM region CROSS JOIN (SELECT DISTINCT model FROM ev) m LEFT JOIN (SELECT model, count(*) AS n FROM ev WHERE task = 'MACHINERY' GROUP BY 1) c ON c.model = m.model AND r_regionkey = 0")
def display_grid(v: Views) -> DataFrame:
    models = v.ev.select("model").distinct()
    n = v.ev.filter("task = 'MACHINERY'").groupBy("model").agg(F.count("*").alias("n")).withColumn("r_regionkey", F.lit(0))
    grid = v.table("region").select("r_regionkey").join(F.broadcast(models))  # regions by models: both a handful of rows
    return grid.join(F.broadcast(n), ["r_regionkey", "model"], "left").select("r_regionkey", "model", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT task, max(n) - min(n) AS spread, max(n) - min(n) > 5 AS imbalanced FROM (SELECT task, gold, count(*) AS n FROM ev GROUP BY ALL) GROUP BY task")
def imbalance_check(v: Views) -> DataFrame:
    s = F.max("n") - F.min("n")
    return v.ev.groupBy("task", "gold").agg(F.count("*").alias("n")).groupBy("task").agg(s.alias("spread"), (s > 5).alias("imbalanced"))


@query("""WITH p AS (SELECT model, task, avg((gold = pred)::INT) AS acc, avg(CASE abs(ascii(gold) - ascii(pred)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE) AS obo FROM ev GROUP BY ALL),
r AS (SELECT model, 1 / (1 + avg(abs(pred - gold))) AS s FROM evr GROUP BY 1) SELECT p.model, task, round(CASE WHEN task = 'MACHINERY' THEN obo WHEN task = 'BUILDING' AND r.s IS NOT NULL THEN r.s ELSE acc END, 4) AS primary_score FROM p LEFT JOIN r ON r.model = p.model""")
def primary_scores(v: Views) -> DataFrame:
    p = v.ev.groupBy("model", "task").agg(F.avg(metrics.hit(F.col("gold"), F.col("pred"))).alias("acc"), F.avg(metrics.off_by_one_score(F.col("gold"), F.col("pred"))).alias("obo"))
    r = v.evr.groupBy("model").agg((1 / (1 + F.avg(F.abs(F.col("pred") - F.col("gold"))))).alias("s"))
    score = F.when(F.col("task") == "MACHINERY", F.col("obo")).when((F.col("task") == "BUILDING") & F.col("s").isNotNull(), F.col("s")).otherwise(F.col("acc"))
    return p.join(F.broadcast(r), "model", "left").select("model", "task", F.round(score, 4).alias("primary_score"))  # a row per model
