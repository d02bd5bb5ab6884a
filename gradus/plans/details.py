"""Smaller projections and summaries: log cells, model order, markup, scores of older versions, claims, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import prompts
from gradus.operators import metrics, sampling
from gradus.plans.catalogue import query
from gradus.plans.views import EFFECTS, Views

#: Display order of the models; others follow by name.
ORDER = ["view", "click"]


@query("SELECT event_type, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS percent FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def percent_by_group(v: Views) -> DataFrame:
    n = v.table("events").groupBy("event_type").agg(F.count("*").alias("n"))
    return n.select("event_type", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))  # a row per type


@query("SELECT acc, count(DISTINCT gene) AS genes, count(DISTINCT comparison) AS comparisons, count(DISTINCT treatment) AS treatments FROM dx GROUP BY acc ORDER BY genes DESC, acc LIMIT 15")
def multi_nunique_top15(v: Views) -> DataFrame:
    d = F.countDistinct
    return v.dx.groupBy("acc").agg(d("gene").alias("genes"), d("comparison").alias("comparisons"), d("treatment").alias("treatments")).orderBy(F.desc("genes"), "acc").limit(15)


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE lang END AS lang FROM documents) GROUP BY ALL ORDER BY n DESC, source, lang NULLS LAST LIMIT 20")
def value_counts_with_nulls(v: Views) -> DataFrame:
    lang = F.when(F.col("doc_id") % 9 != 0, F.col("lang"))
    return v.table("documents").groupBy("source", lang.alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", F.asc_nulls_last("lang")).limit(20)


@query("SELECT pos, CASE WHEN score >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict, round(abs(latency - 10), 2) AS mae, coalesce(tokens, 0) AS tokens FROM cells")
def cell_projection(v: Views) -> DataFrame:
    return v.cells.select("pos", F.when(F.col("score") >= 0.5, "pass").otherwise("fail").alias("verdict"), F.round(F.abs(F.col("latency") - 10), 2).alias("mae"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


@query("SELECT model, CAST(row_number() OVER (ORDER BY CASE model WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 999 END, model) AS INTEGER) AS place FROM (SELECT DISTINCT model FROM cells)")
def model_order(v: Views) -> DataFrame:
    rank = F.lit(999)
    for i, m in enumerate(ORDER):
        rank = F.when(F.col("model") == m, i).otherwise(rank)
    return v.cells.select("model").distinct().select("model", F.row_number().over(Window.orderBy(rank, "model")).alias("place"))  # a row per model


@query("SELECT page_id, CASE WHEN contains(url, 'example.org') THEN 'task_a' WHEN contains(url, '.com') THEN 'task_b' ELSE 'other' END AS task FROM pages")
def log_task(v: Views) -> DataFrame:
    u = F.col("url")
    return v.table("pages").select("page_id", F.when(u.contains("example.org"), "task_a").when(u.contains(".com"), "task_b").otherwise("other").alias("task"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IS NULL OR o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def status_map(v: Views) -> DataFrame:
    s = F.col("o_orderstatus")
    return v.table("orders").select("o_orderkey", F.when(s.isNull() | (s == "F"), "complete").when(s == "O", "open").otherwise(s).alias("status"))


@query("SELECT doc_id, replace(replace(replace(replace(t, 'FOXO3', '[GENE]FOXO3[/GENE]'), 'GENE7', '[GENE]GENE7[/GENE]'), 'daf-2', '[GENE]daf-2[/GENE]'), 'Trp53', '[GENE]Trp53[/GENE]') AS marked FROM trace")
def entity_markup(v: Views) -> DataFrame:
    """Every listed gene of every text in markup, the genes as a column."""
    genes = F.array(*[F.lit(g) for g, _ in EFFECTS])
    return v.trace.select("doc_id", F.aggregate(genes, F.col("t"), lambda t, g: F.replace(t, g, F.concat(F.lit("[GENE]"), g, F.lit("[/GENE]")))).alias("marked"))


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS supported, count(*) FILTER (l_returnflag = 'A') AS refuted FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(coalesce(supported / nullif(n, 0)::DOUBLE, 0.5), 6) AS valid_share, round(coalesce(supported / nullif(supported + refuted, 0)::DOUBLE, 0.5), 6) AS support FROM c""")
def claim_scores(v: Views) -> DataFrame:
    c = v.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("s"), F.count_if(F.col("l_returnflag") == "A").alias("r"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.5)), 6)
    return c.select("l_orderkey", share(F.col("s"), F.col("n")).alias("valid_share"), share(F.col("s"), F.col("s") + F.col("r")).alias("support"))


@query("""SELECT gold, count(*) AS n, count(*) FILTER (pred NOT IN ('A', 'B')) AS invalid, round(avg((gold = pred)::INT), 6) AS accuracy FROM (SELECT CASE WHEN gold IN ('A', 'B') THEN gold ELSE 'B' END AS gold, pred FROM ev) GROUP BY gold""")
def binary_with_invalid(v: Views) -> DataFrame:
    g = F.when(F.col("gold").isin("A", "B"), F.col("gold")).otherwise("B")
    return v.ev.select(g.alias("gold"), "pred").groupBy("gold").agg(F.count("*").alias("n"), F.count_if(~F.col("pred").isin("A", "B")).alias("invalid"), F.round(F.avg(metrics.hit(F.col("gold"), F.col("pred"))), 6).alias("accuracy"))


@query("""WITH p AS (SELECT conv_id, list_sum(list_transform(m, lambda x: length(x.content))) AS chars FROM msgs) SELECT conv_id, CAST(chars AS BIGINT) AS chars, chars > 3000 AS over FROM p ORDER BY chars DESC, conv_id LIMIT 10""")
def longest_prompts(v: Views) -> DataFrame:
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(F.coalesce(x.content, F.lit(""))))
    return v.msgs.select("conv_id", chars.alias("chars")).orderBy(F.desc("chars"), "conv_id").limit(10).select("conv_id", "chars", (F.col("chars") > 3000).alias("over"))


@query("WITH c AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY model, sample ORDER BY pos DESC) = 1) SELECT sample, coalesce(max(score) FILTER (model = 'view'), 0) AS score FROM c GROUP BY sample ORDER BY score DESC, sample")
def matrix_sort(v: Views) -> DataFrame:
    c = sampling.last_per_key(v.cells, ["model", "sample"], "pos")
    return c.groupBy("sample").agg(F.coalesce(F.max(F.when(F.col("model") == "view", F.col("score"))), F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "sample")


@query("""WITH c AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY model, sample ORDER BY pos DESC) = 1), m AS (SELECT sample, count(*) AS models, sum(score) AS total FROM c GROUP BY sample)
SELECT sample, models, round(total, 6) AS total, rank() OVER (ORDER BY round(total, 6) DESC) AS place FROM m""")
def matrix_sort_all(v: Views) -> DataFrame:
    """Samples by the sum over all models, equal sums at equal places."""
    c = sampling.last_per_key(v.cells.select("model", "sample", "score", "pos"), ["model", "sample"], "pos")
    m = c.groupBy("sample").agg(F.count("*").alias("models"), F.round(F.sum("score"), 6).alias("total"))
    sums = m.groupBy("total").agg(F.count("*").alias("k")).withColumn("minus", -F.col("total"))
    places = metrics.counted_below(sums, [], "minus", "k").select("total", (F.col("below") + 1).cast("long").alias("place"))
    return m.join(places, "total").select("sample", "models", "total", "place")


@query("""WITH m AS (SELECT model, fmt, avg(score) AS s FROM cells WHERE model <> 'error' GROUP BY ALL) SELECT f.fmt, round(coalesce(avg(s), 0.5), 6) AS reference FROM (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS fmt) f LEFT JOIN m ON m.fmt = f.fmt GROUP BY f.fmt""")
def reference_line(v: Views) -> DataFrame:
    m = v.cells.filter("model <> 'error'").groupBy("model", "fmt").agg(F.avg("score").alias("s"))
    formats = v.spark.range(5).select(F.col("id").alias("fmt"))
    return formats.join(m, "fmt", "left").groupBy("fmt").agg(F.round(F.coalesce(F.avg("s"), F.lit(0.5)), 6).alias("reference"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING') THEN 'treatment with ' || c_mktsegment ELSE 'siRNA knockdown of ' || c_mktsegment END || ' at dose ' || c_nationkey AS treatment,
'IMR-90 ' || lower(c_mktsegment) || ' fibroblasts' AS tissue FROM customer""")
def treatment_texts(v: Views) -> DataFrame:
    m = F.col("c_mktsegment")
    t = F.when(m == "BUILDING", m).otherwise(F.concat(F.lit("si"), m))
    none = F.lit(None).cast("string")
    return v.table("customer").select("c_custkey", prompts.treatment_text(t, F.col("c_nationkey").cast("string"), none, none).alias("treatment"), prompts.tissue_text(m, F.lit("IMR")).alias("tissue"))


@query("""SELECT c_custkey, 'Sex: ' || (['female', 'male'])[CAST(c_custkey % 2 AS INTEGER) + 1] || chr(10) || 'Profile: balance: ' || CAST(CAST(round(c_acctbal / 100) AS INTEGER) AS VARCHAR) || chr(10) || 'How old is the person, in years?' AS question, CAST(c_nationkey AS VARCHAR) AS gold FROM customer""")
def render_prompts(v: Views) -> DataFrame:
    f = F.array(F.struct(F.lit("balance").alias("name"), F.round(F.col("c_acctbal") / 100).alias("value")))
    c = v.table("customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("sex"), prompts.profile_text(f).alias("profile"))
    return prompts.with_prompt(c, "age", F.col("c_nationkey")).select("c_custkey", F.col("messages")[1].content.alias("question"), F.col("messages")[2].content.alias("gold"))
