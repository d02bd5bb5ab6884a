"""Filters, joins, labels and the metrics of single predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.labels import bracket, ordinal, significance_label, ternary_label, treatment_filter
from gradus.operators import metrics
from gradus.operators.sampling import first_per_key
from gradus.plans.catalogue import query
from gradus.plans.views import Views

CONTROLS = ["F", "O"]
KEPT = "treatment IS DISTINCT FROM 'none' AND control_type IN ('F', 'O')"
DIRECTION = "CASE WHEN logfc > 1 AND p < 0.05 THEN 'upregulated' WHEN logfc < -1 AND p < 0.05 THEN 'downregulated' ELSE 'no_change' END"


def perturbed(v: Views) -> DataFrame:
    dx = v.dx
    return dx.filter(treatment_filter(F.col("treatment"), F.col("control_type"), CONTROLS))


def labelled(v: Views) -> DataFrame:
    return perturbed(v).withColumn("direction", ternary_label(F.col("logfc"), F.col("p")))


@query("""WITH s AS (SELECT model, task, avg(CASE abs(ascii(gold) - ascii(pred)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE) AS m FROM ev GROUP BY ALL)
SELECT model, round(avg(m), 6) AS mean_score, count(*) AS n_formats FROM s GROUP BY model""")
def score_by_format_leaderboard(v: Views) -> DataFrame:
    per = v.ev.groupBy("model", "task").agg(F.avg(metrics.off_by_one_score(F.col("gold"), F.col("pred"))).alias("m"))
    return per.groupBy("model").agg(F.round(F.avg("m"), 6).alias("mean_score"), F.count("*").alias("n_formats"))


@query(f"SELECT rid, comparison, gene, treatment FROM dx WHERE {KEPT}")
def perturbation_filter(v: Views) -> DataFrame:
    return perturbed(v).select("rid", "comparison", "gene", "treatment")


FIRST = "f AS (SELECT * FROM anno QUALIFY row_number() OVER (PARTITION BY gene ORDER BY pos) = 1)"


@query(f"WITH {FIRST} SELECT rid, d.gene, name, effect, cancer FROM dx d LEFT JOIN f ON d.gene = f.gene WHERE {KEPT}")
def annotate_left_join(v: Views) -> DataFrame:
    return perturbed(v).join(first_per_key(v.anno, "gene", "pos"), "gene", "left").select("rid", "gene", "name", "effect", "cancer")


@query(f"SELECT gene, count(*) AS n FROM dx WHERE {KEPT} AND gene IN (SELECT gene FROM anno WHERE cancer = 'No') GROUP BY gene")
def semi_join_genes(v: Views) -> DataFrame:
    return perturbed(v).join(v.anno.filter("cancer = 'No'").select("gene"), "gene", "left_semi").groupBy("gene").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT gene FROM dx WHERE gene NOT IN (SELECT gene FROM anno WHERE cancer = 'No')")
def anti_join_unmatched(v: Views) -> DataFrame:
    return v.dx.select("gene").distinct().join(v.anno.filter("cancer = 'No'").select("gene"), "gene", "left_anti")


@query(f"SELECT {DIRECTION} AS direction, count(*) AS n FROM dx WHERE {KEPT} GROUP BY 1")
def ternary_label_counts(v: Views) -> DataFrame:
    return labelled(v).groupBy("direction").agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN abs(logfc) > 1 AND p < 0.05 THEN 'significant' ELSE 'not_significant' END AS label, count(*) AS n FROM dx WHERE {KEPT} GROUP BY 1")
def binary_significance_counts(v: Views) -> DataFrame:
    return perturbed(v).groupBy(significance_label(F.col("logfc"), F.col("p")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 5000 THEN 'mid' WHEN c_acctbal < 9000 THEN 'high' ELSE NULL END AS bracket, count(*) AS n FROM customer GROUP BY 1")
def bucketize_counts(v: Views) -> DataFrame:
    return v.table("customer").groupBy(bracket(F.col("c_acctbal"), [0, 2500, 5000, 9000], ["low", "mid", "high"]).alias("bracket")).agg(F.count("*").alias("n"))


@query("SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS row_index FROM ev WHERE task = 'MACHINERY' ORDER BY id LIMIT 50")
def format_filter_limit(v: Views) -> DataFrame:
    from pyspark.sql import Window

    first = v.ev.filter("task = 'MACHINERY'").select("id").orderBy("id").limit(50)
    return first.withColumn("row_index", F.row_number().over(Window.orderBy("id")) - 1)  # at most the limit's rows


@query("SELECT model, task, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy FROM ev GROUP BY ALL")
def accuracy_by_model(v: Views) -> DataFrame:
    return metrics.accuracy(v.ev, ["model", "task"])


@query("WITH r AS (SELECT model, gold, avg((gold = pred)::INT) AS r FROM ev GROUP BY ALL) SELECT model, round(avg(r), 6) AS balanced_accuracy FROM r GROUP BY model")
def balanced_accuracy(v: Views) -> DataFrame:
    return metrics.balanced_accuracy(v.ev, ["model"])


@query("""WITH l AS (SELECT model, gold AS label FROM ev UNION SELECT model, pred FROM ev),
f AS (SELECT l.model, l.label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold = label) AS g, count(*) FILTER (pred = label) AS q FROM l JOIN ev e ON e.model = l.model GROUP BY ALL)
SELECT model, round(avg(coalesce(2.0::DOUBLE * tp / nullif(g + q, 0), 0)), 6) AS macro_f1 FROM f GROUP BY model""")
def macro_f1(v: Views) -> DataFrame:
    return metrics.macro_f1(v.ev, ["model"])


@query("""WITH l AS (SELECT model, gold AS label FROM evb UNION SELECT model, pred FROM evb),
g AS (SELECT a.model, a.label AS gold, b.label AS pred FROM l a JOIN l b ON a.model = b.model), c AS (SELECT model, gold, pred, count(*) AS n FROM evb GROUP BY ALL)
SELECT model, gold, pred, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (model, gold, pred)""")
def confusion_matrix(v: Views) -> DataFrame:
    return metrics.confusion_matrix(v.evb, ["model"])


@query("SELECT model, round(sum(CASE abs(ascii(gold) - ascii(pred)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE) / count(*), 4) AS off_by_one FROM ev GROUP BY model")
def off_by_one(v: Views) -> DataFrame:
    return v.ev.groupBy("model").agg(F.round(F.sum(metrics.off_by_one_score(F.col("gold"), F.col("pred"))) / F.count("*"), 4).alias("off_by_one"))


@query("SELECT model, round(avg(abs(pred - gold)), 6) AS mae, round(quantile_cont(abs(pred - gold), 0.5), 6) AS median_ae, round(avg((sign(pred) = sign(gold))::INT), 6) AS sign_agreement FROM evr GROUP BY model")
def mae_median_sign(v: Views) -> DataFrame:
    return metrics.regression(v.evr, ["model"])


@query("SELECT model, gold, count(*) AS n, round(avg((gold = pred)::INT), 6) AS accuracy FROM evb WHERE gold IN ('A', 'B') GROUP BY ALL")
def class_accuracy(v: Views) -> DataFrame:
    return metrics.accuracy(v.evb.filter(F.col("gold").isin("A", "B")), ["model", "gold"])


@query("""SELECT model, count(*) FILTER (gold = 'A') AS gold_a, count(*) FILTER (pred = 'A') AS pred_a, round(avg((gold = 'A')::INT), 4) AS gold_fraction, round(avg((pred = 'A')::INT), 4) AS pred_fraction,
round(avg((pred = 'A')::INT - (gold = 'A')::INT), 4) AS a_bias FROM evb GROUP BY model""")
def pred_distribution_bias(v: Views) -> DataFrame:
    g, q = (F.col("gold") == "A").cast("int"), (F.col("pred") == "A").cast("int")
    return v.evb.groupBy("model").agg(F.sum(g).alias("gold_a"), F.sum(q).alias("pred_a"), F.round(F.avg(g), 4).alias("gold_fraction"), F.round(F.avg(q), 4).alias("pred_fraction"), F.round(F.avg(q - g), 4).alias("a_bias"))


@query("SELECT gold, CAST(ascii(gold) - 65 AS INTEGER) AS place, count(*) AS n FROM ev GROUP BY ALL")
def ordinal_places(v: Views) -> DataFrame:
    return v.ev.groupBy("gold", ordinal(F.col("gold")).alias("place")).agg(F.count("*").alias("n"))
