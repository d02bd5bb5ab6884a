"""Records, look-ups, checks and formats: the smaller members of the survey, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.functions import labels
from gradus.functions import text as T
from gradus.operators import metrics, sampling
from gradus.plans.analytics import drawn_sql
from gradus.plans.catalogue import query
from gradus.plans.core import DIRECTION, KEPT, labelled
from gradus.plans.views import Views
from gradus.sources import evals
from gradus.streaming import live


@query("SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer) WHERE c_mktsegment IS NOT NULL")
def drop_null_label(v: Views) -> DataFrame:
    c = v.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return c.na.drop(subset=["c_mktsegment"])


@query("SELECT sample, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, CASE WHEN feature % 3 = 0 THEN 'f' || feature || ': NA' ELSE 'f' || feature END AS name FROM feat) WHERE NOT ends_with(name, ': NA') GROUP BY sample")
def suffix_selection(v: Views) -> DataFrame:
    """Features without a name, which end in ``: NA``, stay out."""
    name = F.concat(F.lit("f"), F.col("feature").cast("string"), F.when(F.col("feature") % 3 == 0, ": NA").otherwise(""))
    return v.feat.withColumn("name", name).filter(~F.col("name").endswith(": NA")).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 24 THEN NULL ELSE c_nationkey * 5 END AS age FROM customer WHERE (c_nationkey <> 24 AND c_nationkey * 5 BETWEEN 20 AND 90)""")
def range_without_sentinel(v: Views) -> DataFrame:
    """Ages in range; the sentinel 999 stands for a total and is no age."""
    age = F.when(F.col("c_nationkey") == 24, 999).otherwise(F.col("c_nationkey") * 5)
    return v.table("customer").select("c_custkey", age.alias("age")).filter(F.col("age").between(20, 90) & (F.col("age") != 999))


@query("""SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS place, p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, ''), '—') AS organism,
coalesce(CASE WHEN p_size % 2 = 0 THEN p_name END, CASE WHEN p_size % 5 <> 0 THEN p_brand END, '—') AS gene, coalesce(CASE WHEN p_size % 7 <> 0 THEN p_brand END, CASE WHEN p_size % 2 = 0 THEN p_name END, '—') AS other_gene FROM part""")
def screen_records(v: Views) -> DataFrame:
    """Rows of a record view: a place, fallbacks for missing fields, both genes of a pair, a dash where nothing is known."""
    p, known = v.table("part"), lambda n, c: F.when(F.col("p_size") % n != 0, F.col(c))
    name = F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    gene, other = (labels.truthy(*x, F.lit("—")) for x in ((name, known(5, "p_brand")), (known(7, "p_brand"), name)))
    organism = labels.truthy(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")), F.lit("—"))
    rows = p.select("p_partkey", organism.alias("organism"), gene.alias("gene"), other.alias("other_gene"))
    return sampling.placed(rows, "p_partkey").withColumnRenamed("rn", "place")


@query("""WITH l AS (SELECT sample, arg_max(latency, pos) AS latency, max(pos) AS pos FROM cells GROUP BY sample) SELECT o_orderkey, pos, latency FROM orders JOIN l ON l.sample = o_custkey""")
def trace_lookup(v: Views) -> DataFrame:
    """Records with the last trace of their id; records without one go."""
    last = sampling.last_per_key(v.cells.select("sample", "pos", "latency"), ["sample"], "pos").withColumnRenamed("sample", "o_custkey")
    return v.table("orders").join(last, "o_custkey").select("o_orderkey", "pos", "latency")


@query("""WITH s AS (SELECT sample, arg_min(score, pos) AS score FROM cells GROUP BY sample) SELECT c_custkey, c_name, score FROM s JOIN customer ON c_custkey = sample""")
def score_lookup(v: Views) -> DataFrame:
    """Scores with their records, each by the first score of its id."""
    first = sampling.first_per_key(v.cells.select("sample", "pos", "score"), "sample", "pos")
    return first.join(v.table("customer").withColumnRenamed("c_custkey", "sample"), "sample").select(F.col("sample").alias("c_custkey"), "c_name", "score")


@query("""WITH m AS (SELECT model, gold, pred, CASE WHEN task IN ('BUILDING', 'MACHINERY') AND model <> 'P' THEN 'Balanced Accuracy' ELSE 'accuracy' END AS metric FROM ev),
r AS (SELECT model, gold, avg((gold = pred)::INT) AS r FROM m WHERE lower(metric) = 'balanced accuracy' AND gold IS NOT NULL GROUP BY ALL), b AS (SELECT model, round(avg(r), 6) AS balanced_accuracy FROM r GROUP BY model)
SELECT model, balanced_accuracy FROM (SELECT DISTINCT model FROM ev) LEFT JOIN b USING (model)""")
def metric_balanced_accuracy(v: Views) -> DataFrame:
    """Balanced accuracy over the rows that are scored by it; null for a model without such rows."""
    metric = F.when(F.col("task").isin("BUILDING", "MACHINERY") & (F.col("model") != "P"), "Balanced Accuracy").otherwise("accuracy")
    rows = v.ev.withColumn("metric", metric).filter((F.lower("metric") == "balanced accuracy") & F.col("gold").isNotNull())
    return v.ev.select("model").distinct().join(metrics.balanced_accuracy(rows, ["model"]), "model", "left")


@query("""WITH m AS (SELECT model, task, gold, pred, CASE WHEN task = 'BUILDING' THEN 'MAE' WHEN task = 'MACHINERY' THEN 'Off-by-One Accuracy' WHEN model <> 'P' THEN 'Balanced Accuracy' ELSE 'accuracy' END AS metric, abs(ascii(gold) - ascii(pred)) AS far FROM ev),
r AS (SELECT model, gold, avg((gold = pred)::INT) AS r FROM m WHERE lower(metric) = 'balanced accuracy' AND gold IS NOT NULL GROUP BY ALL), b AS (SELECT model, round(avg(r), 6) AS balanced_accuracy FROM r GROUP BY model)
SELECT model, any_value(balanced_accuracy) AS balanced_accuracy, round(avg(CASE far WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE) FILTER (lower(metric) = 'off-by-one accuracy'), 6) AS off_by_one_accuracy, round(avg(far) FILTER (lower(metric) = 'mae'), 6) AS mae, round(avg((gold = pred)::INT) FILTER (lower(metric) = 'accuracy'), 6) AS accuracy FROM m LEFT JOIN b USING (model) GROUP BY model""")
def metrics_by_name(v: Views) -> DataFrame:
    """Each model's metrics, every one over the rows that name it; null where none do."""
    metric = F.when(F.col("task") == "BUILDING", "MAE").when(F.col("task") == "MACHINERY", "Off-by-One Accuracy").when(F.col("model") != "P", "Balanced Accuracy").otherwise("accuracy")
    far = F.abs(F.ascii("gold") - F.ascii("pred")).cast("double")
    return metrics.by_name(v.ev.withColumns({"metric": metric, "error": far}), ["model"])


@query(r"""WITH a AS (SELECT conv_id, role, regexp_extract(text, '(-?\d+(?:\.\d+)?)', 1) AS x FROM conversations) SELECT role, count(*) AS n, count(*) FILTER (TRY_CAST(nullif(x, '') AS DOUBLE) IS NULL) AS parse_failures FROM a GROUP BY role""")
def parse_failures(v: Views) -> DataFrame:
    return v.table("conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(T.first_number(F.col("text")).isNull()).alias("parse_failures"))


PARTS = r"list_distinct(list_filter(list_transform(regexp_split_to_array({x}, '[,;\n]'), lambda p: lower(regexp_replace(p, '^\s+|\s+$', '', 'g'))), lambda p: p <> ''))"


@query(f"""WITH s AS (SELECT p_type, {PARTS.format(x="CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name || ', ' || p_brand END")} AS a, {PARTS.format(x="CASE WHEN p_size % 4 = 0 THEN ' ; ' ELSE p_name || ';' || p_type END")} AS b FROM part),
j AS (SELECT p_type, len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0) AS j FROM s) SELECT p_type, count(*) AS n, count(j) AS compared, round(avg(j), 6) AS mean_jaccard FROM j GROUP BY p_type""")
def mean_set_jaccard(v: Views) -> DataFrame:
    """Mean Jaccard of answer sets; rows whose sets are both empty do not count."""
    none = F.col("p_size") % 4 == 0
    a = T.label_set(F.when(none, "").otherwise(F.concat("p_name", F.lit(", "), "p_brand")))
    b = T.label_set(F.when(none, " ; ").otherwise(F.concat("p_name", F.lit(";"), "p_type")))
    j = v.table("part").select("p_type", T.jaccard(a, b).alias("j"))
    return j.groupBy("p_type").agg(F.count("*").alias("n"), F.count("j").alias("compared"), F.round(F.avg("j"), 6).alias("mean_jaccard"))


@query("SELECT model, count(*) AS done, round(avg(latency), 4) AS mean_seconds, 100000 - count(*) AS left_over, round(avg(latency) * (100000 - count(*)) / 60, 4) AS minutes_left FROM cells WHERE latency IS NOT NULL GROUP BY model")
def run_progress(v: Views) -> DataFrame:
    """Mean seconds of a run's finished samples and the minutes that the rest of a planned 100,000 takes at that pace."""
    sums = v.cells.filter("latency IS NOT NULL").groupBy("model").agg(F.count("*").alias("done"), F.sum("latency").alias("seconds"))
    return sums.select("model", "done", *live.progress(F.col("done"), F.col("seconds")))


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS pos, CASE p_partkey % 40 WHEN 3 THEN p_name || '_7' ELSE p_name END AS name, '_' || p_size || CASE WHEN p_size % 2 = 0 THEN '_' || p_brand ELSE '' END AS suffix FROM part),
f AS (SELECT *, min(pos) OVER (PARTITION BY name) AS first FROM n),
d(pos, made) AS (SELECT pos, name || suffix FROM f WHERE pos <> first UNION SELECT f.pos, f.name || f.suffix FROM f JOIN d ON f.name = d.made AND d.pos < f.pos WHERE f.pos = f.first)
SELECT n.pos AS p_partkey, coalesce(d.made, n.name) AS unique_name FROM n LEFT JOIN d USING (pos)""")
def name_suffix_by_size(v: Views) -> DataFrame:
    """A name seen before, as given or as made, takes its row's own numbers behind it."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 40 == 3, "_7").otherwise(""))
    suffix = F.concat(F.lit("_"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), "p_brand")).otherwise(""))
    rows = v.table("part").withColumn("name", name)
    return sampling.unique_names(rows, "name", suffix, "p_partkey").select("p_partkey", "unique_name")


@query("SELECT o_custkey, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS timepoints FROM orders GROUP BY o_custkey")
def sorted_timepoints(v: Views) -> DataFrame:
    """Time points of each series in their order."""
    points = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return v.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.transform(points, lambda p: p.o_orderkey.cast("string")), ",").alias("timepoints"))


@query(f"""WITH l AS (SELECT *, {DIRECTION} AS direction FROM dx WHERE {KEPT}), r AS (SELECT comparison, organ, rid, abs(logfc) AS a, row_number() OVER (PARTITION BY comparison ORDER BY abs(logfc) DESC, rid) AS up, row_number() OVER (PARTITION BY comparison ORDER BY abs(logfc), rid DESC) AS down,
count(*) OVER (PARTITION BY comparison) AS n FROM l),
p AS (SELECT x.organ, x.rid AS large, y.rid AS small, x.comparison, x.up AS i FROM r x JOIN r y ON x.comparison = y.comparison AND x.up = y.down WHERE x.up <= x.n // 2 AND y.down <= y.n // 2 AND x.a - y.a >= 0.5),
q AS (SELECT organ, large, small FROM p QUALIFY row_number() OVER (PARTITION BY comparison ORDER BY i) <= 3),
c AS (SELECT organ, count(*) AS n FROM q GROUP BY 1), b AS (SELECT *, least(n, 100 // (SELECT count(*) FROM c)) AS base FROM c), s AS (SELECT *, n - base AS spare, 100 - sum(base) OVER () AS need FROM b),
k AS (SELECT organ, base + greatest(0, least(spare, need - coalesce(sum(spare) OVER (ORDER BY n DESC, organ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM s)
SELECT organ, large, small FROM (SELECT *, row_number() OVER (PARTITION BY organ ORDER BY md5(concat_ws('|', '42', 'tissue', large)), large) AS rn FROM q) JOIN k USING (organ) WHERE rn <= quota""")
def pairs_by_tissue(v: Views) -> DataFrame:
    """Pairs in equal shares per tissue; the surplus of the largest pool fills up first."""
    rows = labelled(v)
    pairs = sampling.pair_extremes(rows, "comparison", 0.5, 3).join(rows.select("comparison", "organ").distinct(), "comparison")
    return sampling.tissue_balanced_pairs(pairs, 100, "tissue", key="large").select("organ", "large", "small")


@query(drawn_sql("(SELECT s_nationkey AS gold, s_acctbal AS pred, s_suppkey % 3 AS model FROM supplier)", "{'x': gold, 'y': pred}") + """, x AS (SELECT model, d, v.x AS x, v.y AS y, m FROM w JOIN c USING (model, j) WHERE m > 0),
z AS (SELECT model, d, m, sum(m) OVER (PARTITION BY model, d ORDER BY x) - (sum(m) OVER (PARTITION BY model, d, x) - 1) / 2.0::DOUBLE AS a, sum(m) OVER (PARTITION BY model, d ORDER BY y) - (sum(m) OVER (PARTITION BY model, d, y) - 1) / 2.0::DOUBLE AS b FROM x),
s AS (SELECT model, d, sum(m) AS n, sum(m * a) AS sa, sum(m * b) AS sb, sum(m * a * b) AS sab, sum(m * a * a) AS saa, sum(m * b * b) AS sbb FROM z GROUP BY ALL),
r AS (SELECT model, (sab * n - sa * sb) / nullif(sqrt(saa * n - sa * sa) * sqrt(sbb * n - sb * sb), 0) AS rho FROM s)
SELECT model, round(quantile_cont(rho, 0.025), 4) AS ci_low, round(quantile_cont(rho, 0.975), 4) AS ci_high FROM r WHERE rho IS NOT NULL GROUP BY model""")
def bootstrap_ci_spearman(v: Views) -> DataFrame:
    """Interval of the rank correlation; draws without one stay out."""
    rows = v.table("supplier").select((F.col("s_suppkey") % 3).alias("model"), F.col("s_nationkey").alias("gold"), F.col("s_acctbal").alias("pred"))
    return metrics.bootstrap_spearman(rows, ["model"])


METRICS, FORMATS = ["mae", "accuracy", "exact"], ["regression", "mcq", "free", "multiple choice"]


@query(r"""WITH a AS (SELECT conv_id, turn, regexp_replace('"' || text || ' = 42.5 ' || chr(10) || '"' , '^\s+|\s+$', '', 'g') AS x, (['mae', 'accuracy', 'exact'])[CAST(turn % 3 AS INTEGER) + 1] AS metric, (['regression', 'mcq', 'free', 'multiple choice'])[CAST(conv_id % 4 AS INTEGER) + 1] AS f FROM conversations)
SELECT conv_id, turn, CASE WHEN metric = 'mae' OR f = 'regression' THEN CAST(CAST(nullif(regexp_extract(x, '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS VARCHAR)
WHEN f IN ('mcq', 'multiple choice') THEN coalesce(nullif(regexp_extract(x, '^(?s:(?:.*[^A-Za-z])?([A-F])(?:[^A-Za-z].*)?)$', 1), ''), x) ELSE regexp_replace(regexp_replace(x, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') END AS answer FROM a""")
def extract_by_metric(v: Views) -> DataFrame:
    """The answer by what it is scored with; the test text ends in a number and stands in quotes."""
    x = F.concat(F.lit('"'), F.col("text"), F.lit(' = 42.5 \n"'))
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs)).cast("int") + 1)
    return v.table("conversations").select("conv_id", "turn", T.extracted(x, pick(METRICS, "turn"), pick(FORMATS, "conv_id")).alias("answer"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.5f', l_extendedprice / 7) AS five, printf('%.2f', l_extendedprice / 7) AS two, printf('%.4f', l_quantity / 3) AS four FROM lineitem")
def fixed_point_formats(v: Views) -> DataFrame:
    price, quantity = F.col("l_extendedprice") / 7, F.col("l_quantity") / 3
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.format_string("%.5f", price).alias("five"), F.format_string("%.2f", price).alias("two"), F.format_string("%.4f", quantity).alias("four"))


@query("SELECT n_nationkey, CASE taxid WHEN 9606 THEN 'human' WHEN 10090 THEN 'mouse' WHEN 10116 THEN 'rat' WHEN 7227 THEN 'fruitfly' WHEN 6239 THEN 'c_elegans' WHEN 4932 THEN 'yeast' ELSE CASE WHEN taxid IS NULL OR taxid = 0 THEN 'unknown' ELSE 'other' END END AS species FROM (SELECT n_nationkey, ([9606, 10090, 10116, 7227, 6239, 4932, 0, NULL, 5])[n_nationkey % 9 + 1] AS taxid FROM nation)")
def species_of_taxid(v: Views) -> DataFrame:
    ids = F.array(*[F.lit(x).cast("int") for x in (9606, 10090, 10116, 7227, 6239, 4932, 0, None, 5)])
    return v.table("nation").select("n_nationkey", labels.species(F.element_at(ids, F.col("n_nationkey") % 9 + 1)).alias("species"))


TOKENS = r"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
SERIAL = "array_to_string(list_transform(m, lambda x: '<' || x.role || '>' || chr(10) || x.content), chr(10))"


@query(f"""WITH t AS (SELECT conv_id, {TOKENS.format(x=SERIAL)} AS tokens FROM msgs) SELECT count(*) AS checked, max(tokens) AS max_tokens, CAST(sum(tokens) AS BIGINT) AS total, count(*) FILTER (tokens > 400) AS over_limit,
array_to_string(list_sort(list(conv_id) FILTER (tokens > 400))[1:50], ',') AS failures FROM t""")
def token_statistics(v: Views) -> DataFrame:
    """Prompts checked against a limit by a pluggable count; the first fifty over it are listed."""
    t = v.msgs.select("conv_id", T.token_count(F.col("m"), T.approximate_tokens).cast("long").alias("tokens"))
    over = F.col("tokens") > 400
    sums = t.agg(F.count("*").alias("checked"), F.max("tokens").alias("max_tokens"), F.sum("tokens").alias("total"), F.count_if(over).alias("over_limit"))
    first = t.filter(over).orderBy("conv_id").limit(50).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("failures"))
    return sums.join(F.broadcast(first))  # one row each


@query(r"SELECT page_id, CASE WHEN ends_with(u, '/v1') THEN u ELSE u || '/v1' END AS endpoint FROM (SELECT page_id, regexp_replace(CASE WHEN page_id % 3 = 0 THEN url || '/v1//' ELSE url || '/' END, '/+$', '') AS u FROM pages)")
def endpoint_normalize(v: Views) -> DataFrame:
    u = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/v1//").otherwise("/"))
    return v.table("pages").select("page_id", T.endpoint(u).alias("endpoint"))


#: The judgments as SQL: of the answers that are JSON and within bounds.
JUDGED = """raw AS (SELECT doc_id, length(coalesce(text, '')) % 8 AS pathway, len(string_split(coalesce(text, ''), '.')) % 5 AS evidence FROM documents),
judged AS (SELECT doc_id, CASE WHEN pathway <= 5 AND doc_id % 11 <> 0 THEN CAST(pathway AS INTEGER) END AS pathway_correctness, CASE WHEN pathway <= 5 AND doc_id % 11 <> 0 THEN CAST(evidence AS INTEGER) END AS evidence_use FROM raw)"""


def judged(v: Views) -> DataFrame:
    """(doc_id, pathway_correctness, evidence_use) from a judge's JSON text about each document, in code fences or not; the stand-in judge
    counts characters and sentences. An answer out of bounds or not JSON counts as none."""
    text = F.coalesce("text", F.lit(""))
    body = F.concat(F.lit('{"claims": [], "pathway_correctness": '), (F.length(text) % 8).cast("string"), F.lit(', "evidence_use": '), (F.size(F.split(text, r"\.")) % 5).cast("string"), F.lit(', "reasoning": "r"}'))
    raw = F.when(F.col("doc_id") % 11 == 0, "no json").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return v.table("documents").select("doc_id", T.judgment(raw).alias("j")).select("doc_id", "j.pathway_correctness", "j.evidence_use")


@query(f"WITH {JUDGED} SELECT *, round(pathway_correctness / 5.0::DOUBLE, 4) AS pathway_score FROM judged")
def judgments(v: Views) -> DataFrame:
    """Judgments read from a judge's answers, with the share of the highest mark for the pathway."""
    return judged(v).withColumn("pathway_score", F.round(F.col("pathway_correctness") / 5, 4))


@query("""SELECT pos, nullif(trim(CASE WHEN pos % 4 = 0 THEN '  ' ELSE ' ' || model || ' ' END), '') AS pred, coalesce(nullif(CASE WHEN pos % 5 <> 0 THEN tokens END, 0), CAST(trunc(latency) AS BIGINT)) AS tokens,
CASE WHEN pos % 3 = 0 THEN CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END ELSE score END::DOUBLE AS score, CASE WHEN pos % 3 = 0 THEN score >= 0.3 ELSE score >= 0.5 END AS pass, round(abs(latency - 10), 2) AS mae,
coalesce(nullif(CASE WHEN pos % 2 = 0 THEN model ELSE '' END, ''), CASE WHEN pos % 3 <> 0 THEN 'meta' END) AS trace FROM cells""")
def cell_extraction(v: Views) -> DataFrame:
    """A log cell: trimmed answer, total or else output tokens, score from a truth value or a number, native trace first."""
    pos = F.col("pos")
    raw = v.cells.select(
        "pos", F.when(pos % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "model", F.lit(" "))).alias("completion"), F.when(pos % 5 != 0, F.col("tokens")).alias("total_tokens"), F.col("latency").cast("long").alias("output_tokens"),
        F.when(pos % 3 == 0, F.col("score") >= 0.3).alias("truth"), F.when(pos % 3 != 0, F.col("score")).alias("number"), F.abs(F.col("latency") - 10).alias("mae"),
        F.when(pos % 2 == 0, F.col("model")).otherwise("").alias("native"), F.when(pos % 3 != 0, "meta").alias("meta"))
    return raw.select("pos", *evals.cell(*[F.col(c) for c in ("completion", "total_tokens", "output_tokens", "truth", "number", "mae", "native", "meta")]))
