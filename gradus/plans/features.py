"""Wide matrices in long form, top features, validation of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions import text as T
from gradus.functions.labels import modality, task_group, truthy
from gradus.operators import sampling
from gradus.plans.catalogue import query
from gradus.plans.views import Views

NAMED = ["p_size", "p_retailprice"]


@query("SELECT p_partkey, k AS feature, CASE k WHEN 'p_size' THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS value FROM part, (VALUES ('p_size'), ('p_retailprice')) AS t(k)")
def unpivot_transpose(v: Views) -> DataFrame:
    wide = v.table("part").select("p_partkey", *[F.col(c).cast("double") for c in NAMED])
    return wide.unpivot("p_partkey", NAMED, "feature", "value")


@query("SELECT sample, label, count(*) AS n, round(sum(value), 4) AS total FROM feat JOIN documents ON sample = doc_id GROUP BY ALL")
def inner_join_samples(v: Views) -> DataFrame:
    return v.feat.join(v.table("documents").select(F.col("doc_id").alias("sample")), "sample").groupBy("sample", "label").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) AND vec_id IN (SELECT doc_id FROM labels)")
def three_way_intersect(v: Views) -> DataFrame:
    ids = v.table("embeddings").select("vec_id")
    for t in ("documents", "labels"):
        ids = ids.join(v.table(t).select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return ids


TOP = "t AS (SELECT sample, feature, row_number() OVER (PARTITION BY sample ORDER BY value DESC, feature) AS rn FROM feat)"


@query(f"WITH {TOP} SELECT sample, string_agg(CAST(feature AS VARCHAR), ',' ORDER BY rn) AS top FROM t WHERE rn <= 10 GROUP BY sample")
def top10_features(v: Views) -> DataFrame:
    """Ten largest values per row; the row's array is sorted where it lies."""
    pairs = F.transform("embedding", lambda x, i: F.struct((-x.cast("double")).alias("x"), i.alias("i")))
    top = F.slice(F.sort_array(pairs), 1, 10)
    return v.table("embeddings").select(F.col("vec_id").alias("sample"), F.array_join(F.transform(top, lambda t: t.i.cast("string")), ",").alias("top"))


@query("""WITH n AS (SELECT sample, feature % 20 AS name, max(value) AS value FROM feat GROUP BY ALL), t AS (SELECT sample, name, row_number() OVER (PARTITION BY sample ORDER BY value DESC, name) AS rn FROM n)
SELECT sample, string_agg(CAST(name AS VARCHAR), ',' ORDER BY rn) AS top FROM t WHERE rn <= 10 GROUP BY sample""")
def top10_distinct_names(v: Views) -> DataFrame:
    """As before, over names that several features share; the largest of a name counts."""
    n = v.feat.groupBy("sample", (F.col("feature") % 20).alias("name")).agg(F.max("value").alias("value"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("value")).alias("x"), "name"))), 1, 10)
    return n.groupBy("sample").agg(F.array_join(F.transform(best, lambda t: t["name"].cast("string")), ",").alias("top"))


@query("SELECT model AS variant, count(*) AS n, count(*) FILTER (gold = 'A') AS n_a, count(*) FILTER (gold = 'B') AS n_b FROM evb GROUP BY model")
def variant_manifest(v: Views) -> DataFrame:
    return v.evb.groupBy(F.col("model").alias("variant")).agg(F.count("*").alias("n"), F.count_if(F.col("gold") == "A").alias("n_a"), F.count_if(F.col("gold") == "B").alias("n_b"))


@query("""SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier)) AS missing, (SELECT count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem)) AS extra""")
def variant_set_equality(v: Views) -> DataFrame:
    a, b = v.table("lineitem").select(F.col("l_suppkey").alias("k")), v.table("supplier").select(F.col("s_suppkey").alias("k"))
    both = a.distinct().withColumn("a", F.lit(True)).join(b.distinct().withColumn("b", F.lit(True)), "k", "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


KINDS = ["lipid maf", "genus table", "gene tpm", "olink npx", "nhanes blood", "other"]


@query("""WITH k AS (SELECT p_partkey, p_name || ' ' || (['lipid maf', 'genus table', 'gene tpm', 'olink npx', 'nhanes blood', 'other'])[CAST(p_partkey % 6 AS INTEGER) + 1] AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(t, 'hmdb|metabolite|lipid|maf|metabolom') THEN 'metabolomics' WHEN regexp_matches(t, 'genus|species|otu|asv|microbi|taxa') THEN 'metagenomics'
WHEN regexp_matches(t, 'ensg|ensembl|tpm|fpkm|gene|transcript|rna') THEN 'transcriptomics' WHEN regexp_matches(t, 'protein|olink|npx|proteom') THEN 'proteomics'
WHEN regexp_matches(t, 'clinical|nhanes|blood|wbc|hemoglobin|creatinine') THEN 'clinical' ELSE 'unknown' END AS modality FROM k""")
def modality_infer(v: Views) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 6).cast("int") + 1)
    return v.table("part").select("p_partkey", modality(F.concat_ws(" ", "p_name", kind)).alias("modality"))


@query("""WITH j AS (SELECT *, n_nationkey IS NOT NULL AS met FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END, n_name) AS label,
'{"segment":"' || CASE WHEN met AND c_custkey % 4 <> 0 THEN c_mktsegment || ' II' ELSE c_mktsegment END || '","nation":"' || CASE WHEN met AND c_custkey % 5 <> 0 THEN n_name ELSE '' END || '","key":"' || CASE WHEN met AND c_custkey % 7 = 0 THEN 'seven' ELSE CAST(c_custkey AS VARCHAR) END || '"'
|| CASE WHEN met THEN ',"region":"' || n_regionkey || '"' ELSE '' END || CASE WHEN met AND c_custkey % 7 = 0 THEN ',"seven":"yes"' ELSE '' END || '}' AS metadata FROM j""")
def metadata_merge(v: Views) -> DataFrame:
    """A label is filled in only where it is null; metadata are laid over each other, blanks cover nothing."""
    c = v.table("customer").withColumn("label", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    n = v.table("nation").filter("n_nationkey < 20").withColumnRenamed("n_nationkey", "c_nationkey")
    x, k = c.join(F.broadcast(n), "c_nationkey", "left"), F.col("c_custkey")  # 25 rows by definition
    own = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.lit(""), F.lit("key"), k.cast("string"))
    met = F.col("n_name").isNotNull()
    found = F.when(met, F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("nation"), F.when(k % 5 != 0, F.col("n_name")).otherwise("  "), F.lit("segment"), F.when(k % 4 != 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" II ")))))
    seven = F.when(met & (k % 7 == 0), F.create_map(F.lit("key"), F.lit("seven"), F.lit("seven"), F.lit("yes"), F.lit("region"), F.lit("")))
    return x.select("c_custkey", F.coalesce("label", "n_name").alias("label"), F.to_json(T.overlaid(own, found, seven)).alias("metadata"))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 50 = 1 THEN 'x' ELSE CAST(c_nationkey * 6 AS VARCHAR) END AS age FROM customer), n AS (SELECT *, TRY_CAST(age AS DOUBLE) AS x FROM a)
SELECT count(*) FILTER (age IS NULL) AS n_null, count(*) FILTER (age IS NOT NULL AND x IS NULL) AS n_text, count(*) FILTER (x < 0 OR x > 130) AS n_out, min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean,
array_to_string(list_sort(list(c_custkey) FILTER (x < 0 OR x > 130))[1:5], ',') AS first_out FROM n""")
def age_validation(v: Views) -> DataFrame:
    age = F.when(F.col("c_custkey") % 50 == 0, F.lit(None)).when(F.col("c_custkey") % 50 == 1, "x").otherwise((F.col("c_nationkey") * 6).cast("string"))
    n = v.table("customer").select("c_custkey", age.alias("age")).withColumn("x", F.col("age").try_cast("double"))
    out = (F.col("x") < 0) | (F.col("x") > 130)
    sums = n.agg(F.count_if(F.col("age").isNull()).alias("n_null"), F.count_if(F.col("age").isNotNull() & F.col("x").isNull()).alias("n_text"), F.count_if(out).alias("n_out"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.round(F.avg("x"), 6).alias("mean"))
    first = n.filter(out).orderBy("c_custkey").limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda i: i.cast("string")), ",").alias("first_out"))
    return sums.join(F.broadcast(first))  # one row each


@query("SELECT c_custkey, CASE WHEN starts_with(nullif(g, ''), 'Lipidomics') THEN 'Lipidomics' WHEN nullif(g, '') IS NOT NULL THEN g WHEN starts_with(k, 'LB-SEN') THEN 'Senescence' WHEN starts_with(k, 'LB-LIP') THEN 'Lipidomics' WHEN starts_with(k, 'LB-MET') THEN 'Metabolomics' ELSE 'Other' END AS task_group, coalesce(nullif(g, ''), k) AS shown FROM (SELECT c_custkey, (['', 'Lipidomics age', 'Other set', ''])[CAST(c_custkey % 4 AS INTEGER) + 1] AS g, (['LB-SEN-1', 'LB-LIP-2', 'LB-MET-3', 'X'])[CAST(c_custkey % 7 % 4 AS INTEGER) + 1] AS k FROM customer)")
def task_group_normalize(v: Views) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    g = pick(["", "Lipidomics age", "Other set", ""], F.col("c_custkey") % 4)
    k = pick(["LB-SEN-1", "LB-LIP-2", "LB-MET-3", "X"], F.col("c_custkey") % 7 % 4)
    return v.table("customer").select("c_custkey", task_group(g, k).alias("task_group"), truthy(g, k).alias("shown"))


@query("SELECT label, count(DISTINCT sample) AS n, round(avg(value), 4) AS mean, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM feat GROUP BY label")
def pool_stats(v: Views) -> DataFrame:
    return v.feat.groupBy("label").agg(F.countDistinct("sample").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 6).alias("lo"), F.round(F.max("value"), 6).alias("hi"))


@query("SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(concat_ws('|', '42', 'smoke', p_partkey)), p_partkey) = 1")
def one_per_format(v: Views) -> DataFrame:
    return sampling.cap_per_group(v.table("part"), ["p_type"], 1, "smoke", "p_partkey").select("p_type", "p_partkey")
