"""Splits, p-values, perturbations, reading rules and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.operators import metrics, splits, stats
from gradus.plans.catalogue import query
from gradus.plans.core import DIRECTION, KEPT, labelled
from gradus.plans.views import Views
from gradus.sources import wide
from gradus.streaming import live


@query(f"""WITH RECURSIVE l AS (SELECT acc, {DIRECTION} AS k FROM dx WHERE {KEPT}), c AS (SELECT acc, k, count(*) AS n FROM l GROUP BY ALL), kinds AS (SELECT list(k ORDER BY k) AS ks FROM (SELECT DISTINCT k FROM c)),
p AS (SELECT acc, list(struct_pack(k := k, n := n) ORDER BY k) AS profile, sum(n) AS total FROM c GROUP BY acc),
g AS MATERIALIZED (SELECT acc, list_transform(ks, lambda x: coalesce(list_filter(profile, lambda y: y.k = x)[1].n, 0)) AS n, total, profile, md5(concat_ws('|', '42', 'split', acc)) AS h FROM p, kinds),
t AS (SELECT list(n ORDER BY k) AS n FROM (SELECT k, sum(n) AS n FROM c GROUP BY k)),
s(step, lacking, used) AS (SELECT 0, list_transform(n, lambda x: CAST(round_even(x * 0.2::DOUBLE, 0) AS BIGINT)), CAST([] AS BIGINT[]) FROM t
UNION ALL SELECT step + 1, list_transform(range(1, len(lacking) + 1), lambda i: CAST(lacking[i] - best.n[i] AS BIGINT)), list_append(used, best.acc) FROM (
SELECT step, lacking, used, arg_min(struct_pack(acc := CAST(g.acc AS BIGINT), n := g.n), struct_pack(a := total, w := -g.n[list_position(lacking, list_max(lacking))], b := profile, c := h, d := g.acc)) AS best FROM s, g
WHERE list_max(lacking) > 0 AND NOT list_contains(used, g.acc) AND g.n[list_position(lacking, list_max(lacking))] > 0 GROUP BY ALL)),
u AS (SELECT arg_max(used, step) AS used FROM s) SELECT acc, CASE WHEN list_contains(used, acc) THEN 'test' ELSE 'train' END AS split FROM g, u""")
def greedy_accession_split(v: Views) -> DataFrame:
    return splits.greedy_split(labelled(v), "acc", "direction")


@query("""WITH RECURSIVE c AS (SELECT sample, fmt AS k, count(*) AS n FROM cells GROUP BY ALL), kinds AS (SELECT list(k ORDER BY k) AS ks FROM (SELECT DISTINCT k FROM c)),
p AS (SELECT sample, list(struct_pack(k := k, n := n) ORDER BY k) AS profile FROM c GROUP BY sample),
g AS (SELECT sample, list_transform(ks, lambda x: coalesce(list_filter(profile, lambda y: y.k = x)[1].n, 0)) AS n, list_transform(profile, lambda y: y.k) AS sig, md5(concat_ws('|', '42', 'signature', sample)) AS h FROM p, kinds),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY len(sig) DESC, sig, h) AS place, round_even(count(*) OVER (PARTITION BY sig) * 0.2::DOUBLE, 0) AS quota FROM g),
t AS (SELECT list(n ORDER BY k) AS n FROM (SELECT k, sum(n) AS n FROM c GROUP BY k)),
s(place, room, sig, given, stopped, test) AS (SELECT CAST(0 AS BIGINT), list_transform(n, lambda x: CAST(least(round_even(x * 0.2::DOUBLE, 0), greatest(0, x - 50)) AS BIGINT)), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), false, false FROM t
UNION ALL SELECT place, CASE WHEN fits THEN list_transform(range(1, len(room) + 1), lambda i: CAST(room[i] - n[i] AS BIGINT)) ELSE room END, sig, given + fits::INT, NOT fits, fits FROM (
SELECT o.place, room, o.sig, o.n, CASE WHEN s.sig = o.sig THEN given ELSE 0 END AS given,
NOT (s.sig = o.sig AND stopped) AND CASE WHEN s.sig = o.sig THEN given ELSE 0 END < quota AND list_min(list_transform(range(1, len(room) + 1), lambda i: CASE WHEN o.n[i] = 0 THEN 0 ELSE room[i] - o.n[i] END)) >= 0 AS fits FROM s JOIN o ON o.place = s.place + 1))
SELECT sample, CASE WHEN test THEN 'test' ELSE 'train' END AS split FROM o JOIN s ON s.place = o.place""")
def signature_split(v: Views) -> DataFrame:
    return splits.signature_split(v.cells, "sample", "fmt")


@query("""WITH r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY gold) + (count(*) OVER (PARTITION BY model, gold) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0::DOUBLE AS b FROM evr),
s AS (SELECT model, count(*) AS n, round(CASE WHEN count(DISTINCT a) > 1 AND count(DISTINCT b) > 1 THEN corr(a, b) ELSE 0 END, 6) AS rho FROM r GROUP BY model), t AS (SELECT *, (n - 2)::DOUBLE AS v, abs(rho) * sqrt((n - 2) / nullif(1 - rho * rho, 0)) AS t FROM s),
i AS (SELECT model, n, rho, t, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * (t / 4000) / 3 * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + power(i * t / 4000, 2) / v)) / sqrt(v * pi())) AS half FROM t, generate_series(0, 4000) AS u(i) GROUP BY ALL)
SELECT model, n, rho, round(greatest(0, 1 - 2 * half), 6) AS p FROM i""")
def spearman_pvalue(v: Views) -> DataFrame:
    return metrics.spearman(v.evr, ["model"]).withColumn("p", F.round(stats.correlation_p_value(F.col("rho"), F.col("n")), 6))


#: Tables whose columns get roles.
CLASSIFIED = {"part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "pages": ["page_id", "url", "html"], "documents": ["doc_id", "text", "lang", "source", "n_chars"]}


def _classified_sql() -> str:
    each = [f"SELECT '{t}' AS tab, {i} AS place, '{c}' AS name, count({c}) AS n, count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS numbers FROM {t}" for t, cs in CLASSIFIED.items() for i, c in enumerate(cs)]
    return "WITH c AS (" + " UNION ALL ".join(each) + ") SELECT tab, name, n, numbers, CASE WHEN place = 0 THEN 'sample_id' WHEN numbers > n / 2 THEN 'feature' ELSE 'metadata' END AS role FROM c"


@query(_classified_sql())
def role_classify(v: Views) -> DataFrame:
    """Roles of columns by what their rows hold: the first names the row, of the others those that are mostly numbers are features."""
    role = F.when(F.col("place") == 0, "sample_id").when(F.col("numbers") > F.col("n") / 2, "feature").otherwise("metadata")
    each = [wide.contents(v.table(t).select(*cs)).select(F.lit(t).alias("tab"), "name", "n", "numbers", role.alias("role")) for t, cs in CLASSIFIED.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT vec_id, label, array_to_string(list_transform(embedding[1:200], lambda x: CAST(CAST(round(x::DOUBLE * 100) AS BIGINT) AS VARCHAR)), ',') AS line FROM embeddings ORDER BY vec_id LIMIT 10")
def csv_preview(v: Views) -> DataFrame:
    few = v.table("embeddings").orderBy("vec_id").limit(10)
    return few.select("vec_id", "label", F.array_join(F.transform(F.slice("embedding", 1, 200), lambda x: F.round(x.cast("double") * 100).cast("long").cast("string")), ",").alias("line"))


@query("""WITH few AS (SELECT sample, feature, value FROM feat WHERE sample IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10) AND feature < 200)
SELECT feature, string_agg(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY sample) AS line FROM few GROUP BY feature""")
def csv_preview_200(v: Views) -> DataFrame:
    """The preview of a matrix with a line for each of its first 200 features, its first ten samples as columns."""
    few = v.table("embeddings").select(F.col("vec_id").alias("sample")).orderBy("sample").limit(10)
    rows = v.feat.filter("feature < 200").join(F.broadcast(few), "sample")  # ten rows
    cells = F.sort_array(F.collect_list(F.struct("sample", F.round(F.col("value") * 100).cast("long").cast("string").alias("x"))))
    return rows.groupBy("feature").agg(F.array_join(cells.x, ",").alias("line"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(v: Views) -> DataFrame:
    return live.windowed_counts(v.table("events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
