"""Faithfulness of reasoning texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions import trace as R
from gradus.operators import genes, metrics
from gradus.operators.sampling import settled
from gradus.plans.catalogue import query
from gradus.plans.records import JUDGED, judged
from gradus.plans.views import EFFECTS, Views

#: The oracle's engine takes word boundaries by ASCII alone; other letters become a word sign, other signs a blank, first.
PLAIN = r"regexp_replace(regexp_replace({x}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"
KW_NEG = R.NEGATION.replace("'", "''")


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def hits_sql(name: str, words: list[str], src: str) -> str:
    """CTE (doc_id, c) with the signed hits of all words."""
    return f"""{name}_p AS (SELECT doc_id, lower(t) AS t, w, string_split(lower(t), w) AS parts FROM {src}, (SELECT unnest({sql_list(words)}) AS w) WHERE contains(lower(t), w)),
{name}_o AS (SELECT doc_id, t, w, i, sum(length(parts[i])) OVER (PARTITION BY doc_id, w ORDER BY i) + (i - 1) * length(w) AS off FROM {name}_p, unnest(generate_series(1, len(parts) - 1)) AS u(i)),
{name} AS (SELECT doc_id, sum(CASE WHEN regexp_matches({PLAIN.format(x="substr(t, CAST(greatest(off - 50, 0) AS BIGINT) + 1, CAST(least(50, off) AS BIGINT))")}, '(?i){KW_NEG}') THEN -1 ELSE 1 END) AS c FROM {name}_o GROUP BY doc_id)"""


def named_sql(words: list[str]) -> str:
    return f"len(list_filter({sql_list(words)}, lambda w: contains(lower(t), w)))"


def counts_sql(src: str) -> str:
    return f"""{hits_sql('up', R.UP, src)}, {hits_sql('down', R.DOWN, src)}, {hits_sql('sig', R.SIGNIFICANT, src)},
k AS (SELECT doc_id, t, pred, fmt, CAST(coalesce(up.c, 0) AS INTEGER) AS up, CAST(coalesce(down.c, 0) AS INTEGER) AS down, CAST(coalesce(sig.c, 0) AS INTEGER) AS sig, CAST({named_sql(R.NO_CHANGE)} AS INTEGER) AS none, CAST({named_sql(R.NOT_SIGNIFICANT)} AS INTEGER) AS unsure
FROM {src} LEFT JOIN up USING (doc_id) LEFT JOIN down USING (doc_id) LEFT JOIN sig USING (doc_id))"""


COUNTS = counts_sql("trace")
LETTER = "upper(trim(pred))"
CONSISTENT = f"""CASE WHEN coalesce(t, '') = '' OR coalesce(pred, '') = '' THEN 0.5
 WHEN lower(fmt) IN ('mcq', 'ternary') THEN CASE WHEN up = 0 AND down = 0 AND none = 0 THEN 0.5
 WHEN {LETTER} = 'A' THEN CASE WHEN up > 0 AND up >= down THEN 1.0 WHEN down > 0 AND down > up THEN 0.0 ELSE 0.5 END
 WHEN {LETTER} = 'B' THEN CASE WHEN down > 0 AND down >= up THEN 1.0 WHEN up > 0 AND up > down THEN 0.0 ELSE 0.5 END
 WHEN {LETTER} = 'C' THEN CASE WHEN none > 0 AND abs(up) <= 1 AND abs(down) <= 1 THEN 1.0 WHEN up > 1 OR down > 1 THEN 0.0 ELSE 0.5 END ELSE 0.5 END
 WHEN lower(fmt) = 'binary' THEN CASE WHEN {LETTER} = 'A' THEN CASE WHEN sig > 0 AND unsure = 0 THEN 1.0 WHEN unsure > 0 THEN 0.0 ELSE 0.5 END WHEN {LETTER} = 'B' THEN CASE WHEN unsure > 0 THEN 1.0 WHEN sig > 0 THEN 0.0 ELSE 0.5 END ELSE 0.5 END
 ELSE 0.5 END::DOUBLE"""


def counted(x: DataFrame) -> DataFrame:
    """Hit counts of a frame of texts ``t``; the text is lowered once, and searched once for the words of all lists."""
    low, seen = F.col("low"), F.col("seen")
    x = x.withColumn("low", F.lower("t"))
    x = x.withColumn("seen", R.occurring(low, sorted({*R.UP, *R.DOWN, *R.SIGNIFICANT, *R.NO_CHANGE, *R.NOT_SIGNIFICANT})))
    hits = {name: R.keyword_hits(low, words, seen) for name, words in (("up", R.UP), ("down", R.DOWN), ("sig", R.SIGNIFICANT))}
    named = {name: F.size(F.array_intersect(seen, F.array(*map(F.lit, words)))) for name, words in (("none", R.NO_CHANGE), ("unsure", R.NOT_SIGNIFICANT))}
    return x.withColumns(hits | named).drop("low", "seen")


def consistent(df: DataFrame) -> DataFrame:
    counts = {"up": F.col("up"), "down": F.col("down"), "none": F.col("none"), "sure": F.col("sig"), "unsure": F.col("unsure")}
    return df.withColumn("consistency", R.consistency(F.col("fmt"), F.col("t"), F.col("pred"), counts))


@query(f"WITH {COUNTS} SELECT doc_id, up, down, sig, none, unsure FROM k")
def keyword_hits(v: Views) -> DataFrame:
    return counted(v.trace).select("doc_id", "up", "down", "sig", "none", "unsure")


@query(f"WITH {COUNTS} SELECT doc_id, {CONSISTENT} AS consistency FROM k")
def keyword_consistency(v: Views) -> DataFrame:
    return consistent(counted(v.trace)).select("doc_id", "consistency")


@query(f"WITH {counts_sql('answers')} SELECT doc_id, {CONSISTENT} AS consistency FROM k")
def keyword_dispatch(v: Views) -> DataFrame:
    return consistent(counted(v.answers)).select("doc_id", "consistency")


@query(f"""SELECT doc_id, CASE WHEN fmt <> 'mcq' THEN true WHEN pred = 'A' THEN NOT (d AND NOT u) WHEN pred = 'B' THEN NOT (u AND NOT d) ELSE NOT ((u OR d) AND NOT n) END AS consistent
FROM (SELECT *, {named_sql(R.UP)} > 0 AS u, {named_sql(R.DOWN)} > 0 AS d, {named_sql(R.NO_CHANGE)} > 0 AS n FROM trace)""")
def v1_consistency(v: Views) -> DataFrame:
    low = F.col("low")
    x = v.trace.withColumn("low", F.lower("t")).withColumns({"u": R.named(low, R.UP) > 0, "d": R.named(low, R.DOWN) > 0, "n": R.named(low, R.NO_CHANGE) > 0})
    u, d, n = F.col("u"), F.col("d"), F.col("n")
    return x.select("doc_id", F.when(F.col("fmt") != "mcq", True).when(F.col("pred") == "A", ~(d & ~u)).when(F.col("pred") == "B", ~(u & ~d)).otherwise(~((u | d) & ~n)).alias("consistent"))


def genes_sql(pattern: str, keep: str) -> str:
    return f"list_filter(regexp_extract_all(p, '{pattern}', 1), lambda g: {keep})"


GENES = f"""g AS (SELECT doc_id, t, list_concat(list_concat({genes_sql(R.UPPER_GENE[4:], f"NOT list_contains({sql_list(R.UPPER_STOP)}, g)")}, regexp_extract_all(p, '{R.HYPHEN_GENE[4:]}', 1)),
{genes_sql(R.TITLE_GENE[4:], f"NOT list_contains({sql_list(R.TITLE_STOP)}, g) AND length(g) >= 3")}) AS raw FROM (SELECT doc_id, t, {PLAIN.format(x='t')} AS p FROM trace)),
d AS (SELECT doc_id, t, list_sort(list_distinct(raw)) AS genes FROM g)"""


@query(f"WITH {GENES} SELECT doc_id, array_to_string(genes, ',') AS genes FROM d")
def gene_candidates(v: Views) -> DataFrame:
    return v.trace.select("doc_id", F.array_join(F.sort_array(R.gene_candidates(F.col("t"))), ",").alias("genes"))


@query(f"WITH {GENES} SELECT doc_id, CAST(len(genes) AS INTEGER) AS n, CAST(len(list_filter(genes, lambda g: length(g) >= 2 AND NOT list_contains({sql_list(R.UPPER_STOP)}, upper(g)) AND NOT regexp_full_match(g, '[0-9]+'))) AS INTEGER) AS n_valid FROM d")
def candidate_validity(v: Views) -> DataFrame:
    g = R.gene_candidates(F.col("t"))
    return v.trace.select("doc_id", F.size(g).alias("n"), F.size(F.filter(g, R.valid_symbol)).alias("n_valid"))


USABLE = f"length(g) >= 2 AND NOT list_contains({sql_list(R.UPPER_STOP)}, upper(g)) AND NOT regexp_full_match(g, '[0-9]+')"
NAMES = """names AS (SELECT DISTINCT upper(name) AS key, name AS spelt, alias, list_position([9606, 10090, 10116, 7227, 6239, 4932], taxid) - 1 AS rank, symbol, taxid, entrez_id
FROM (SELECT symbol AS name, 0 AS alias, * EXCLUDE (aliases) FROM symbols UNION ALL SELECT unnest(aliases), 1, * EXCLUDE (aliases) FROM symbols) WHERE list_contains([9606, 10090, 10116, 7227, 6239, 4932], taxid))"""
KNOWN = f"""{NAMES}, e AS (SELECT DISTINCT doc_id, unnest(genes) AS g FROM d), hits AS (SELECT doc_id, count(*) AS k FROM e WHERE {USABLE} AND upper(g) IN (SELECT key FROM names) GROUP BY doc_id),
m AS (SELECT doc_id, len(genes) AS n, coalesce(k, 0) AS k FROM d LEFT JOIN hits USING (doc_id))"""


def known_genes(v: Views, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, genes, known): candidates of each text, and those that the dimension of genes knows."""
    return genes.known_counts(v.trace if texts is None else texts, "doc_id", R.gene_candidates(F.col("t")), v.symbols, R.valid_symbol(F.col("name")))


@query(f"WITH {GENES}, {KNOWN} SELECT doc_id, round(coalesce(k / nullif(n, 0)::DOUBLE, 0.5), 6) AS gene_score FROM m")
def gene_score(v: Views) -> DataFrame:
    """Share of a text's candidates that the dimension knows; one half where there are none."""
    return known_genes(v).select("doc_id", F.round(F.coalesce(F.try_divide(F.col("known").cast("double"), F.col("genes")), F.lit(0.5)), 6).alias("gene_score"))


@query(f"""WITH {GENES}, {NAMES}, a AS (SELECT DISTINCT unnest(genes) AS g FROM d),
b AS (SELECT g, struct_pack(a := alias, o := (g <> spelt)::INT, r := rank) AS close, entrez_id, symbol, taxid FROM a JOIN names ON upper(g) = key WHERE {USABLE}),
f AS (SELECT g, min(struct_pack(c := close, e := entrez_id, s := symbol, t := taxid)) AS f FROM b GROUP BY g),
n AS (SELECT f.g, f, count(DISTINCT b.symbol) AS alike FROM f JOIN b ON b.g = f.g AND b.close = f.f.c GROUP BY ALL)
SELECT a.g AS name, f IS NOT NULL AS verified, f.s AS symbol, CASE f.t WHEN 9606 THEN 'human' WHEN 10090 THEN 'mouse' WHEN 10116 THEN 'rat' WHEN 7227 THEN 'fruitfly' WHEN 6239 THEN 'c_elegans' WHEN 4932 THEN 'yeast' END AS species, f.e AS entrez_id, coalesce(alike > 1, false) AS ambiguous FROM a LEFT JOIN n USING (g)""")
def gene_lookup(v: Views) -> DataFrame:
    """What every candidate of the texts is in the dimension of genes."""
    each = v.trace.select(F.explode(R.gene_candidates(F.col("t"))).alias("name"))
    return genes.looked_up(each, v.symbols, R.valid_symbol(F.col("name")))


PROPERTY = "p AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{g}' AS gene, '{e.lower()}' AS effect, lower(substr(t, CAST(greatest(ofs - 251, 0) AS INTEGER) + 1, CAST(ofs - 1 + {len(g) + 250} - greatest(ofs - 251, 0) AS INTEGER))) AS ctx FROM (SELECT doc_id, t, instr(lower(t), '{g.lower()}') AS ofs FROM trace) WHERE ofs > 0" for g, e in EFFECTS) + ")"
FIRST = lambda words: "coalesce(" + ", ".join(f"nullif(instr(ctx, '{w}'), 0)" for w in words) + ") - 1"
CLAIMED = f"""{PROPERTY}, f AS (SELECT *, {FIRST(R.INDUCES)} AS a, {FIRST(R.INHIBITS)} AS b, length(ctx) // 2 AS mid FROM p),
i AS (SELECT *, a IS NOT NULL AND (b IS NULL OR abs(a - mid) <= abs(b - mid)) AS ind, CASE WHEN a IS NOT NULL AND (b IS NULL OR abs(a - mid) <= abs(b - mid)) THEN a ELSE b END AS ofs FROM f),
c AS (SELECT doc_id, gene, effect, CASE WHEN ofs IS NULL THEN NULL WHEN ind <> (len(list_filter({sql_list(R.SHORT_NEGATION)}, lambda w: contains(substr(ctx, CAST(greatest(ofs - 30, 0) AS INTEGER) + 1, CAST(least(30, ofs) AS INTEGER)), w))) > 0) THEN 'induces' ELSE 'inhibits' END AS claimed FROM i)"""


def claims(v: Views, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, fmt, gene, effect, ctx, claimed) for every annotated gene among a text's candidates.

    Candidates meet the dimension of genes where their texts lie, up to :data:`genes.MOST_NAMES` of its genes; of a larger one what it
    knows goes back to the texts."""
    texts = v.trace if texts is None else texts
    known = v.effects.select("gene", F.upper("gene").alias("upper"), F.lower("effect").alias("effect")).filter(F.col("effect").isin("induces", "inhibits"))
    named, same = F.explode(R.gene_candidates(F.col("t"))).alias("symbol"), F.upper("symbol") == F.col("upper")
    if known.count() <= genes.MOST_NAMES:
        met = texts.select("doc_id", "fmt", "t", named).join(F.broadcast(known), same)
    else:
        met = texts.select("doc_id", named).join(known, same).select("doc_id", "symbol", "gene", "effect").join(texts, "doc_id")
    ctx = F.when(F.col("gene").isNotNull(), R.context(F.col("t"), F.col("symbol")))  # not before the join: only for what is known
    x = met.withColumn("ctx", ctx).filter("ctx IS NOT NULL")
    return x.select("doc_id", "fmt", "gene", "effect", "ctx", R.claimed_direction(F.col("ctx")).alias("claimed"))


@query(f"WITH {PROPERTY} SELECT doc_id, gene, ctx FROM p")
def context_window(v: Views) -> DataFrame:
    return claims(v).select("doc_id", "gene", "ctx")


@query(f"WITH {CLAIMED} SELECT doc_id, gene, claimed FROM c")
def claimed_direction(v: Views) -> DataFrame:
    return claims(v).select("doc_id", "gene", "claimed")


@query(f"WITH {CLAIMED} SELECT gene, effect, count(*) AS n, count(claimed) AS checked, count(*) FILTER (claimed = effect) AS correct, count(*) FILTER (claimed <> effect) AS violated, string_agg(doc_id || ':' || claimed, ',' ORDER BY doc_id) FILTER (claimed <> effect) AS violations FROM c GROUP BY ALL")
def property_join(v: Views) -> DataFrame:
    """Claims by gene of the dimension, with the list of those that contradict it."""
    wrong = F.col("claimed") != F.col("effect")
    listed = F.sort_array(F.collect_list(F.when(wrong, F.struct("doc_id", "claimed"))))
    text = F.array_join(F.transform(listed, lambda x: F.concat(x.doc_id.cast("string"), F.lit(":"), x.claimed)), ",")
    out = claims(v).groupBy("gene", "effect").agg(F.count("*").alias("n"), F.count("claimed").alias("checked"), F.count_if(F.col("claimed") == F.col("effect")).alias("correct"), F.count_if(wrong).alias("violated"), text.alias("violations"))
    return out.withColumn("violations", F.nullif("violations", F.lit("")))


CHECKED = "q AS (SELECT doc_id, count(claimed) AS checked, count(*) FILTER (claimed = effect) AS correct FROM c GROUP BY doc_id)"


def properties(v: Views, texts: DataFrame | None = None) -> DataFrame:
    return claims(v, texts).groupBy("doc_id").agg(F.count("claimed").alias("checked"), F.count_if(F.col("claimed") == F.col("effect")).alias("correct"))


@query(f"WITH {CLAIMED}, {CHECKED} SELECT doc_id, coalesce(checked, 0) AS checked, round(coalesce(correct / nullif(checked, 0)::DOUBLE, 0.5), 6) AS property_score FROM documents LEFT JOIN q USING (doc_id)")
def property_score(v: Views) -> DataFrame:
    share = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("checked")), F.lit(0.5))
    return v.table("documents").select("doc_id").join(properties(v), "doc_id", "left").select("doc_id", F.coalesce("checked", F.lit(0)).alias("checked"), F.round(share, 6).alias("property_score"))


FAITH = f"""{COUNTS}, {GENES}, {KNOWN}, {CLAIMED}, {CHECKED},
parts AS (SELECT k.doc_id, k.fmt, m.n AS genes, m.k AS known, coalesce(m.k / nullif(m.n, 0)::DOUBLE, 0.5) AS gene_score, ({CONSISTENT}) AS consistency, coalesce(checked, 0) AS checked, coalesce(correct, 0) AS correct, coalesce(correct / nullif(checked, 0)::DOUBLE, 0.5) AS property_score
FROM k JOIN m USING (doc_id) LEFT JOIN q USING (doc_id)),
faith AS (SELECT *, round(0.4::DOUBLE * gene_score + 0.2::DOUBLE * consistency + 0.4::DOUBLE * property_score, 4) AS faithfulness FROM parts)"""


def faithful(v: Views, texts: DataFrame | None = None) -> DataFrame:
    """All scores and counts of every text, of the traces or of others like them."""
    texts = v.trace if texts is None else texts
    x = consistent(counted(texts)).withColumn("names", R.gene_candidates(F.col("t"))).select("doc_id", "pred", "fmt", "consistency", "names")
    x = genes.known_counts(x, "doc_id", F.col("names"), v.symbols, R.valid_symbol(F.col("name")), ("pred", "fmt", "consistency"))
    x = x.join(properties(v, texts), "doc_id", "left").withColumns({"checked": F.coalesce("checked", F.lit(0)), "correct": F.coalesce("correct", F.lit(0))})
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.5))
    x = x.withColumns({"gene_score": share("known", "genes"), "property_score": share("correct", "checked")})
    return x.withColumn("faithfulness", R.faithfulness(F.col("gene_score"), F.col("consistency"), F.col("property_score")))


@query(f"WITH {FAITH} SELECT doc_id, faithfulness FROM faith")
def faithfulness(v: Views) -> DataFrame:
    return faithful(v).select("doc_id", "faithfulness")


@query(f"WITH {FAITH} SELECT fmt, count(*) AS n, round(avg(faithfulness), 4) AS mean, round(100 * avg((faithfulness >= 0.5)::INT), 1) AS passed FROM faith GROUP BY fmt")
def faithfulness_by_format(v: Views) -> DataFrame:
    return faithful(v).groupBy("fmt").agg(F.count("*").alias("n"), F.round(F.avg("faithfulness"), 4).alias("mean"), F.round(100 * F.avg((F.col("faithfulness") >= 0.5).cast("int")), 1).alias("passed"))


@query(f"WITH {FAITH} SELECT CAST(least(9, floor(faithfulness * 10)) AS BIGINT) AS bin, CASE WHEN faithfulness < 0.4 THEN 'low' WHEN faithfulness < 0.7 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM faith GROUP BY ALL")
def faithfulness_hist(v: Views) -> DataFrame:
    f = F.col("faithfulness")
    return faithful(v).groupBy(F.least(F.lit(9), F.floor(f * 10)).alias("bin"), F.when(f < 0.4, "low").when(f < 0.7, "mid").otherwise("high").alias("band")).agg(F.count("*").alias("n"))


@query(f"WITH {FAITH} SELECT doc_id, faithfulness FROM faith ORDER BY coalesce(faithfulness, 1), doc_id LIMIT 8")
def lowest_traces(v: Views) -> DataFrame:
    return faithful(v).orderBy(F.coalesce("faithfulness", F.lit(1.0)), "doc_id").limit(8).select("doc_id", "faithfulness")


@query(f"WITH {FAITH} SELECT doc_id, faithfulness FROM faith ORDER BY faithfulness DESC, doc_id LIMIT 10")
def highest_traces(v: Views) -> DataFrame:
    return faithful(v).orderBy(F.desc("faithfulness"), "doc_id").limit(10).select("doc_id", "faithfulness")


SUMMARY = """count(*) AS n, round(avg(faithfulness), 4) AS avg_faithfulness, round(avg(gene_score), 4) AS avg_gene_score, round(avg(consistency), 4) AS avg_consistency, round(avg(property_score), 4) AS avg_property_score,
CAST(sum(checked) AS BIGINT) AS genes_checked, CAST(sum(checked - correct) AS BIGINT) AS violations, count(*) FILTER (consistency > 0.5) AS n_consistent, round(100 * avg((consistency > 0.5)::INT), 1) AS pct_consistent,
CAST(sum(genes) AS BIGINT) AS total_genes, CAST(sum(known) AS BIGINT) AS verified_genes, round(100 * sum(known)::DOUBLE / nullif(sum(genes), 0), 1) AS pct_verified"""


def summarised(x: DataFrame, *by: str) -> DataFrame:
    """Averages, totals and percentages of scored traces."""
    mean = lambda c: F.round(F.avg(c), 4).alias(f"avg_{c}")
    sure = F.col("consistency") > 0.5
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), mean("faithfulness"), mean("gene_score"), mean("consistency"), mean("property_score"), F.sum("checked").alias("genes_checked"), F.sum(F.col("checked") - F.col("correct")).alias("violations"),
        F.count_if(sure).alias("n_consistent"), F.round(100 * F.avg(sure.cast("int")), 1).alias("pct_consistent"), F.sum("genes").cast("long").alias("total_genes"), F.sum("known").cast("long").alias("verified_genes"),
        F.round(F.try_divide(100.0 * F.sum("known"), F.sum("genes")), 1).alias("pct_verified"))


@query(f"WITH {FAITH} SELECT {SUMMARY} FROM faith")
def trace_summary(v: Views) -> DataFrame:
    return summarised(faithful(v))


@query(f"WITH {FAITH} SELECT source, {SUMMARY} FROM faith JOIN documents USING (doc_id) WHERE starts_with(source, 'src1') GROUP BY source")
def task_trace_summary(v: Views) -> DataFrame:
    """Traces of some tasks, by the prefix of their names, summed up again."""
    names = v.table("documents").select("doc_id", "source").filter(F.col("source").startswith("src1"))
    return summarised(faithful(v).join(names, "doc_id"), "source")


RANKED = "rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


@query(f"""WITH {FAITH}, {JUDGED}, s AS (SELECT faithfulness, doc_id, fmt, round((pathway_correctness / 5.0::DOUBLE + evidence_use / 5.0::DOUBLE + property_score) / 3, 6) AS oracle, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS passed,
pathway_correctness / 5.0::DOUBLE AS pathway, evidence_use / 5.0::DOUBLE AS evidence, property_score FROM faith JOIN labels USING (doc_id) JOIN judged USING (doc_id) WHERE pathway_correctness IS NOT NULL),
r AS (SELECT *, {RANKED.format(x='faithfulness')} AS rf, {RANKED.format(x='oracle')} AS ro, {RANKED.format(x='passed')} AS rp FROM s)
SELECT count(*) AS n, round(avg(pathway), 4) AS avg_pathway, round(avg(evidence), 4) AS avg_evidence, round(avg(property_score), 4) AS avg_claim, round(avg(oracle), 4) AS avg_oracle,
round(coalesce(corr(rf, ro), 0), 4) AS cheap_vs_oracle, round(coalesce(corr(ro, rp), 0), 4) AS oracle_vs_correct FROM r""")
def oracle_summary(v: Views) -> DataFrame:
    """Mean marks of judged traces, and two rank correlations: cheap with judged score, judged score with correctness."""
    labels = v.table("labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(0).alias("passed"))
    marks = judged(v).filter("pathway_correctness IS NOT NULL").select("doc_id", (F.col("pathway_correctness") / 5).alias("pathway"), (F.col("evidence_use") / 5).alias("evidence"))
    x = faithful(v).join(labels, "doc_id").join(marks, "doc_id").withColumns({"all": F.lit("all"), "oracle": F.round((F.col("pathway") + F.col("evidence") + F.col("property_score")) / 3, 6)})
    x = settled(x)
    means = x.groupBy("all").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(a) for c, a in (("pathway", "avg_pathway"), ("evidence", "avg_evidence"), ("property_score", "avg_claim"), ("oracle", "avg_oracle"))])
    for a, b, name in (("faithfulness", "oracle", "cheap_vs_oracle"), ("oracle", "passed", "oracle_vs_correct")):
        rho = metrics.rank_correlation(x, ["all"], a, b).select("all", F.round(F.coalesce("rho", F.lit(0.0)), 4).alias(name))
        means = means.join(rho, "all")
    return means.drop("all")


@query(f"""WITH {FAITH}, s AS (SELECT doc_id, faithfulness AS x, (doc_id % 7) AS y FROM faith),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM s) SELECT 'all' AS model, count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def trace_spearman(v: Views) -> DataFrame:
    x = faithful(v).select(F.lit("all").alias("model"), "faithfulness", (F.col("doc_id") % 7).alias("y"))
    return metrics.spearman(x, ["model"], "faithfulness", "y")
