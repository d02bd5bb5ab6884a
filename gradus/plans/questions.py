"""Questions from their templates, baselines by format, perturbed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.functions import perturb, prompts, trace
from gradus.operators import registry
from gradus.operators.metrics import uniform
from gradus.operators.sampling import settled
from gradus.plans.catalogue import query
from gradus.plans.core import labelled
from gradus.plans.drawing import L
from gradus.plans.traces import FAITH, GENES, PLAIN, faithful
from gradus.plans.views import Views


def template_sql(kind: str) -> str:
    """The user message of a kind as an SQL expression over columns of its names."""
    out, rest = [], prompts.TEMPLATES[kind][1]
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [quoted(before), f"coalesce(CAST({name} AS VARCHAR), 'unknown')"]
    return " || ".join([*out, quoted(rest)])


def asked(df: DataFrame, kind: str, key: str, answer) -> DataFrame:
    rows = prompts.with_prompt(df, kind, answer)
    return rows.select(key, F.get("messages", 1).content.alias("question"), F.get("messages", 2).content.alias("gold"))


CONTEXT = "'organ ' || organ AS tissue, 'untreated ' || control_type || ' cells' AS control"


def _context(df: DataFrame) -> DataFrame:
    return df.withColumns({"tissue": F.concat(F.lit("organ "), F.col("organ").cast("string")), "control": prompts.control_text(F.col("control_type"))})


@query(f"WITH {L}, q AS (SELECT rid, treatment, {CONTEXT}, gene, direction FROM l) SELECT rid, {template_sql('direction')} AS question, CASE direction WHEN 'upregulated' THEN 'A' WHEN 'downregulated' THEN 'B' ELSE 'C' END AS gold FROM q")
def direction_questions(v: Views) -> DataFrame:
    gold = F.when(F.col("direction") == "upregulated", "A").when(F.col("direction") == "downregulated", "B").otherwise("C")
    return asked(_context(labelled(v)), "direction", "rid", gold)


@query(f"WITH {L}, q AS (SELECT rid, treatment, {CONTEXT}, gene, logfc, p FROM l) SELECT rid, {template_sql('significance')} AS question, CASE WHEN abs(logfc) > 1 AND p < 0.05 THEN 'A' ELSE 'B' END AS gold FROM q")
def significance_questions(v: Views) -> DataFrame:
    return asked(_context(labelled(v)), "significance", "rid", F.when((F.abs("logfc") > 1) & (F.col("p") < 0.05), "A").otherwise("B"))


@query(f"""WITH {L}, e AS (SELECT comparison, arg_max(gene, (abs(logfc), rid)) AS gene_a, arg_min(gene, (abs(logfc), rid)) AS gene_b, min(treatment) AS treatment, min(control_type) AS control_type, min(organ) AS organ FROM l GROUP BY comparison),
q AS (SELECT *, {CONTEXT} FROM e) SELECT comparison, {template_sql('pair')} AS question, 'A' AS gold FROM q""")
def pair_questions(v: Views) -> DataFrame:
    """Of each comparison the gene that changes most against the one that changes least."""
    size = F.struct(F.abs("logfc"), F.col("rid"))
    e = labelled(v).groupBy("comparison").agg(F.max_by("gene", size).alias("gene_a"), F.min_by("gene", size).alias("gene_b"), F.min("treatment").alias("treatment"), F.min("control_type").alias("control_type"), F.min("organ").alias("organ"))
    return asked(_context(e), "pair", "comparison", F.lit("A"))


PERSON = "SELECT c_custkey, (['female', 'male'])[CAST(c_custkey % 2 AS INTEGER) + 1] AS sex, CASE WHEN c_nationkey > 0 THEN 20 + c_nationkey * 3 END AS age, 'balance: ' || printf('%.4g', c_acctbal / pi()) AS profile, c_mktsegment FROM customer"


def _persons(v: Views) -> DataFrame:
    profile = prompts.profile_text(F.array(F.struct(F.lit("balance").alias("name"), (F.col("c_acctbal") / F.pi()).alias("value"))))
    return v.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "female").otherwise("male").alias("sex"), F.when(F.col("c_nationkey") > 0, 20 + F.col("c_nationkey") * 3).alias("age"), profile.alias("profile"), "c_mktsegment")


@query(f"WITH q AS ({PERSON}) SELECT c_custkey, {template_sql('age_bracket')} AS question, CASE WHEN age < 40 THEN 'A' WHEN age < 60 THEN 'B' WHEN age < 80 THEN 'C' ELSE 'D' END AS gold FROM q")
def age_bracket_questions(v: Views) -> DataFrame:
    a = F.col("age")
    return asked(_persons(v), "age_bracket", "c_custkey", F.when(a < 40, "A").when(a < 60, "B").when(a < 80, "C").otherwise("D"))


@query(f"WITH q AS ({PERSON}) SELECT c_custkey, {template_sql('condition')} AS question, CASE WHEN c_mktsegment = 'BUILDING' THEN 'A' ELSE 'B' END AS gold FROM q")
def condition_questions(v: Views) -> DataFrame:
    return asked(_persons(v), "condition", "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "A").otherwise("B"))


@query(f"""WITH d AS (SELECT p_partkey, p_type AS metadata, p_name AS genera, p_brand AS metabolites, p_size FROM part), n AS (SELECT d.*, variant FROM d, (SELECT unnest(['metadata', 'microbiome', 'metabolome', 'combined', 'full']) AS variant)),
q AS (SELECT p_partkey, variant, p_size, CASE WHEN variant IN ('metadata', 'full') THEN metadata END AS metadata, CASE WHEN variant IN ('microbiome', 'combined', 'full') THEN genera END AS genera, CASE WHEN variant IN ('metabolome', 'combined', 'full') THEN metabolites END AS metabolites FROM n)
SELECT p_partkey || ':' || variant AS item, {template_sql('disease')} AS question, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS gold FROM q""")
def disease_questions(v: Views) -> DataFrame:
    """Five variants of each question, which differ in the parts that they show."""
    p = v.table("part").select("p_partkey", "p_size", F.col("p_type").alias("metadata"), F.col("p_name").alias("genera"), F.col("p_brand").alias("metabolites"))
    rows = prompts.variants(p).withColumn("item", F.concat_ws(":", F.col("p_partkey").cast("string"), "variant"))
    return asked(rows, "disease", "item", F.when(F.col("p_size") % 2 == 0, "A").otherwise("B"))


@query("""WITH s AS (SELECT p_partkey, p_name, p_brand, p_size, (['OIS', 'DDIS', 'REP', 'dNTP', 'OSKM', 'X'])[p_size % 6 + 1] AS kind, (['none', 'Ras', 'OIS', ''])[p_size % 4 + 1] AS sub, (['OIS', 'DDIS', 'Z'])[p_size % 3 + 1] AS control, CASE WHEN p_size % 5 <> 0 THEN p_size END AS reps,
CASE WHEN p_size % 7 = 0 THEN p_type END AS analysis, (['none', 'TP53', 'nan', 'RB1'])[p_size % 4 + 1] AS down, (['MYC', '', 'none'])[p_size % 3 + 1] AS up FROM part),
t AS (SELECT *, CASE kind WHEN 'OIS' THEN 'oncogene-induced senescence' WHEN 'DDIS' THEN 'DNA damage-induced senescence' WHEN 'REP' THEN 'replicative senescence' WHEN 'dNTP' THEN 'dNTP depletion-induced senescence' WHEN 'OSKM' THEN 'reprogramming-induced senescence' ELSE kind END
  || CASE WHEN sub NOT IN ('none', '', 'nan') AND sub <> kind THEN ' (' || sub || ')' ELSE '' END AS model,
  CASE control WHEN 'OIS' THEN 'untreated oncogene-induced senescent cells' WHEN 'DDIS' THEN 'untreated DNA damage-induced senescent cells' ELSE 'untreated ' || control || ' cells' END AS untreated,
  concat_ws('; ', CASE WHEN down NOT IN ('none', 'nan', '') THEN 'lowered: ' || down END, CASE WHEN up NOT IN ('none', 'nan', '') THEN 'raised: ' || up END) AS genes FROM s)
SELECT p_partkey, '<experiment>' || chr(10) || concat_ws(' ', 'Cells: WI-38 fibroblasts.', 'Model: ' || model || '.', 'Treatment: treatment with ' || p_name || '.', 'Control: ' || untreated || '.', 'Replicates: ' || reps || '.', 'Analysis: ' || analysis || '.') || chr(10) || '</experiment>'
  || CASE WHEN genes <> '' THEN chr(10) || '<gene_context>' || chr(10) || 'Genes changed on purpose: ' || genes || '.' || chr(10) || '</gene_context>' ELSE '' END AS block,
  p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_brand || ')' ELSE '' END AS gene, CASE WHEN p_size % 2 = 0 THEN 'RNA-seq' ELSE 'microarray' END AS assay FROM t""")
def experiment_blocks(v: Views) -> DataFrame:
    size = F.col("p_size")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), size % len(xs) + 1)
    none = F.lit(None).cast("string")
    model = prompts.senescence_text(pick("OIS", "DDIS", "REP", "dNTP", "OSKM", "X"), pick("none", "Ras", "OIS", ""))
    block = prompts.experiment_block(
        prompts.tissue_text(F.lit("none"), F.lit("WI38")), model, F.concat(F.lit("treatment with "), "p_name"), prompts.control_text(pick("OIS", "DDIS", "Z")), F.when(size % 5 != 0, size), F.when(size % 7 == 0, F.col("p_type")),
        pick("none", "TP53", "nan", "RB1"), pick("MYC", "", "none"))
    return v.table("part").select("p_partkey", block.alias("block"), prompts.gene_text(F.col("p_name"), F.when(size % 2 == 0, F.col("p_brand")).otherwise(none)).alias("gene"), prompts.assay_text(F.when(size % 2 == 0, "R").otherwise("M")).alias("assay"))


@query("""SELECT rid, printf('%s: log2FC %.4f, p %.2e.', CAST(dx.gene AS VARCHAR), logfc, p) || ' Source: GSE' || acc || '.' || CASE WHEN organ % 2 = 0 THEN ' ' || dx.gene || ' induces senescence' || CASE WHEN organ = 2 THEN ' (OIS)' ELSE '' END || '.' ELSE '' END || CASE WHEN acc % 3 = 0 THEN ' Reference: ' || acc || '.' ELSE '' END AS follow_up FROM dx""")
def follow_up_sentences(v: Views) -> DataFrame:
    c, text = F.col, lambda x: F.col(x).cast("string")
    return v.dx.select("rid", prompts.follow_up(text("gene"), c("logfc"), c("p"), F.concat(F.lit("GSE"), text("acc")), F.when(c("organ") % 2 == 0, "Induces"), F.when(c("organ") == 2, "OIS").otherwise("Unclear"), F.when(c("acc") % 3 == 0, text("acc"))).alias("follow_up"))


HASH = "('0x' || substr(md5(concat_ws('|', '42', 'random', doc_id)), 1, 8))::BIGINT"


@query(f"""WITH r AS (SELECT CAST(trunc(min(gold)) AS BIGINT) AS lo, CAST(trunc(max(gold)) AS BIGINT) AS hi FROM evr)
SELECT doc_id, CASE lower(fmt) WHEN 'mcq' THEN (['A', 'B', 'C'])[CAST({HASH} % 3 AS INTEGER) + 1] WHEN 'regression' THEN CAST(lo + {HASH} % (hi - lo + 1) AS VARCHAR) ELSE (['A', 'B'])[CAST({HASH} % 2 AS INTEGER) + 1] END AS pred FROM answers, r""")
def random_by_format(v: Views) -> DataFrame:
    """Uniform guesses from the letters of a format; whole numbers between the ends of the training targets for regression."""
    ends = v.evr.agg(F.min("gold").cast("long").alias("lo"), F.max("gold").cast("long").alias("hi"))
    u = lambda n: uniform(F.concat_ws("|", F.lit("42"), F.lit("random"), "doc_id"), n)
    letter = lambda xs: F.element_at(F.array(*map(F.lit, xs)), u(F.lit(len(xs))).cast("int") + 1)
    kind = F.lower("fmt")
    pred = F.when(kind == "mcq", letter("ABC")).when(kind == "regression", (F.col("lo") + u(F.col("hi") - F.col("lo") + 1)).cast("string")).otherwise(letter("AB"))
    return v.answers.join(F.broadcast(ends)).select("doc_id", pred.alias("pred"))  # one row


CENSUS = "c AS (SELECT p_partkey % 3 AS sex, CASE WHEN p_size = 50 THEN 999 ELSE p_size * 2 END AS age, count(*) AS w FROM part GROUP BY ALL), k AS (SELECT sex, age, sum(w) OVER (PARTITION BY sex ORDER BY age) AS hi, sum(w) OVER (PARTITION BY sex ORDER BY age) - w AS lo, sum(w) OVER (PARTITION BY sex) AS total FROM c WHERE age BETWEEN 20 AND 90 AND age <> 999)"


@query(rf"""WITH {CENSUS}, m AS (SELECT conv_id, (['... Sex: Male ...', 'sex :FEMALE', 'none'])[CAST(conv_id % 3 AS INTEGER) + 1] AS t, CASE WHEN conv_id % 5 = 0 THEN 'binary' ELSE 'regression' END AS fmt FROM msgs),
s AS (SELECT conv_id, fmt, CASE lower(regexp_extract(t, '(?i)sex\s*:\s*(male|female)', 1)) WHEN 'male' THEN 1 WHEN 'female' THEN 2 ELSE 0 END AS sex, ('0x' || substr(md5(concat_ws('|', '42', 'prior', conv_id)), 1, 8))::BIGINT AS h FROM m)
SELECT conv_id, CASE WHEN fmt = 'regression' THEN CAST(age AS VARCHAR) ELSE (['A', 'B'])[CAST(h % 2 AS INTEGER) + 1] END AS pred FROM s JOIN k ON k.sex = s.sex AND h % total >= lo AND h % total < hi""")
def population_prior_by_sex(v: Views) -> DataFrame:
    """Ages drawn by the weights of the sex that the messages name, of both where they name none; letters for other formats."""
    age = F.when(F.col("p_size") == 50, 999).otherwise(F.col("p_size") * 2)
    w = v.table("part").groupBy((F.col("p_partkey") % 3).cast("int").alias("sex"), age.alias("age")).agg(F.count("*").alias("w")).filter(F.col("age").between(20, 90) & (F.col("age") != 999))
    up = Window.partitionBy("sex").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)  # a row per age
    steps = w.withColumn("hi", F.sum("w").over(up)).withColumn("lo", F.col("hi") - F.col("w"))
    table = steps.groupBy("sex").agg(F.sort_array(F.collect_list(F.struct("lo", "age"))).alias("steps"), F.max("hi").alias("total"))
    said = F.element_at(F.array(*map(F.lit, ["... Sex: Male ...", "sex :FEMALE", "none"])), (F.col("conv_id") % 3).cast("int") + 1)
    m = v.msgs.select("conv_id", F.concat(F.lit("x\n"), said).alias("t"), F.when(F.col("conv_id") % 5 == 0, "binary").otherwise("regression").alias("fmt"))
    m = m.withColumn("sex", prompts.sex_code(F.col("t")))
    u = lambda n: uniform(F.concat_ws("|", F.lit("42"), F.lit("prior"), "conv_id"), n)
    drawn = m.join(F.broadcast(table), "sex").withColumn("u", u(F.col("total")))  # three rows
    picked = F.element_at(F.filter("steps", lambda s: s.lo <= F.col("u")), -1).age.cast("string")
    letter = F.element_at(F.array(F.lit("A"), F.lit("B")), u(F.lit(2)).cast("int") + 1)
    return drawn.select("conv_id", F.when(F.col("fmt") == "regression", picked).otherwise(letter).alias("pred"))


def _flipped_sql() -> str:
    x = "t"
    for word, mark, _ in perturb.swaps():
        x = f"regexp_replace({x}, '(?i)\\b{word}\\b', chr({ord(mark)}), 'g')"
    for _, mark, other in perturb.swaps():
        x = f"replace({x}, chr({ord(mark)}), '{other}')"
    return x


@query(f"SELECT doc_id, sha256({_flipped_sql()}) AS sha FROM trace")
def perturb_flip(v: Views) -> DataFrame:
    return v.trace.select("doc_id", F.sha2(perturb.flipped(F.col("t")).cast("binary"), 256).alias("sha"))


def _wrong_sql(most: int = 2, among: int = 4) -> str:
    steps = ["s0 AS (SELECT doc_id, t, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS gs, 0 AS used FROM g)"]
    fakes = "[" + ", ".join(f"'{f}'" for f in perturb.FAKE_GENES) + "]"
    for k in range(1, among + 1):
        plain = PLAIN.format(x="t")
        hit = f"used < {most} AND len(gs) >= {k} AND regexp_matches({plain}, '\\b' || gs[{k}] || '\\b') AND gs[{k}] <> ({fakes})[used + 1]"
        at = f"length(regexp_replace({plain}, '(?s)\\b' || gs[{k}] || '\\b.*$', ''))"
        steps.append(f"s{k} AS (SELECT doc_id, CASE WHEN {hit} THEN left(t, {at}) || ({fakes})[used + 1] || substr(t, {at} + length(gs[{k}]) + 1) ELSE t END AS t, gs, CASE WHEN {hit} THEN used + 1 ELSE used END AS used FROM s{k - 1})")
    return f"WITH {GENES}, " + ",\n".join(steps) + f" SELECT doc_id, sha256(t) AS sha FROM s{among}"


@query(_wrong_sql())
def perturb_wrong_gene(v: Views) -> DataFrame:
    t = F.col("t")
    return v.trace.select("doc_id", F.sha2(perturb.wrong_genes(t, trace.gene_candidates(t)).cast("binary"), 256).alias("sha"))


def _wrong_text_sql() -> str:
    """CTEs that end in ``wrong`` (doc_id, t, pred, fmt): the traces with made-up genes."""
    steps = _wrong_sql().removeprefix("WITH ").rsplit(" SELECT doc_id, sha256(t) AS sha FROM s4", 1)[0]
    return f"wrong AS (WITH {steps} SELECT s4.doc_id, s4.t, pred, fmt FROM s4 JOIN trace USING (doc_id))"


def _scored_sql(src: str) -> str:
    """Faithfulness of the texts of a view, by the SQL of the traces' own."""
    return f"SELECT * FROM (WITH trace AS (SELECT * FROM {src}), {FAITH} SELECT doc_id, fmt, faithfulness FROM faith)"


@query(f"""WITH given AS MATERIALIZED (SELECT * FROM trace), {_wrong_text_sql()}, flipped AS (SELECT doc_id, {_flipped_sql()} AS t, pred, fmt FROM trace),
a AS ({_scored_sql('given')}), b AS ({_scored_sql('wrong')}), c AS ({_scored_sql('flipped')}),
x AS (SELECT a.fmt, a.faithfulness AS before, 'wrong_gene' AS change, b.faithfulness AS after FROM a JOIN b USING (doc_id) UNION ALL SELECT a.fmt, a.faithfulness, 'flipped_direction', c.faithfulness FROM a JOIN c USING (doc_id))
SELECT change, fmt, count(*) AS n, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, round(avg(before - after), 6) AS mean_drop, CASE WHEN avg(before - after) >= 0.15 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x GROUP BY ALL""")
def perturbation_report(v: Views) -> DataFrame:
    """Faithfulness of every text before and after a change of its genes or of its directions: a mean drop of 0.15 passes."""
    t, texts = F.col("t"), v.trace
    changed = {"wrong_gene": texts.withColumn("t", perturb.wrong_genes(t, trace.gene_candidates(t))), "flipped_direction": texts.withColumn("t", perturb.flipped(t))}
    before = settled(faithful(v).select("doc_id", "fmt", F.col("faithfulness").alias("before")))
    each = [before.join(faithful(v, x).select("doc_id", F.col("faithfulness").alias("after")), "doc_id").withColumn("change", F.lit(name)) for name, x in changed.items()]
    drop = F.avg(F.col("before") - F.col("after"))
    return each[0].unionByName(each[1]).groupBy("change", "fmt").agg(F.count("*").alias("n"), F.round(F.avg("before"), 6).alias("mean_before"), F.round(F.avg("after"), 6).alias("mean_after"), F.round(drop, 6).alias("mean_drop"), F.when(drop >= 0.15, "PASS").otherwise("FAIL").alias("verdict"))


@query(f"""WITH {FAITH}, j AS (SELECT *, coalesce(correct / nullif(checked, 0)::DOUBLE, 0.5) AS claim, least(1, genes / 10.0::DOUBLE) AS pathway FROM faith)
SELECT doc_id, round((0.4::DOUBLE * gene_score + 0.3::DOUBLE * consistency) / 0.7::DOUBLE, 4) AS v1, round(0.3::DOUBLE * gene_score + 0.2::DOUBLE * claim + 0.2::DOUBLE * consistency + 0.3::DOUBLE * pathway, 4) AS v2 FROM j""")
def older_faithfulness(v: Views) -> DataFrame:
    """Both older scores of every text: the first from genes and consistency, the second with claims, and with the genes named, ten at
    most, for what a judge says of the pathway."""
    x = faithful(v).withColumn("pathway", F.least(F.lit(1.0), F.col("genes") / 10))
    return x.select("doc_id", F.round((0.4 * F.col("gene_score") + 0.3 * F.col("consistency")) / 0.7, 4).alias("v1"), F.round(0.3 * F.col("gene_score") + 0.2 * F.col("property_score") + 0.2 * F.col("consistency") + 0.3 * F.col("pathway"), 4).alias("v2"))


@registry.task("priorities", metric="off-by-one accuracy")
def priorities(spark: SparkSession, path: str) -> DataFrame:
    """Orders as questions of five letters."""
    return Views(spark, path).ev.select("id", F.col("task").alias("segment"), F.concat(F.lit("priority of "), F.col("id").cast("string")).alias("prompt"), "gold")


@query("""WITH m AS (SELECT gold AS pred FROM ev GROUP BY gold ORDER BY count(*) DESC, gold LIMIT 1), a AS (SELECT task AS segment, 'majority' AS solver, gold, m.pred FROM ev, m
UNION ALL SELECT task, 'random letter', gold, (['A', 'B', 'C'])[CAST(('0x' || substr(md5(concat_ws('|', '42', 'random', id)), 1, 8))::BIGINT % 3 AS INTEGER) + 1] FROM ev)
SELECT solver, segment, round(avg(CASE abs(ascii(gold) - ascii(pred)) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE), 6) AS off_by_one_accuracy FROM a GROUP BY ALL""")
def registered_evaluation(v: Views) -> DataFrame:
    """A registered task, answered by two registered solvers, counted by its own metric."""
    each = [registry.evaluate(v.spark, "priorities", s, v.dir, by=["segment"]).select(F.lit(s).alias("solver"), "segment", "off_by_one_accuracy") for s in ("majority", "random letter")]
    return each[0].unionByName(each[1])
