"""Question templates: one table of texts, one renderer that fills them from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions.text import significant_digits

#: Texts by question kind; ``{name}`` stands for a column. Wording is this library's own.
TEMPLATES = {
    "direction": ("You judge gene expression experiments.", "Experiment: {treatment} on {tissue}, compared with {control}.\nGene: {gene}\nDoes its expression go up, go down, or not change?\nA. up\nB. down\nC. no significant change"),
    "pair": ("You judge gene expression experiments.", "Experiment: {treatment} on {tissue}, compared with {control}.\nGene A: {gene_a}\nGene B: {gene_b}\nWhich gene's expression changes more?"),
    "significance": ("You judge gene expression experiments.", "Experiment: {treatment} on {tissue}, compared with {control}.\nGene: {gene}\nIs the change significant?\nA. yes\nB. no"),
    "age_bracket": ("You read molecular profiles.", "Sex: {sex}\nProfile: {profile}\nIn which bracket is the person's age?\nA. 20-39\nB. 40-59\nC. 60-79\nD. 80+"),
    "age": ("You read molecular profiles.", "Sex: {sex}\nProfile: {profile}\nHow old is the person, in years?"),
    "condition": ("You read molecular profiles.", "Sex: {sex}, age: {age}\nProfile: {profile}\nDoes the person have the condition?\nA. yes\nB. no"),
    "disease": ("You read multi-omics samples.", "Metadata: {metadata}\nTop genera: {genera}\nTop metabolites: {metabolites}\nA. disease\nB. control"),
}
#: Parts that each variant of the disease question shows.
VARIANTS = {"metadata": ["metadata"], "microbiome": ["genera"], "metabolome": ["metabolites"], "combined": ["genera", "metabolites"], "full": ["metadata", "genera", "metabolites"]}
# Conditions and cell lines in words.
SENESCENCE = {"OIS": "oncogene-induced senescence", "DDIS": "DNA damage-induced senescence", "REP": "replicative senescence", "dNTP": "dNTP depletion-induced senescence", "OSKM": "reprogramming-induced senescence"}
CELL_LINES = {"IMR": "IMR-90", "WI38": "WI-38", "MRC": "MRC-5", "MRC5": "MRC-5", "Tig3": "TIG-3"}
CONTROLS = {"OIS": "untreated oncogene-induced senescent cells", "DDIS": "untreated DNA damage-induced senescent cells", "REP": "untreated replicatively senescent cells"}
DRUGS = ["rapamycin", "rotenone", "digoxin", "ouabain", "JQ1", "TSA", "ARV825", "CCCP", "Celecoxib", "digoxin_caspase_inhibitor", "clobetasol", "ouabain_caspase_inhibitor", "3deazaadenosine", "compoundA", "Y27632", "KU60019", "Y27632_KU60019"]


def named(x: Column, names: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in names.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def given(x: Column) -> Column:
    """Null for every spelling of a missing value."""
    return F.when(~F.coalesce(x, F.lit("")).isin("", "none", "nan"), x)


def tissue_text(organ: Column, line: Column) -> Column:
    name = named(line, CELL_LINES, line)
    return F.concat_ws(" ", name, F.lower(given(organ)), F.lit("fibroblasts"))


def control_text(control: Column) -> Column:
    return named(control, CONTROLS, F.concat(F.lit("untreated "), control, F.lit(" cells")))


def senescence_text(kind: Column, subtype: Column) -> Column:
    base = named(kind, SENESCENCE, kind)
    sub = given(subtype)
    return F.when(sub.isNotNull() & (sub != kind), F.concat(base, F.lit(" ("), sub, F.lit(")"))).otherwise(base)


def treatment_text(t: Column, dose: Column, down: Column, up: Column) -> Column:
    """Method by how the treatment is written, target from the gene columns first."""
    down, up = given(down), given(up)
    target = F.coalesce(down, up)
    of = lambda words, rest: F.concat(F.lit(words), F.coalesce(target, rest))
    without = lambda part: F.replace(t, F.lit(part), F.lit(""))
    text = (
        F.when(t.isin(DRUGS), F.concat(F.lit("treatment with "), t, F.coalesce(F.concat(F.lit(" (targeting "), target, F.lit(")")), F.lit(""))))
        .when(t.startswith("si"), of("siRNA knockdown of ", F.substring(t, 3, 1000)))
        .when(t.rlike("^[sS]h"), of("shRNA knockdown of ", F.substring(t, 3, 1000)))
        .when(F.lower(t).contains("sh") & t.contains("pLKO"), of("shRNA knockdown of ", F.element_at(F.split(t, "sh"), -1)))
        .when(t.endswith("_CRISPR"), of("CRISPR knockout of ", without("_CRISPR")))
        .when(t.endswith("_OE"), of("overexpression of ", without("_OE")))
        .when(t.startswith("LNA"), of("LNA antisense inhibition of ", without("LNA")))
        .when(down.isNotNull() & up.isNull(), F.concat(F.lit("knockdown of "), down))
        .when(up.isNotNull() & down.isNull(), F.concat(F.lit("overexpression of "), up))
        .otherwise(F.concat(F.lit("treatment with "), t))
    )
    return F.concat(text, F.coalesce(F.concat(F.lit(" at dose "), given(dose)), F.lit("")))


def profile_text(features: Column) -> Column:
    """``name: value`` of an array of (name, value) structs with four significant digits; nulls are left out."""
    kept = F.filter(features, lambda f: f.value.isNotNull())
    return F.array_join(F.transform(kept, lambda f: F.concat(f["name"], F.lit(": "), significant_digits(f.value))), ", ")


def rendered(kind: str) -> Column:
    """The user message of a kind, from the columns it names; a null column shows as ``unknown``."""
    out, rest = [], TEMPLATES[kind][1]
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), F.coalesce(F.col(name).cast("string"), F.lit("unknown"))]
    return F.concat(*out, F.lit(rest))


def with_prompt(df: DataFrame, kind: str, answer: Column) -> DataFrame:
    """Adds messages: system, user and the gold answer."""
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.cast("string").alias("content"))
    return df.withColumn("messages", F.array(m("system", F.lit(TEMPLATES[kind][0])), m("user", rendered(kind)), m("assistant", answer)))


def variants(df: DataFrame) -> DataFrame:
    """One row per variant of the disease question, with the parts it does not show as null."""
    rows = df.withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    parts = sorted({p for v in VARIANTS.values() for p in v})
    return rows.withColumns({p: F.when(F.col("variant").isin([v for v, shown in VARIANTS.items() if p in shown]), F.col(p)) for p in parts})


def gene_text(gene: Column, name: Column) -> Column:
    """A gene with its full name where that is known."""
    return F.concat(gene, F.coalesce(F.concat(F.lit(" ("), given(name), F.lit(")")), F.lit("")))


def assay_text(kind: Column) -> Column:
    return F.when(kind == "R", "RNA-seq").otherwise("microarray")


def experiment_block(cells: Column, model: Column, treatment: Column, control: Column, replicates: Column, analysis: Column, down: Column, up: Column) -> Column:
    """The experiment between tags, and the genes that its treatment changes between tags of their own; missing parts are left out."""
    part = lambda words, x: F.concat(F.lit(words), x.cast("string"), F.lit("."))
    text = F.concat_ws(" ", part("Cells: ", cells), part("Model: ", model), part("Treatment: ", treatment), part("Control: ", control), part("Replicates: ", replicates), part("Analysis: ", given(analysis)))
    genes = F.concat_ws("; ", F.concat(F.lit("lowered: "), given(down)), F.concat(F.lit("raised: "), given(up)))
    context = F.when(genes != "", F.concat(F.lit("\n<gene_context>\nGenes changed on purpose: "), genes, F.lit(".\n</gene_context>")))
    return F.concat(F.lit("<experiment>\n"), text, F.lit("\n</experiment>"), F.coalesce(context, F.lit("")))


def follow_up(gene: Column, logfc: Column, p: Column, accession: Column, effect: Column, kind: Column, reference: Column) -> Column:
    """What is known about an answer: change with four digits, p-value in scientific notation, source and annotation."""
    sort = F.when(~given(kind).isin("Unclear"), F.concat(F.lit(" ("), kind, F.lit(")")))
    known = F.concat(gene, F.lit(" "), F.lower(given(effect)), F.lit(" senescence"), F.coalesce(sort, F.lit("")), F.lit("."))
    return F.concat_ws(" ", F.format_string("%s: log2FC %.4f, p %.2e.", gene, logfc, p), F.concat(F.lit("Source: "), accession, F.lit(".")), known, F.concat(F.lit("Reference: "), given(reference), F.lit(".")))


def sex_code(text: Column) -> Column:
    """1 for male, 2 for female as the first mention of the sex says, 0 without one."""
    said = F.lower(F.regexp_extract(text, r"(?i)sex\s*:\s*(male|female)", 1))
    return F.when(said == "male", 1).when(said == "female", 2).otherwise(0)
