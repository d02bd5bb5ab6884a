"""Labels and categories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ternary_label(logfc: Column, p: Column, size: float = 1.0, level: float = 0.05) -> Column:
    """Direction of change; both limits are strict, nulls are no change."""
    sure = p < level
    return F.when((logfc > size) & sure, "upregulated").when((logfc < -size) & sure, "downregulated").otherwise("no_change")


def significance_label(logfc: Column, p: Column, size: float = 1.0, level: float = 0.05) -> Column:
    return F.when((F.abs(logfc) > size) & (p < level), "significant").otherwise("not_significant")


def bracket(x: Column, edges: list[float], names: list[str]) -> Column:
    """Left-closed buckets; null outside of all."""
    out = F.lit(None).cast("string")
    for lo, hi, name in zip(edges[:-1], edges[1:], names):
        out = F.when((x >= lo) & (x < hi), name).otherwise(out)
    return out


def treatment_filter(treatment: Column, control: Column, controls: list[str]) -> Column:
    """An intervention on a listed control; a null treatment passes."""
    return ~treatment.eqNullSafe("none") & control.isin(*controls)


def ordinal(letter: Column) -> Column:
    """A is 0, B is 1, ...; null for anything but one of A to Z."""
    return F.when(letter.rlike("^[A-Z]$"), F.ascii(letter) - 65)


def truthy(*options: Column) -> Column:
    """First option that is neither null nor empty."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options])


def task_group(group: Column, item: Column) -> Column:
    """Group of a task: a lipidomics name, any given group, else by the id's prefix."""
    given = F.nullif(group, F.lit(""))
    return F.when(given.startswith("Lipidomics"), "Lipidomics").when(given.isNotNull(), given).when(item.startswith("LB-SEN"), "Senescence").when(item.startswith("LB-LIP"), "Lipidomics").when(item.startswith("LB-MET"), "Metabolomics").otherwise("Other")


#: Keywords of each modality, in order of precedence.
MODALITIES = [
    ("metabolomics", ["hmdb", "metabolite", "lipid", "maf", "metabolom"]),
    ("metagenomics", ["genus", "species", "otu", "asv", "microbi", "taxa"]),
    ("transcriptomics", ["ensg", "ensembl", "tpm", "fpkm", "gene", "transcript", "rna"]),
    ("proteomics", ["protein", "olink", "npx", "proteom"]),
    ("clinical", ["clinical", "nhanes", "blood", "wbc", "hemoglobin", "creatinine"]),
]


def modality(text: Column) -> Column:
    out = F.lit("unknown")
    for name, words in reversed(MODALITIES):
        out = F.when(F.lower(text).rlike("|".join(words)), name).otherwise(out)
    return out


#: Species by taxonomy id.
SPECIES = {9606: "human", 10090: "mouse", 10116: "rat", 7227: "fruitfly", 6239: "c_elegans", 4932: "yeast"}


def species(taxid: Column) -> Column:
    """Name of a species; ``other`` for an unlisted id, ``unknown`` for none."""
    out = F.lit("other")
    for k, name in SPECIES.items():
        out = F.when(taxid == k, name).otherwise(out)
    return F.when(F.coalesce(taxid, F.lit(0)) == 0, "unknown").otherwise(out)
