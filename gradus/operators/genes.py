"""Look-up of gene symbols and aliases in a dimension of many species.

A dimension has a row per gene: symbol, aliases, taxid, entrez_id. Its index has a row per name, in upper case. A candidate that
has several genes takes the first by: symbol before alias, same spelling before another case, species in the order of
:data:`SPECIES`, smaller entrez_id. It is ambiguous if genes of other symbols are as good up to the species. Candidates are
looked up once each, however often texts name them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import labels

#: Species that are looked up, in the order of precedence.
SPECIES = {9606: "human", 10090: "mouse", 10116: "rat", 7227: "fruitfly", 6239: "c_elegans", 4932: "yeast"}
#: Most names of an index that are broadcast; a larger one is shuffled by name.
MOST_NAMES = 500_000


def name_index(dimension: DataFrame) -> DataFrame:
    """(key, name, alias, rank, symbol, species, entrez_id): a row per name of every gene of a known species."""
    rank = F.coalesce(*[F.when(F.col("taxid") == t, i) for i, t in enumerate(SPECIES)])
    genes = dimension.withColumn("rank", rank).filter("rank IS NOT NULL AND symbol <> ''")
    names = F.array_union(F.array(F.struct(F.col("symbol").alias("name"), F.lit(0).alias("alias"))), F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "")), lambda a: F.struct(a.alias("name"), F.lit(1).alias("alias"))))
    rows = genes.withColumn("n", F.explode(names)).select("n.name", "n.alias", "rank", "symbol", labels.species(F.col("taxid")).alias("species"), "entrez_id")
    return rows.select(F.upper("name").alias("key"), "*").distinct()


def looked_up(candidates: DataFrame, dimension: DataFrame, usable: Column | None = None, most: int = MOST_NAMES) -> DataFrame:
    """(name, verified, symbol, species, entrez_id, ambiguous) of every distinct name among ``candidates`` (name); what is not ``usable`` is
    not looked up."""
    names = candidates.select("name").distinct()
    index = name_index(dimension).withColumnRenamed("name", "spelt")
    asked = names.filter(usable) if usable is not None else names
    met = asked.join(F.broadcast(index) if index.count() <= most else index, F.upper("name") == F.col("key"))
    close = F.struct("alias", (F.col("name") != F.col("spelt")).cast("int").alias("other"), "rank")
    best = met.groupBy("name").agg(F.min(F.struct(close.alias("close"), "entrez_id", "symbol", "species")).alias("b"), F.collect_set(F.struct(close.alias("close"), "symbol")).alias("all"))
    alike = F.size(F.array_distinct(F.transform(F.filter("all", lambda x: x.close == F.col("b.close")), lambda x: x.symbol)))
    found = best.select(F.col("name").alias("_name"), "b.symbol", "b.species", "b.entrez_id", (alike > 1).alias("ambiguous"))
    out = names.join(found, F.col("name") == F.col("_name"), "left")
    return out.select("name", F.col("_name").isNotNull().alias("verified"), "symbol", "species", "entrez_id", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def known_counts(texts: DataFrame, key: str, names: Column, dimension: DataFrame, usable: Column | None = None, more: tuple[str, ...] = (), most: int = MOST_NAMES) -> DataFrame:
    """(key, more, genes, known): how many distinct candidates each text has, and how many of them the dimension knows; one without
    candidates has zeros. ``more`` names further columns of the texts to keep.

    Each text is read once: its candidates meet the names of the dimension, and only counts are summed by key."""
    index = name_index(dimension).select(F.col("key").alias("_known")).distinct()
    each = texts.select(key, *more, F.array_distinct(names).alias("_names")).select(key, *more, F.explode_outer("_names").alias("name"))
    asked = F.upper("name") if usable is None else F.when(usable, F.upper("name"))
    met = each.withColumn("_asked", asked).join(F.broadcast(index) if index.count() <= most else index, F.col("_asked") == F.col("_known"), "left")
    return met.groupBy(*[F.col(c) for c in (key, *more)]).agg(F.count("name").cast("int").alias("genes"), F.count("_known").alias("known"))
