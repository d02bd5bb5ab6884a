"""Corpus pipeline: language ID, quality, near-duplicates, repeated passages, packing.

Every stage takes the documents that its predecessor kept and, but for the last, returns the columns of documents. Extra
columns of the documents pass through all filters, whatever their names. The first two stages judge each row where it lies,
by its own text; the third sends the keys of what goes, not texts; the fourth cuts texts where they lie, but for those that
have something to cut.

A document is a pair of doc_id and text: rows under one id with different texts, or without an id, are documents of their own,
judged one by one. In the order of documents null ids come last, and texts under one id go by their md5. Null and empty
texts have no language and go in the first stage. Repeated rows are one document, of which the third stage keeps one row. An
empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import jaccard, langid, packing, quality, substring_dedup
from gradus.llm.common import Scratch, dropped, id_hash_mod, picked, stored

#: A document goes whose best language has a smaller mean posterior than this, or that has no letter.
LEAST_LANGUAGE = 0.5
#: Most keys of documents to drop that are broadcast; more are shuffled.
MOST_IDS = 1_000_000


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be new."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """``docs`` with a key of each row's document, in the order of documents; the key's name; whether rows repeat a document.

    The key is the doc_id where every row has one of its own; else a number given to the sorted pairs of id and text."""
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if n["rows"] == n["ids"]:
        return docs, "doc_id", False
    key, text = _fresh(docs, "key"), F.md5(F.col("text").cast("binary"))
    pairs = stored(docs.groupBy("doc_id", text.alias("_m")).agg(F.count("*").alias("_n")), "pairs")
    order = pairs.orderBy(F.asc_nulls_last("doc_id"), F.asc_nulls_first("_m"))
    keys = stored(order.select(F.col("doc_id").alias("_id"), F.col("_m").alias("_md5"), F.monotonically_increasing_id().alias("_k")), "keys")  # rises along the order
    met = docs.select(F.struct(*docs.columns).alias("_row")).join(keys, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.md5(F.col("_row.text").cast("binary")).eqNullSafe(F.col("_md5")))
    return met.select("_row.*", F.col("_k").alias(key)), key, (pairs.agg(F.max("_n")).first()[0] or 0) > 1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter, or no language that most of the words speak for."""
    lang, score = _fresh(docs, "lang_pred"), _fresh(docs, "score")
    model = langid.fit(docs, ~(id_hash_mod("doc_id", 4) == 2))
    judged = langid.labelled(docs, model, lang_pred=lang, score=score)
    return judged.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE)).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; a label counts for all texts of its id."""
    score, predicted = _fresh(docs, "score"), _fresh(docs, "predicted")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~(id_hash_mod("doc_id", 5) == 0))
    return quality.scored(docs, model, score=score, predicted=predicted).filter(F.col(predicted) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by a Jaccard similarity of 0.8 over five-word shingles, and one row of it."""
    keyed, key, repeated = _keyed(docs)
    with Scratch(spark) as scratch:
        judged = jaccard.near_duplicates(keyed.select(F.col(key).alias("id"), "text"), n=5, num=80, den=100, key="id")
        gone = scratch.result(judged.filter("id <> component_id").select("id").distinct(), "gone")
    once = keyed.dropDuplicates([key]) if repeated else keyed
    return picked(once, gone, "left_anti", MOST_IDS, key).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 13 words and more that an earlier document holds; the rest of a text stays as it is."""
    keyed, key, _ = _keyed(docs)
    removed = _fresh(keyed, "removed")
    out = substring_dedup.trimmed(keyed, key=key, removed=removed)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.best_fit(docs)


STAGES = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", pack),
]

#: Trained stages cannot be put into SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to the documents; each stage's rows are stored and read again as the next one's, then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with Scratch(spark) as scratch:
            kept = scratch.result(stage(spark, docs, sf_dir), "stage")
        if k:
            dropped(docs)
        docs = kept
    out = STAGES[-1][1](spark, docs, sf_dir)  # holds its own stored pieces
    dropped(docs)
    return out
