"""Stand-in views: the driver tables in the roles of experiments, annotations, predictions, features and traces.

Each view exists twice, as a DataFrame and as SQL for the oracle, from the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statements that the trace view appends, by doc_id modulo their number.
CLAIMS = [
    "Expression is increased and strongly elevated.",
    "It does not increase; levels are reduced and lower.",
    "There was no significant difference between groups.",
    "FOXO3 induces senescence while daf-2 and Trp53 are suppressed.",
    "The effect is negligible. THE answer is B, not C.",
    "GENE7 inhibits senescence without change, a robust and marked result.",
]


#: The annotated genes of the stand-in texts.
EFFECTS = [("FOXO3", "Induces"), ("GENE7", "Induces"), ("daf-2", "Induces"), ("Trp53", "Inhibits")]
#: The species of the stand-in dimension of genes, one of them unknown.
TAXA = [9606, 10090, 10116, 7227, 6239, 4932, 5]
#: Formats and answers that the dispatch has to tell apart.
KINDS = ["mcq", "binary", "TERNARY", "pairwise", "regression", "other", None]
ANSWERS = ["A", " b ", "C", "", None]


class Views:
    """Views over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def dx(self) -> DataFrame:
        """Differential expression: one row per (comparison, gene) measurement."""
        line, supplier, nation = self.table("lineitem"), self.table("supplier"), self.table("nation")
        joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)  # 25 rows by definition
        return joined.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.unix_date(F.to_date("l_shipdate"))).alias("rid"),
            F.col("l_suppkey").alias("comparison"), F.col("l_partkey").alias("gene"),
            ((F.col("l_discount") - 0.05) * 40).alias("logfc"), F.col("l_tax").alias("p"),
            F.when(F.col("l_returnflag") == "N", "none").otherwise(F.col("l_returnflag")).alias("treatment"),
            F.col("l_linestatus").alias("control_type"), F.col("s_nationkey").alias("acc"), F.col("n_regionkey").alias("organ"),
        )

    @property
    def anno(self) -> DataFrame:
        """Gene annotation with repeated genes; pos is the file order."""
        effect = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "Induces").when(F.col("p_type").isin("SMALL", "LARGE"), "Inhibits").otherwise("Unclear")
        return self.table("part").select((F.col("p_partkey") % 1500).alias("gene"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), effect.alias("effect"), F.when(F.col("p_size") % 2 == 0, "No").otherwise("Yes").alias("cancer"))

    @property
    def ev(self) -> DataFrame:
        """Ordinal multiple-choice predictions."""
        orders, customer = self.table("orders"), self.table("customer")
        x = F.col("o_totalprice")
        pred = F.when(x < 100000, "A").when(x < 200000, "B").when(x < 300000, "C").when(x < 400000, "D").otherwise("E")
        return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
            F.col("o_orderkey").alias("id"), F.translate(F.substring("o_orderpriority", 1, 1), "12345", "ABCDE").alias("gold"), pred.alias("pred"),
            F.col("o_orderstatus").alias("model"), F.col("c_mktsegment").alias("task"))

    @property
    def evb(self) -> DataFrame:
        """Binary predictions."""
        letter = lambda c: F.when(F.col(c) == 1, "A").otherwise("B")
        return self.table("labels").join(self.table("documents"), "doc_id").select(F.col("doc_id").alias("id"), letter("quality").alias("gold"), letter("toxic").alias("pred"), F.col("lang").alias("model"), F.col("source").alias("format"))

    @property
    def evr(self) -> DataFrame:
        """Regression predictions."""
        return self.table("lineitem").select(F.col("l_quantity").alias("gold"), (F.col("l_extendedprice") / 2100).alias("pred"), F.col("l_returnflag").alias("model"))

    @property
    def cells(self) -> DataFrame:
        """Sample by model cells in log order."""
        return self.table("events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("model"), F.col("user_id").alias("sample"), F.col("value").alias("latency"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), (F.col("event_id") % 4).alias("fmt"), (F.get_json_object("props", "$.k").cast("long") / 100).alias("score"))

    @property
    def msgs(self) -> DataFrame:
        """Conversations as ordered message arrays."""
        m = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
        return self.table("conversations").groupBy("conv_id").agg(m.alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("m"))

    @property
    def trace(self) -> DataFrame:
        """Reasoning texts with a predicted letter and format."""
        claims = F.element_at(F.array(*map(F.lit, CLAIMS)), (F.col("doc_id") % len(CLAIMS)).cast("int") + 1)
        return self.table("documents").select("doc_id", F.concat_ws(" ", "text", claims).alias("t"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("doc_id") % 3).cast("int") + 1).alias("pred"), F.when(F.col("doc_id") % 2 == 0, "mcq").otherwise("binary").alias("fmt"))

    @property
    def effects(self) -> DataFrame:
        """Annotated genes with the effect of each: the four that the claims name."""
        return self.spark.createDataFrame(EFFECTS, "gene string, effect string")

    @property
    def symbols(self) -> DataFrame:
        """A dimension of genes: the capitalised words of the benchmark, each with the next one as its alias, and the annotated genes."""
        words = self.table("benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Z][A-Za-z0-9]{2,})"), 1).alias("c"))
        each = words.select("item_id", "c", F.posexplode("c").alias("i", "symbol"))
        taxid = F.element_at(F.array(*map(F.lit, TAXA)), (F.col("item_id") % len(TAXA)).cast("int") + 1)
        alias = F.array_compact(F.array(F.get("c", F.col("i") + 1)))
        own = self.spark.createDataFrame([(g, [g.upper()], TAXA[k % 2], -k) for k, (g, _) in enumerate(EFFECTS, 1)], "symbol string, aliases array<string>, taxid int, entrez_id long")
        return each.select("symbol", alias.alias("aliases"), taxid.alias("taxid"), (F.col("item_id") * 1000 + F.col("i")).alias("entrez_id")).unionByName(own)

    @property
    def answers(self) -> DataFrame:
        """The traces with every format, missing and padded answers, missing and empty texts."""
        pick = lambda xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (F.col("doc_id") % len(xs)).cast("int") + 1)
        text = F.when(F.col("doc_id") % 13 == 7, F.lit(None)).when(F.col("doc_id") % 13 == 8, "").otherwise(F.col("t"))
        return self.trace.select("doc_id", text.alias("t"), pick(ANSWERS).alias("pred"), pick(KINDS).alias("fmt"))

    @property
    def feat(self) -> DataFrame:
        """Long features: (sample, label, feature, value)."""
        return self.table("embeddings").select(F.col("vec_id").alias("sample"), "label", F.posexplode("embedding").alias("i", "x")).select("sample", "label", F.col("i").alias("feature"), F.col("x").cast("double").alias("value"))


SQL = {
    "dx": """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS rid,
  l_suppkey AS comparison, l_partkey AS gene, (l_discount - CAST(0.05 AS DOUBLE)) * 40 AS logfc, l_tax AS p, CASE WHEN l_returnflag = 'N' THEN 'none' ELSE l_returnflag END AS treatment,
  l_linestatus AS control_type, s_nationkey AS acc, n_regionkey AS organ
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "anno": """SELECT p_partkey % 1500 AS gene, p_partkey AS pos, p_name AS name, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'Induces' WHEN p_type IN ('SMALL', 'LARGE') THEN 'Inhibits' ELSE 'Unclear' END AS effect,
  CASE WHEN p_size % 2 = 0 THEN 'No' ELSE 'Yes' END AS cancer FROM part""",
    "ev": """SELECT o_orderkey AS id, translate(substr(o_orderpriority, 1, 1), '12345', 'ABCDE') AS gold,
  CASE WHEN o_totalprice < 100000 THEN 'A' WHEN o_totalprice < 200000 THEN 'B' WHEN o_totalprice < 300000 THEN 'C' WHEN o_totalprice < 400000 THEN 'D' ELSE 'E' END AS pred,
  o_orderstatus AS model, c_mktsegment AS task FROM orders JOIN customer ON o_custkey = c_custkey""",
    "evb": """SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'A' ELSE 'B' END AS gold, CASE WHEN toxic = 1 THEN 'A' ELSE 'B' END AS pred, lang AS model, source AS format FROM labels JOIN documents USING (doc_id)""",
    "evr": """SELECT l_quantity AS gold, l_extendedprice / 2100 AS pred, l_returnflag AS model FROM lineitem""",
    "cells": """SELECT event_id AS pos, event_type AS model, user_id AS sample, value AS latency, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens, event_id % 4 AS fmt, CAST(json_extract(props, '$.k') AS BIGINT) / 100 AS score FROM events""",
    "msgs": """SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id""",
    "trace": "SELECT doc_id, concat_ws(' ', text, ([" + ", ".join("'" + c.replace("'", "''") + "'" for c in CLAIMS) + "])[CAST(doc_id % 6 AS INTEGER) + 1]) AS t, (['A', 'B', 'C'])[CAST(doc_id % 3 AS INTEGER) + 1] AS pred, CASE WHEN doc_id % 2 = 0 THEN 'mcq' ELSE 'binary' END AS fmt FROM documents",
    "answers": "SELECT doc_id, CASE WHEN doc_id % 13 = 7 THEN NULL WHEN doc_id % 13 = 8 THEN '' ELSE t END AS t, (['A', ' b ', 'C', '', NULL])[CAST(doc_id % 5 AS INTEGER) + 1] AS pred, (['mcq', 'binary', 'TERNARY', 'pairwise', 'regression', 'other', NULL])[CAST(doc_id % 7 AS INTEGER) + 1] AS fmt FROM trace",
    "symbols": f"""SELECT c[i] AS symbol, CASE WHEN i < len(c) THEN [c[i + 1]] ELSE [] END AS aliases, ({TAXA})[CAST(item_id % {len(TAXA)} AS INTEGER) + 1] AS taxid, item_id * 1000 + i - 1 AS entrez_id
  FROM (SELECT item_id, regexp_extract_all(text, '([A-Z][A-Za-z0-9]{{2,}})', 1) AS c FROM benchmark), unnest(generate_series(1, len(c))) AS u(i) UNION ALL """ + " UNION ALL ".join(f"SELECT '{g}', ['{g.upper()}'], {TAXA[k % 2]}, {-k}" for k, (g, _) in enumerate(EFFECTS, 1)),
    "feat": """SELECT vec_id AS sample, label, CAST(i - 1 AS INTEGER) AS feature, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)""",
}
