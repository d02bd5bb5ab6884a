"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, chat, embed_dedup, importance, jaccard, langid, negatives, packing, quality, substring_dedup, topk, url_filter, word_bpe
from gradus.llm.common import id_hash_mod

#: The rules of the url query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The conversation that the chat query adds.
EXTRA_TURNS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

OP1_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, c) AS (SELECT a, least(a, b) FROM links UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(comp.c, vec_id) AS component_id, coalesce(comp.c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.id = vec_id
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ids=False)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS lo FROM s GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM s JOIN m USING (g) WHERE lo < doc_id),
k AS (SELECT d.doc_id, u.i, d.w[u.i] AS word FROM d, unnest(generate_series(1, len(d.w))) AS u(i)),
a AS (SELECT k.doc_id, count(*) FILTER (h.i IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY k.i) FILTER (h.i IS NULL) AS kept
  FROM k LEFT JOIN h ON h.doc_id = k.doc_id AND h.i = k.i GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    chats = chat.format_chat(rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = chats.withColumn("read", chat.read_back(F.col("formatted"), F.col("turns")))
    loss = F.array_join(F.transform(F.filter("read", lambda x: x.loss.isNotNull()), lambda x: x.loss), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<turn|</turn|<part')) AS body,
    length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '<turn|</turn|<part'))
    + 6 * (length(role) - length(replace(role, chr(10), ''))) AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + head + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_hash_mod("doc_id", 4) == 2
    return langid.predict(docs, langid.fit(docs, ~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP6_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = id_hash_mod("doc_id", 5) == 0
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


OP8_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END)) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 90 * (u.n + v.n - k)),
r(id, c) AS (SELECT a, least(a, b) FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id
"""


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, r.verdict, h || q AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(q) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2) AS BIGINT))), lambda a, b: xor(a >> 8, crc[CAST(xor(a & 255, b) AS INT) + 1]))"

OP11_SQL = rf"""
WITH RECURSIVE step(i, k, v) AS (SELECT i, 0, i FROM range(0, 256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM step WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT unnest(w) AS w, 1 AS s, 0 AS t FROM d UNION ALL SELECT unnest(w), 0, 1 FROM b),
c AS MATERIALIZED (SELECT w, sum(s) AS s, sum(t) AS t FROM f GROUP BY w),
h AS MATERIALIZED (SELECT w, s, t, xor({_CRC}, 4294967295) % 10000 AS bucket FROM c, crc),
g AS (SELECT bucket, CAST(floor(1000 * ln((sum(t)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM h)::DOUBLE + 10000)
  / ((sum(s)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM h)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM h GROUP BY bucket),
x AS (SELECT doc_id, sum(gain) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM d) JOIN h USING (w) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)::DOUBLE + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= (SELECT count(*) FROM y WHERE n_features >= 20) * 10 // 100 THEN k END AS rank FROM r
"""


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND {_USABLE}),
s AS MATERIALIZED (SELECT a.id AS a, c.id AS c, a.l = c.l AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.id % 50 = 0 AND a.id <> c.id AND len(a.e) = len(c.e)),
p AS (SELECT a, c AS p, score AS ps FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a, p, ps, c, score, CAST(row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, c) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps)
SELECT a AS anchor_id, p AS positive_id, rank, c AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_language_id": op5_language_id,
        "op6_exact_topk": op6_exact_topk,
        "op7_quality": op7_quality,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_best_fit": op9_best_fit,
        "op10_url_rules": op10_url_rules,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_word_bpe": op12_word_bpe,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "op6_exact_topk": OP6_SQL, "op8_ngram_jaccard": OP8_SQL, "op10_url_rules": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_hard_negatives": OP13_SQL}
