"""Answer extraction and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions import text as T
from gradus.plans.catalogue import query
from gradus.plans.views import Views

LAST = r"nullif(regexp_extract({x}, '^(?s:(?:.*[^A-Za-z])?([A-F])(?:[^A-Za-z].*)?)$', 1), '')"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {LAST.format(x='t')} AS letter FROM trace")
def last_letter(v: Views) -> DataFrame:
    return v.trace.select("doc_id", T.last_letter(F.col("t")).alias("letter"))


@query(f"SELECT doc_id, coalesce({LAST.format(x='t')}, nullif(substr(upper(regexp_replace(t, '^\\s+', '')), 1, 1), '')) AS letter FROM trace")
def letter_with_fallback(v: Views) -> DataFrame:
    return v.trace.select("doc_id", T.letter_or_first(F.col("t")).alias("letter"))


@query(r"SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(-?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS number FROM documents")
def first_number(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.first_number(F.col("text")).alias("number"))


@query(r"""WITH n AS (SELECT doc_id, regexp_extract_all(text, '-?\d+(?:\.\d+)?')[-1] AS x FROM documents)
SELECT doc_id, coalesce(CAST(TRY_CAST(round_even(TRY_CAST(x AS DOUBLE), 0) AS BIGINT) AS VARCHAR), x, '0') AS answer FROM n""")
def last_number_rounded(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.last_number_rounded(F.col("text")).alias("answer"))


@query(r"""SELECT conv_id, turn, regexp_replace(lower(trim(trim(regexp_replace('  "' || role || chr(10) || '  x"  ', '^\s+|\s+$', '', 'g'), '"'), '''')), '\s+', ' ', 'g') AS label FROM conversations""")
def normalize_label(v: Views) -> DataFrame:
    raw = F.concat(F.lit('  "'), "role", F.lit('\n  x"  '))
    return v.table("conversations").select("conv_id", "turn", T.normal_label(raw).alias("label"))


#: The letter that stands last among marked or lone ones, as SQL.
def _coerced_sql(valid: str, x: str) -> str:
    inside = ", ".join(f"'{c}'" for c in valid)
    last = lambda p: f"list_filter(list_transform(regexp_extract_all({x}, '{p}', 1), lambda m: upper(m)), lambda m: m IN ({inside}))[-1]"
    marks = [last("(?i)" + m.replace("'", "''")) for m in T.MARKERS]
    lone = f"list_filter(list_transform(regexp_extract_all(' ' || replace({x}, ' ', '  ') || ' ', '[^A-Za-z]([A-D])[^A-Za-z]', 1), lambda m: upper(m)), lambda m: m IN ({inside}))[-1]"
    return f"coalesce(CASE WHEN upper({x}) IN ({inside}) THEN upper({x}) END, {', '.join(marks)}, {lone}, '{valid[0]}')"


ANSWERS = ["answer: b", "The correct choice is **C**", "\\\\boxed{ a } or so", "I think B, or A then", "nothing here", "b", "<think>x</think> *A* rest", "Final answer = D."]


@query("WITH a AS (SELECT turn, conv_id, (" + str([a.replace("\\\\", "\\") for a in ANSWERS]).replace("\\\\", "\\") + ")[CAST((conv_id + turn) % 8 AS INTEGER) + 1] AS x FROM conversations) SELECT conv_id, turn, " + _coerced_sql("ABCD", "x") + " AS mcq, " + _coerced_sql("AB", "x") + " AS \"binary\" FROM a")
def coerce_to_format(v: Views) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(a.replace("\\\\", "\\")) for a in ANSWERS]), ((F.col("conv_id") + F.col("turn")) % 8).cast("int") + 1)
    return v.table("conversations").select("conv_id", "turn", T.coerced(pick, "mcq").alias("mcq"), T.coerced(pick, "binary").alias("binary"))


@query(r"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<think>' || text || '</think> A' WHEN 1 THEN text || '</think>' || 'B' ELSE text END AS x FROM documents), p AS (SELECT *, instr(x, '</think>') AS k FROM x)
SELECT doc_id, CASE WHEN k > 0 THEN regexp_replace(regexp_replace(left(x, k - 1), '^\s*<think>', ''), '^\s+|\s+$', '', 'g') END AS reasoning, regexp_replace(CASE WHEN k > 0 THEN substr(x, k + 8) ELSE x END, '^\s+|\s+$', '', 'g') AS answer FROM p""")
def split_reasoning(v: Views) -> DataFrame:
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think> A"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("</think>B"))).otherwise(F.col("text"))
    return v.table("documents").withColumn("x", x).select("doc_id", T.reasoning(F.col("x")).alias("reasoning"), T.after_reasoning(F.col("x")).alias("answer"))


SETS = r"list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[,;\n]'), lambda p: lower(regexp_replace(p, '^\s+|\s+$', '', 'g'))), lambda p: p <> ''))"


@query(f"""WITH s AS (SELECT p_partkey, {SETS.format(x="p_name || ', ' || p_type")} AS a, {SETS.format(x="p_name || ';' || p_brand")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard FROM s""")
def parse_set_jaccard(v: Views) -> DataFrame:
    a, b = T.label_set(F.concat("p_name", F.lit(", "), "p_type")), T.label_set(F.concat("p_name", F.lit(";"), "p_brand"))
    return v.table("part").select("p_partkey", F.round(T.jaccard(a, b), 6).alias("jaccard"))


@query("""WITH j AS (SELECT conv_id, '[' || array_to_string(list_transform(m, lambda x: '{"content": ' || coalesce(to_json(x.content)::VARCHAR, 'null') || ', "role": ' || coalesce(to_json(x.role)::VARCHAR, 'null') || '}'), ', ') || ']' AS j FROM msgs)
SELECT conv_id, sha256(j) AS sha, substr(sha256(j), 1, 20) AS cache_key FROM j""")
def prompt_hash(v: Views) -> DataFrame:
    """sha256 of the messages as JSON with sorted keys."""
    msgs = v.msgs
    sha = T.canonical_hash(F.col("m"), msgs.schema["m"].dataType)
    return msgs.select("conv_id", sha.alias("sha"), F.substring(sha, 1, 20).alias("cache_key"))


@query("SELECT conv_id, CAST(len(m) AS INTEGER) AS n, CAST(greatest(len(m) - 1, 0) AS INTEGER) AS n_prompt, m[-1].role AS last_role, m[-1].content AS gold FROM msgs")
def messages_to_array(v: Views) -> DataFrame:
    prompt, gold = T.prompt_and_gold(F.col("m"))
    return v.msgs.select("conv_id", F.size("m").alias("n"), F.size(prompt).alias("n_prompt"), F.try_element_at("m", F.lit(-1)).role.alias("last_role"), gold.alias("gold"))


@query("""SELECT conv_id, list_filter(m, lambda x: x.role = 'user')[1].content AS first_user, list_filter(m, lambda x: x.role = 'user')[-1].content AS last_user,
list_filter(m, lambda x: x.role = 'assistant')[1].content AS first_assistant, list_filter(m, lambda x: x.role = 'system')[1].content AS system FROM msgs""")
def gold_and_last_user(v: Views) -> DataFrame:
    m = F.col("m")
    return v.msgs.select("conv_id", T.of_role(m, "user").alias("first_user"), T.of_role(m, "user", True).alias("last_user"), T.of_role(m, "assistant").alias("first_assistant"), T.of_role(m, "system").alias("system"))


@query(f"""WITH p AS (SELECT conv_id, CASE WHEN m[-1].role = 'assistant' THEN m[1:len(m) - 1] ELSE m END AS m FROM msgs)
SELECT conv_id, m[1].content || CASE WHEN m[1].role = 'system' THEN '{T.INSTRUCTIONS["binary"]}' ELSE '' END || CASE WHEN len(m) = 1 AND m[1].role = 'user' THEN '{T.REMINDERS["binary"]}' ELSE '' END AS first,
m[-1].content || CASE WHEN len(m) = 1 AND m[1].role = 'system' THEN '{T.INSTRUCTIONS["binary"]}' ELSE '' END || CASE WHEN m[-1].role = 'user' THEN '{T.REMINDERS["binary"]}' ELSE '' END AS last, len(m) AS n FROM p""")
def append_instruction(v: Views) -> DataFrame:
    m = v.msgs.select("conv_id", T.instructed(T.without_answer(F.col("m")), "binary", thinking=True).alias("m"))
    return m.select("conv_id", F.get("m", 0).content.alias("first"), F.try_element_at("m", F.lit(-1)).content.alias("last"), F.size("m").cast("long").alias("n"))


@query("""WITH p AS (SELECT conv_id, CASE WHEN m[-1].role = 'assistant' THEN m[1:len(m) - 1] ELSE m END AS m FROM msgs)
SELECT conv_id, array_to_string(list_transform(m, lambda x: '<' || x.role || '>' || chr(10) || x.content), chr(10)) AS prompt FROM p""")
def prompt_serialize(v: Views) -> DataFrame:
    return v.msgs.select("conv_id", T.serialized(T.without_answer(F.col("m"))).alias("prompt"))


@query("SELECT conv_id, turn, substr(text, 1, 1000) AS question, substr(text, 1, 400) AS follow_up, CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END AS short FROM conversations")
def truncate_question(v: Views) -> DataFrame:
    t = F.col("text")
    return v.table("conversations").select("conv_id", "turn", F.substring(t, 1, 1000).alias("question"), F.substring(t, 1, 400).alias("follow_up"), F.when(F.length(t) > 120, F.concat(F.left(t, F.lit(120)), F.lit("…"))).otherwise(t).alias("short"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, json_merge_patch(json_merge_patch(props::JSON, json_object('type', event_type, 'ok', event_id % 3 = 0, 'at', json_object('day', event_id % 7, 'tags', json_array(event_type, NULL)))), json_object('split', CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END))::VARCHAR AS metadata FROM events""")
def json_patch(v: Views) -> DataFrame:
    """Any object takes the new field; numbers, booleans, lists and nested objects stay what they are."""
    e = F.col("event_id")
    more = F.to_json(F.struct(F.col("event_type").alias("type"), (e % 3 == 0).alias("ok"), F.struct((e % 7).alias("day"), F.array("event_type", F.lit(None).cast("string")).alias("tags")).alias("at")))
    given = F.concat(F.regexp_replace("props", r"\}\s*$", ", "), F.substring(more, 2, 1 << 30))
    split = F.when(e % 5 == 0, "test").otherwise("train")
    return v.table("events").select("event_id", T.patched(given, "split", split).alias("metadata"))


@query("""SELECT sample, string_agg(feature || ': ' || printf('%.4g', value * 100), ', ' ORDER BY feature) AS profile FROM feat GROUP BY sample""")
def feature_profile(v: Views) -> DataFrame:
    one = F.struct("feature", F.concat_ws(": ", F.col("feature").cast("string"), T.significant_digits(F.col("value") * 100)).alias("s"))
    return v.feat.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.s), ", ").alias("profile"))


@query("SELECT p_partkey, string_split('k__B;g__' || p_name, 'g__')[-1] AS genus, regexp_replace('C' || p_size || ': ' || p_name, '^.*?: ', '') AS readable FROM part")
def taxonomy_tail(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.taxonomy_tail(F.concat(F.lit("k__B;g__"), "p_name")).alias("genus"), F.regexp_replace(F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit(": "), "p_name"), "^.*?: ", "").alias("readable"))


@query(r"""WITH u AS (SELECT doc_id, upper(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS u FROM trace)
SELECT doc_id, CASE WHEN starts_with(u, 'A') THEN 'A' WHEN starts_with(u, 'B') THEN 'B' WHEN contains(u, 'IBD') THEN 'A' WHEN contains(u, 'CONTROL') THEN 'B' ELSE 'other' END AS answer FROM u""")
def answer_normalize(v: Views) -> DataFrame:
    a = T.normal_answer(F.col("t"))
    return v.trace.select("doc_id", F.when(a.isin("A", "B"), a).otherwise("other").alias("answer"))


@query(r"""SELECT event_id, regexp_replace('```json' || chr(10) || props || chr(10) || '```', '^\s*```(?:json)?\s*|\s*```\s*$', '', 'g') AS body FROM events""")
def strip_fences(v: Views) -> DataFrame:
    return v.table("events").select("event_id", T.without_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("body"))
