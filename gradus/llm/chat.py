"""Chat formatting over typed content parts, in DataFrame functions alone.

A turn is ``<turn role>`` + newline + body + ``</turn>`` + newline. Inside roles and bodies a backslash is doubled and a
``<`` before ``turn``, ``/turn`` or ``part`` gets a backslash after it, so that no text can imitate the template and every
text comes back unchanged: between ``<`` and a control word a doubled backslash has an even run, an escape exactly one.

The visitor turns the parts of a turn into one body in order: text parts as escaped text, image, audio and document parts
as ``<part KIND N>`` where N counts the attachments of the conversation from 0. Each attachment is recorded with its
reference and expanded token count: images 85 + 170 for each 512-pixel tile, audio 25 a second, documents 800 a page, one
unit at least. Text parts count one token per four characters, rounded up.

Turns are ordered by turn (nulls first), then role, then their parts as they come in, texts before escaping; attachments are
numbered in that order. Null texts and roles count as empty, null part lists as no parts, an unknown kind of part as an
attachment of that kind without tokens. A null conversation id is a conversation of its own. Repeated rows are repeated turns.
Texts of any length stay whole: a conversation is one string, so its texts together must fit into one value. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "<turn ", ">\n", "</turn>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """``text`` with every control string made harmless."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), r"<(?=turn|/turn|part)", r"<\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"<\\(?=turn|/turn|part)", "<"), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A part list that holds one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"))).cast(
        "array<struct<kind:string,text:string>>"
    )


def _tokens(p: Column) -> Column:
    at_least_one = lambda x: F.greatest(F.lit(1), F.coalesce(x.cast("long"), F.lit(1).cast("long")))
    tiles = at_least_one(F.ceil(p["width"] / 512)) * at_least_one(F.ceil(p["height"] / 512))
    return (
        F.when(p["kind"] == "image", 85 + 170 * tiles)
        .when(p["kind"] == "audio", 25 * at_least_one(F.ceil(p["seconds"])))
        .when(p["kind"] == "document", 800 * at_least_one(p["pages"]))
        .otherwise(F.lit(0).cast("long"))
    )


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def format_chat(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """One row per conversation: formatted string, its turns with the places of the loss mask, attachments, n_tokens.

    ``parts`` is an array of the PART struct, or of a struct of kind and text alone. ``turns`` holds, in order, the start
    (0-based, in code points) and length of each turn and of its part under the loss mask (length 0 and start null
    where the role is not ``trained``)."""
    kind = df.schema[parts].dataType
    given = kind.elementType.fieldNames()
    rows = df.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(parts), F.array().cast(kind)).alias("p"))
    if "ref" in given:  # attachments are numbered through the conversation, in the order of its turns
        order = Window.partitionBy("c").orderBy("t", "r", "p").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("first", F.coalesce(F.sum(F.size(F.filter("p", lambda x: ~_is_text(x)))).over(order), F.lit(0)))
    else:
        rows = rows.withColumn("first", F.lit(0).cast("long"))
    grouped = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "r", "p", "first"))).alias("turns"))
    one_text = lambda p: (F.size(p) == 1) & _is_text(p[0])
    visit = lambda acc, x: F.when(_is_text(x), F.struct(F.concat(acc.body, escape(x.text)).alias("body"), acc.n.alias("n"))).otherwise(
        F.struct(F.concat(acc.body, F.lit("<part "), escape(x.kind), F.lit(" "), acc.n.cast("string"), F.lit(">")).alias("body"), (acc.n + 1).alias("n")))
    fields = [f.split(":") for f in PART[7:-1].split(",")]
    rich = lambda x: F.struct(*[(x[name] if name in given else F.lit(None)).cast(to).alias(name) for name, to in fields])
    count = lambda a, x: a + F.when(_is_text(x), F.ceil(F.length(F.coalesce(x.text, F.lit(""))) / 4)).otherwise(_tokens(x))
    grouped = grouped.select("c", F.transform("turns", lambda x: F.struct(
        x.r.alias("r"),
        F.concat(F.lit(OPEN), F.replace(escape(x.r), F.lit("\n"), F.lit("<\\turn\n")), F.lit(BETWEEN)).alias("head"),
        F.when(one_text(x.p), escape(x.p[0]["text"])).otherwise(F.aggregate(x.p, F.struct(F.lit("").alias("body"), x.first.alias("n")), visit).body).alias("body"),
        F.aggregate(F.transform(x.p, rich), F.lit(0).cast("long"), count).alias("tokens"),
        F.transform(F.filter(x.p, lambda y: ~_is_text(y)), lambda y, i: F.struct((x.first + i).alias("index"), y.kind.alias("kind"), rich(y).ref.alias("ref"), _tokens(rich(y)).alias("n_tokens"))).alias("files"),
    )).alias("all"))
    # Places come from lengths alone, which a window sums row by row; the strings are joined once.
    sized = F.transform("all", lambda x: F.struct(F.length(x.head).alias("h"), F.length(x.body).alias("b"), (x.r == trained).alias("on")))
    return grouped.select(
        F.col("c").alias(conversation),
        F.array_join(F.transform("all", lambda x: F.concat(x.head, x.body, F.lit(CLOSE))), "").alias("formatted"),
        F.transform(sized, lambda x: F.struct((x.h + x.b + len(CLOSE)).alias("length"), F.when(x.on, x.h).alias("loss_start"), F.when(x.on, x.b).otherwise(0).alias("loss_length"))).alias("turns"),
        F.flatten(F.transform("all", lambda x: x.files)).alias("attachments"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x.tokens).alias("n_tokens"),
    )


def read_back(formatted: Column, turns: Column) -> Column:
    """Turns of a formatted string: structs of role, text and loss text, all unescaped.

    Roles and texts are read from the template alone; the loss texts are cut out by the mask's places."""
    cut = F.split(formatted, "(?<=</turn>\n)", -1)
    segments = F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0)))
    inner = lambda s: F.substring(s, len(OPEN) + 1, 2147483647)
    role = lambda s: F.regexp_extract(inner(s), r"(?s)^(.*?)>\n", 1)
    return F.zip_with(
        segments, turns,
        lambda s, t: F.struct(
            unescape(F.replace(role(s), F.lit("<\\turn\n"), F.lit("\n"))).alias("role"),
            unescape(F.regexp_extract(s, r"(?s)^<turn .*?>\n(.*)</turn>\n$", 1)).alias("text"),
            F.when(t.loss_start.isNotNull(), unescape(s.substr(t.loss_start + 1, t.loss_length))).alias("loss"),
        ),
    )
