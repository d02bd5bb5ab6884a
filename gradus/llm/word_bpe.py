"""Byte-level BPE through a table of distinct words.

Words are cut, without loss, before each run of white space that follows another character, between a letter and a mark behind it,
and around the tokenizer's added tokens: places that no match of the tokenizer's own pattern crosses. Each distinct word of the corpus is encoded once, by the
tokenizers library, into a stored table; texts take their words' ids back by position (:mod:`gradus.llm.words`). Decoding joins
ids with the table of pieces, one row for each id of the vocabulary, which is broadcast.

Fits tokenizers of byte level with the public pattern, without normaliser, template or prefix space; others are an error, not a
wrong result. Null and empty texts have no ids. Texts are whole, of any length. Repeated rows repeat in the result, and rows
without an id stay. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradus.llm.bpe import byte_letters
from gradus.llm.common import Scratch, dropped, small_batches, stored
from gradus.llm.words import HEAD, counted, rewritten, spaced

FILE = "byte_bpe_50k.json"


@lru_cache(2)
def _settings(path: str | None) -> dict:
    with open(path or public_tokenizers.path(FILE), encoding="utf-8") as f:
        return json.load(f)


def added_tokens(path: str | None = None) -> list[str]:
    """Strings that the tokenizer takes out of a text before its pattern; raises for tokenizers that this module cannot follow."""
    got = _settings(path)
    first, added = got["pre_tokenizer"] or {}, got["added_tokens"]
    fits = first.get("type") == "ByteLevel" and not first["add_prefix_space"] and first.get("use_regex", True) and got["normalizer"] is None
    if not fits or got["post_processor"] not in (None, first) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("not a plain byte-level tokenizer")
    return [t["content"] for t in added]


@lru_cache(2)
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path or public_tokenizers.path(FILE))
    out.no_truncation()
    out.no_padding()
    return out


def pieces(path: str | None = None) -> pa.Array:
    """The bytes of each id, null for ids that do not exist. A piece with a character that stands for no byte is its UTF-8."""
    got = _settings(path)
    of = {c: b for b, c in enumerate(byte_letters())}
    table = {i: t for t, i in got["model"]["vocab"].items()} | {t["id"]: t["content"] for t in got["added_tokens"]}
    out: list[bytes | None] = [None] * (max(table, default=-1) + 1)
    for i, t in table.items():
        out[i] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
    return pa.array(out, pa.binary())


def encode_words(words: list[str], path: str | None, between: str) -> list[bytes]:
    """Ids of each word. Words are encoded as one text with the added token ``between`` them, which the library takes out before
    anything else, so that each is encoded as if it stood alone; those that hold the token, by themselves."""
    own = [w for w in words if not between or between in w]
    alone = dict(zip(own, [np.array(e.ids, "<u4").tobytes() for e in _tokenizer(path).encode_batch_fast(own, add_special_tokens=False)]))
    rest = [w for w in words if w not in alone]
    if rest:
        ids = np.array(_tokenizer(path).encode_batch_fast([between.join(rest)], add_special_tokens=False)[0].ids, "<u4")
        raw, at = ids.tobytes(), 4 * np.flatnonzero(ids == _tokenizer(path).token_to_id(between))
        alone |= zip(rest, [raw[a:b] for a, b in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)])], strict=True)
    return [alone[w] for w in words]


def word_table(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(word, n, ids binary), stored: every distinct word of the texts, its count, its ids as little-endian unsigned 32-bit."""

    between = next(iter(added_tokens(path)), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = encode_words(part.column("word").cast(pa.string()).to_pylist(), path, between)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], ["word", "n", "ids"])

    words = counted(df, spaced(added_tokens(path), marks=True), text).groupBy("word").agg(F.sum("n").alias("n"))
    return stored(words.mapInArrow(run, "word binary, n long, ids binary"), "words")


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, most: int = HEAD, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, ids binary), stored: ids of every text as little-endian unsigned 32-bit integers, or what ``finish`` makes of them."""
    named = lambda x: (finish or (lambda y: y))(x.withColumnRenamed("code", "ids"))
    table = word_table(df, text, path)
    out = rewritten(df, table, "ids", spaced(added_tokens(path), marks=True), text, key, most, named)
    dropped(table)
    return out


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the column ``decoded``, the text of each row's binary ``ids``: a join of ids with the broadcast pieces.

    Bytes that are no UTF-8 become U+FFFD, ids without a piece nothing; null ids have the empty text."""
    spark = df.sparkSession
    small_batches(spark)
    known = pa.concat_arrays([pieces(path), pa.array([None], pa.binary())])  # the last one stands for all ids beyond the vocabulary
    shared = spark.sparkContext.broadcast(known.fill_null(b"").cast(pa.large_binary()))
    own = [c for c in df.columns if c.lower() != decoded.lower()]
    at = own.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = part.column(at).fill_null(b"")
                size = np.concatenate([[0], np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False) // 4)])
                flat = np.frombuffer(b"".join(rows.to_pylist()), "<u4")
                joined = table.take(pa.array(np.minimum(flat, len(table) - 1)))
                ends = np.frombuffer(joined.buffers()[1], np.int64, count=len(joined) + 1, offset=joined.offset * 8)[size] if len(joined) else np.zeros(len(size), np.int64)
                texts = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), joined.buffers()[2]]) if len(joined) else pa.array([b""] * len(rows), pa.large_binary())
                try:
                    texts = texts.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:  # bytes that are no UTF-8
                    texts = pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*own, decoded])

    kept = df.select(*own)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(decoded, StringType())]))


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, most: int = HEAD) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every text, stored: encoded, then decoded from the ids."""
    def hashed(part: DataFrame) -> DataFrame:
        return decode(part, path=path).select(F.col(key), (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

    with Scratch(df.sparkSession) as scratch:
        return scratch.result(encode(df, text, key, path, most, hashed), "digests")
