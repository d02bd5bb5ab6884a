"""Best-two-fit packing of token counts into sequences of a fixed length.

Documents are tokenised where they lie. Only the number of pieces of each length, at most ``size`` rows whatever the corpus,
reaches the driver; the plan that comes back lists bin patterns with multiplicities and is as bounded. Pieces find
their places by rank among pieces of equal length, where ranks come from counts per partition, so that a length that
holds a third of all rows is spread over many tasks.

Null and empty texts make one piece that holds the end id alone. A document longer than a sequence is cut into full
sequences and a rest. Repeated rows are packed as often as they occur, and rows without an id like others. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import Memo, Scratch, slices, small_batches, stored, text_buffer
from gradus.llm.words import binaries

SIZE = 4096
#: Bytes of text whose words are looked up together.
TOGETHER = 4 << 20
#: Entries of a worker's table of words already encoded; it starts anew beyond it.
CACHE = 300_000
#: Words that are one part for the tokenizer: letters alone, or ASCII marks alone.
ONE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-/:-@\[-`{-~]+").fullmatch
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def word_parts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between spaces and line ends, all one after the other, and the n + 1 offsets into them by text.

    A word of ASCII or Latin-1 letters with any run of ASCII marks behind it is given as its letters in lower case and its marks: case
    does not count, and marks behind a letter are a part of their own. Other words stay as they are."""
    raw, offsets = text_buffer(column)
    if not len(raw):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    inside = (raw != 0x20) & (raw != 0x0A)
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cuts[1:-1]
    pair = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # U+00C0 to U+00FF but the signs for times and divided
    letter, mark = _LETTER[raw], _MARK[raw]
    letter[1:] |= pair
    letter[:-1] |= pair
    odd = inside & ~letter & ~mark
    odd[1:] |= letter[1:] & mark[:-1] & ~begins[1:]
    starts = np.flatnonzero(begins)
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1] = False
    split = np.zeros(len(raw), bool)
    if len(starts):
        split[starts[0] :] = np.repeat(plain, np.diff(np.append(starts, len(raw))))  # now whether a byte is of a plain word, or behind one
    upper = (raw >= 0x41) & (raw <= 0x5A)
    upper[1:] |= pair & (raw[1:] <= 0x9E)
    low = raw + (upper & split).astype(np.uint8) * np.uint8(32)
    begins[1:] |= split[1:] & mark[1:] & letter[:-1]
    place = np.concatenate([[0], np.cumsum(inside)])
    starts = np.flatnonzero(begins)
    return binaries(low[inside], np.append(place[starts], place[-1])), np.searchsorted(starts, offsets)


class WordCache:
    """Ids of white-space separated words, which the tokenizer treats alike wherever they stand."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stems = Memo(self.encode_runs, CACHE, "packing")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode_runs(self, words: list[str]) -> list[bytes]:
        """Encodes words in joined runs. Those of one part end at their first token that ends a part; in other runs each token
        goes to the word that its first character lies in."""
        known: dict[str, bytes] = {}
        plain = [w for w in words if ONE(w)]
        for at in range(0, len(plain), 500):
            part = plain[at : at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
            if len(cut) == len(part) + 1 and cut[-1] == 4 * len(ids):
                raw = ids.tobytes()
                known |= zip(part, [raw[a:b] for a, b in zip(cut, cut[1:])])
        rest = [w for w in words if w not in known]
        for at in range(0, len(rest), 500):
            part = rest[at : at + 500]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            raw = np.array(got.ids, "<u4").tobytes()
            cut = (4 * np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), starts)).tolist()
            known |= zip(part, [raw[a:b] for a, b in zip(cut, cut[1:])])
        return [known[w] for w in words]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text: distinct words are looked up, and their ids taken by all words."""
        words, offsets = word_parts(column)
        if not len(words):
            return [b""] * len(column)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.cast(pa.string()).to_pylist()
        ids = pa.array(list(map(self.stems.table([distinct]).__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, count=len(ids) + 1, offset=ids.offset * 8)[offsets].tolist()
        raw = ids.buffers()[2].to_pybytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))


@lru_cache(2)
def word_cache(path: str | None) -> WordCache:
    """Of the public file, found where this runs, unless a path is given."""
    return WordCache(path or public_tokenizers.path("word_bpe_49k.json"))


def pieces(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, size: int = SIZE, end_id: int = 1, ids: bool = False, shards: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32 and, with ``ids``, ids binary) of every document, cut at ``size`` tokens.

    With ``shards`` a last column ``_shard`` deals the pieces out in turn, so that equal rows part."""
    small_batches(df.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(path)
        turn = TaskContext.get().partitionId() * 8191
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                where, piece, start, length, crc, own = [], [], [], [], [], []
                for i, raw in enumerate(cache.encode_column(part.column("text"))):
                    raw += end
                    for p, a in enumerate(range(0, len(raw), 4 * size)):
                        cut = raw[a : a + 4 * size]
                        where.append(i), piece.append(p), start.append(a // 4), length.append(len(cut) // 4), crc.append(zlib.crc32(cut))
                        if ids:
                            own.append(cut)
                columns = [part.column("key").take(pa.array(where, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.array(own, pa.binary()))
                if shards:
                    columns.append(pa.array(((turn + np.arange(len(where))) % shards).astype(np.int32)))
                    turn += len(where)
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids + ["_shard"] * bool(shards))

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids + ", _shard int" * bool(shards)
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """Bins as (how many alike, lengths in order): best-two-fit over a histogram of lengths.

    A bin opens with the longest length left and takes the longest that fits until none does. Then its smallest
    member gives way to two unpacked lengths, if two fill the expanded gap more tightly. The finished pattern repeats
    while the counts last, so each round uses up some length to below its number in the pattern."""
    left = np.zeros(size + 1, np.int64)
    for k, v in counts.items():
        left[k] = v
    lengths = np.arange(size + 1)

    def below() -> np.ndarray:
        """For each gap, the longest length left that fits; 0 if none."""
        return np.maximum.accumulate(np.where(left > 0, lengths, 0))

    out = []
    fits = below()
    while (top := int(fits[size])) > 0:
        members = []
        gap = size
        while top:
            take = min(int(left[top]), gap // top)
            members += [top] * take
            left[top] -= take
            gap -= take * top
            if not left[top]:
                fits = below()
            top = int(fits[gap])
        if gap and len(members) > 1:
            small = members[-1]
            room = gap + small
            one = np.flatnonzero(left[: room + 1] > 0)
            if len(one):
                two = fits[room - one]
                two = np.where((two == one) & (left[one] < 2), _next_below(left, one), two)
                total = np.where(two > 0, one + two, 0)
                best = int(np.argmax(total))
                if total[best] > small:
                    members[-1:] = [int(one[best]), int(two[best])]
                    left[small] += 1
                    left[one[best]] -= 1
                    left[two[best]] -= 1
        need: dict[int, int] = {}
        for m in members:
            need[m] = need.get(m, 0) + 1
        more = min(int(left[m]) // n for m, n in need.items())
        for m, n in need.items():
            left[m] -= more * n
        out.append((1 + more, members))
        fits = below()
    return out


def _next_below(left: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each length, the longest shorter one that is left; 0 if none."""
    longest = np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))
    return longest[np.maximum(at - 1, 0)]


def pack(cut: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Adds (sequence_id, offset) to the frame that :func:`pieces` made, which must be stored: it is read three times."""
    spark = cut.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, bins, used = [], 0, {}
    for times, members in plan(counts, size):
        each: dict[int, list[int]] = {}
        offset = 0
        for m in members:
            each.setdefault(m, []).append(offset)
            offset += m
        for m, offsets in each.items():
            first = used.get(m, 0)
            slots.append((m, first, len(offsets), bins, offsets))
            used[m] = first + times * len(offsets)
        bins += times
    # A slot row stands for ranks [first, next first) of one length. Rows are bounded by size * (ln(size) + 1) patterns.
    by_length: dict[int, list] = {}
    for m, first, n, at, offsets in slots:
        by_length.setdefault(m, []).append((first, n, at, offsets))
    table = spark.createDataFrame([(m, [x[0] for x in v], v) for m, v in by_length.items()], "length long, firsts array<long>, slots array<struct<first:long,n:int,at:long,offsets:array<int>>>")
    # Rank within a length: a count per (length, shard) gives each shard its first rank, then rows count inside the shard.
    sharded = cut if "_shard" in cut.columns else cut.withColumn("_shard", F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), F.lit(SHARDS)).cast("int"))
    per = sharded.groupBy("length", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_shard").orderBy(key, "piece", "start", "ids_crc32")
    ranked = sharded.withColumn("_r", F.row_number().over(inside) - 1).join(per, ["length", "_shard"]).withColumn("_r", F.col("_r") + F.col("_base"))
    ranked = ranked.join(F.broadcast(table), "length")
    return ranked.withColumn("_s", F.expr(_SLOT)).select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("_s.at") + F.floor((F.col("_r") - F.col("_s.first")) / F.col("_s.n"))).cast("long").alias("sequence_id"),
        F.expr("element_at(_s.offsets, cast((_r - _s.first) % _s.n as int) + 1)").cast("long").alias("offset"),
        *[c for c in cut.columns if c == "ids"],
    )


#: Parts that the pieces of one length are counted in at least, and rows of the table for each further part.
SHARDS, PER_SHARD = 256, 250_000
#: Last slot row whose first rank is not above the piece's.
_SLOT = "element_at(slots, size(filter(firsts, f -> f <= _r)))"


def best_fit(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, size: int = SIZE, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Packs every text of ``df``, stored; with ``ids`` the pieces carry their ids as little-endian 32-bit binary."""
    with Scratch(df.sparkSession) as scratch:
        shards = max(SHARDS, -(-df.count() // PER_SHARD))
        return scratch.result(pack(stored(pieces(df, text, key, path, size, end_id, ids, shards), "pieces"), key, size), "packed")
