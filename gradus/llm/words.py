"""Tables of distinct words, and texts rewritten through them.

A table holds each distinct word of a corpus once, with its count and a payload. Its common words, at most ``HEAD`` of them and
``HEAD_BYTES`` bytes with their payloads, are broadcast as Arrow arrays and looked up where the texts lie. All other words are
joined: (text, word) pairs meet the table by word, and what they find goes back to the text, whose code has been stored with a
hole for each such word. Hot words therefore never enter a shuffle, and a text sends each of its words once. Rows are told apart
by a number, in :func:`rare_pairs` texts by md5; words by all their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import Memo, dropped, give_back, small_batches, stored, text_buffer

#: Most words of a broadcast head, and most bytes of its words and payloads; longer words and payloads stay outside.
HEAD, HEAD_BYTES, LONG = 400_000, 48 << 20, 64
#: Bytes of text that are looked up together.
TOGETHER = 6 << 20
#: Parts in which texts travel.
ROUNDS = 4

#: Splits a column of texts: all words one after the other, and the n + 1 offsets into them by text.
Splitter = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), 0x20]] = True
#: UTF-8 of the other characters with the Unicode property White_Space.
WIDE_SPACES = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = ~_ALNUM[0x21:0x7F]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary array of the parts of ``data`` between neighbouring offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def letters_and_digits(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of ASCII letters and digits and all characters beyond ASCII; A-Z are lower-cased, nothing else."""
    raw, offsets = text_buffer(column)
    inside = _ALNUM[raw]
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cuts[1:-1]
    place = np.concatenate([[0], np.cumsum(inside)])  # of each byte among those kept
    starts = np.flatnonzero(begins)
    return binaries(_LOWER[raw[inside]], np.append(place[starts], place[-1])), np.searchsorted(starts, offsets)


def _wide(raw: np.ndarray, space: np.ndarray) -> None:
    """Marks the bytes of WIDE_SPACES; no text ends inside a character."""
    for lead in {w[0] for w in WIDE_SPACES}:
        own = [w for w in WIDE_SPACES if w[0] == lead]
        at = np.flatnonzero(raw == lead)
        for k in range(1, len(own[0])):
            at = at[np.isin(raw[at + k], [w[k] for w in own])]
        for wide in own:
            found = at
            for k in range(1, len(wide)):
                found = found[raw[found + k] == wide[k]]
            for k in range(len(wide)):
                space[found + k] = True


def letters(raw: np.ndarray) -> np.ndarray:
    """Of each byte whether an ASCII letter or a letter from U+00C0 to U+023F ends there."""
    out = _LETTER[raw]
    lead, last = raw[:-1], raw[1:]
    out[1:] |= (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))  # not the signs for times and divided
    return out


def spaced(tokens: Iterable[str] = (), marks: bool = False) -> Splitter:
    """Cuts texts, without loss, before each run of white space that follows another character, and around ``tokens``.

    With ``marks`` also between a letter (:func:`letters`) and an ASCII mark behind it, so that a word is the same with any marks."""
    own = [t.encode() for t in sorted(tokens, key=len, reverse=True)]
    found = re.compile(b"|".join(map(re.escape, own))) if own else None

    def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        raw, offsets = text_buffer(column)
        space = _SPACE[raw]
        _wide(raw, space)
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:-1] = space[1:] & ~space[:-1]
        if marks:
            begins[1:-1] |= letters(raw)[:-1] & _MARK[raw[1:]]
        at, data = 0, raw.tobytes() if found else b""
        while found and (m := found.search(data, at)):
            inside = np.searchsorted(offsets, m.start(), side="right") == np.searchsorted(offsets, m.end(), side="left")
            if inside:
                begins[m.start() : m.end()] = False
                begins[[m.start(), m.end()]] = True
            at = m.end() if inside else m.start() + 1
        begins[offsets] = True
        begins[-1] = False
        starts = np.flatnonzero(begins[:-1])
        return binaries(raw, np.append(starts, len(raw))), np.searchsorted(starts, offsets)

    return split


def together(batches: Iterable[pa.RecordBatch], column: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut, so that each holds about ``most`` bytes of text; a longer text is a batch of its own."""
    Memo.enter("words")
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, base + most - size, side="right"))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1] - base)
                start = stop
            if start < batch.num_rows:
                if not held:
                    held, start = [batch.slice(start, 1)], start + 1
                yield _one(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield _one(held)
        held = []
    give_back()


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def counted(df: DataFrame, split: Splitter, text: str = "text") -> DataFrame:
    """(word binary, n): the words of all texts with their counts; rows of a word are summed up per batch, not yet overall."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(batches, "text"):
            words, _ = split(part.column("text"))
            got = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "n"])

    return df.select(F.col(text).alias("text")).filter("text IS NOT NULL").mapInArrow(run, "word binary, n long")


@dataclass
class Head:
    """Common words of a table and their payloads; a broadcast value."""

    words: pa.Array
    payload: pa.Array

    def of(self, words: pa.Array) -> pa.Array:
        """Places of ``words`` here, null for others."""
        return pc.index_in(words, value_set=self.words)


def head(table: DataFrame, payload: str, most: int = HEAD, most_bytes: int = HEAD_BYTES) -> Head:
    """The most frequent words of a stored (word, n, payload) table that fit, down to a common least count.

    Counts are told apart in 32 steps per power of two, so at most some 2,000 rows decide where the head ends."""
    size = F.length("word") + (F.length(payload) if dict(table.dtypes)[payload] == "binary" else F.lit(8))
    short = table.filter((F.length("word") <= LONG) & (size <= 8 * LONG)).withColumn("_step", F.floor(F.log2("n") * 32))
    least, rows, total = None, 0, 0
    for r in sorted(short.groupBy("_step").agg(F.count("*").alias("k"), F.sum(size).alias("b")).collect(), key=lambda r: -r["_step"]):
        rows, total = rows + r["k"], total + r["b"]
        if rows > most or total > most_bytes:
            break
        least = r["_step"]
    if least is None:
        kind = pa.binary() if dict(table.dtypes)[payload] == "binary" else pa.int64()
        return Head(pa.array([], pa.binary()), pa.array([], kind))
    got = short.filter(F.col("_step") >= least).select("word", F.col(payload).alias("payload"), "_step").toArrow().sort_by([("_step", "descending")]).combine_chunks()
    one = [got.column(c).chunk(0) if got.num_rows else got.column(c).combine_chunks() for c in ("word", "payload")]
    return Head(*one)


def _rare(words: pa.Array, places: pa.Array, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words outside the head, and the text of each."""
    at = np.flatnonzero(np.asarray(places.is_null()))
    return words.take(pa.array(at)), np.searchsorted(offsets, at, side="right") - 1


def md5(column: str) -> Column:
    return F.unhex(F.md5(F.col(column).cast("binary")))


def rare_pairs(df: DataFrame, split: Splitter, shared) -> DataFrame:
    """(m, word, i, k) of rows (m, text): the words outside the broadcast head, each one's place among the text's own such
    words, and how often it occurs there. Copies of a text send the same rows."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(batches, "text"):
            words, offsets = split(part.column("text"))
            rare, owner = _rare(words, shared.value.of(words), offsets)
            if len(rare):
                own, place, _, counts = _own_words(rare, owner)
                yield pa.RecordBatch.from_arrays([part.column("m").take(pa.array(owner[own])), rare.take(pa.array(own)), pa.array(place), pa.array(counts)], ["m", "word", "i", "k"])

    return df.mapInArrow(run, "m binary, word binary, i int, k long")


def _own_words(rare: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rare words in the order of their texts, each text's distinct ones in the order of their first places: where they are first, their
    place among the text's own, for every word the number of its distinct one, and counts."""
    coded = rare.dictionary_encode()
    _, first, inverse, counts = np.unique(owner * len(coded.dictionary) + coded.indices.to_numpy(), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    own = first[order]
    start = np.searchsorted(owner[own], owner[own])
    return own, (np.arange(len(own)) - start).astype(np.int32), rank[inverse], counts[order]


def rewritten(df: DataFrame, table: DataFrame, payload: str, split: Splitter, text: str = "text", key: str = "doc_id", most: int = HEAD, finish: Callable[[DataFrame], DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(key, code binary), stored: the payloads of each text's words, one after the other, through a stored table of all words.

    A null text has an empty code. Texts are read and cut once: a row is stored as the compressed places of its words in the head,
    with a hole for each other word. Rows with holes travel to meet what the join by word found for them, in ``rounds`` parts,
    so that little is on the way at a time. What ``finish`` makes of the (key, code) frame is stored in its place."""
    spark = df.sparkSession
    finish = finish or (lambda x: x)
    shared = spark.sparkContext.broadcast(head(table, payload, most))
    kind = df.schema[key].dataType.simpleString()
    small_batches(spark)

    def holed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        row = TaskContext.get().partitionId() << 33
        for part in together(batches, "text"):
            n = part.num_rows
            words, offsets = split(part.column("text"))
            places = shared.value.of(words)
            rare, owner = _rare(words, places, offsets)
            own, place, which, _ = _own_words(rare, owner)
            flat = places.fill_null(-1).to_numpy()
            packed = [codec.compress(_planes(flat[a:b]), asbytes=True) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            lists = [_lists(pa.array(place[which]), owner, n), _lists(rare.take(pa.array(own)), owner[own], n)]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(row + np.arange(n)), pa.array(packed, pa.binary()), pa.array(np.diff(offsets).astype(np.int32)), *lists], ["key", "r", "z", "n", "which", "own"])
            row += n

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            plain = pa.array([_unplanes(codec.decompress(z.as_buffer(), 4 * n)) for z, n in zip(batch.column("z"), batch.column("n").to_pylist())], pa.binary())
            for part in together([pa.RecordBatch.from_arrays([batch.column("key"), plain, batch.column("which"), batch.column("x")], ["key", "places", "which", "x"])], "places"):
                ends = _ends(part.column("places"))
                places = np.frombuffer(part.column("places").buffers()[2] or b"", np.int32)[ends[0] // 4 : ends[-1] // 4]
                missing = places < 0
                per, size = (pc.list_value_length(part.column(c)).to_numpy().astype(np.int64) for c in ("which", "x"))
                of = np.zeros(len(places), np.int64)  # of each text, its own words' payloads in their order
                of[missing] = part.column("which").flatten().to_numpy() + np.repeat(np.cumsum(size) - size, per)
                taken = pc.coalesce(shared.value.payload.take(pa.array(places, mask=missing)), part.column("x").flatten().take(pa.array(of, mask=~missing)))
                yield pa.RecordBatch.from_arrays([part.column("key"), _by_text(taken, (ends - ends[0]) // 4)], ["key", "code"])

    named = lambda x: finish(x.mapInArrow(opened, f"key {kind}, code binary").withColumnRenamed("key", key))
    texts = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("").cast(df.schema[text].dataType)).alias("text"))
    rows = stored(texts.mapInArrow(holed, f"key {kind}, r long, z binary, n int, which array<int>, own array<binary>"), "rows")
    parts = ["key", "z", "n", "which"]
    out = stored(named(rows.filter("size(own) = 0").select(*parts, F.expr("cast(array() AS array<binary>)").alias("x"))), "near")
    for k in range(rounds):
        mine = rows.filter((F.size("own") > 0) & (F.col("r") % rounds == k))
        pairs = mine.select("r", F.posexplode("own").alias("i", "word"))
        met = pairs.join(table.select("word", F.col(payload).alias("code")), "word").groupBy("r").agg(F.collect_list(F.struct("i", "code")).alias("x"))
        extras = stored(met.select("r", F.expr("transform(array_sort(x), y -> y.code)").alias("x")), "extras")
        out = out.unionByName(stored(named(mine.join(extras, "r").select(*parts, "x")), "far"))
        dropped(extras)
    dropped(rows)
    return out


def _ends(codes: pa.Array) -> np.ndarray:
    """The n + 1 offsets into the bytes of a binary array."""
    return np.frombuffer(codes.buffers()[1], np.int32, count=len(codes) + 1, offset=codes.offset * 4) if len(codes) else np.zeros(1, np.int32)


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """A list for each of ``n`` texts of the values that it owns; ``owner`` does not fall."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), values)


def _planes(places: np.ndarray) -> bytes:
    """First bytes of all 32-bit numbers, then second ones and so on, for the codec's sake."""
    return places.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: pa.Buffer) -> bytes:
    """The inverse of :func:`_planes`."""
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.tobytes()


def _by_text(codes: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The codes of each text's words joined; ``codes`` has no nulls."""
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    ends = _ends(codes)
    data = codes.buffers()[2] if len(codes) else None
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype(np.int32)), data if data is not None else pa.py_buffer(b"")])
