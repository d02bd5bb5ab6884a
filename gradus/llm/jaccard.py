"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, each pair verified once.

A document's set holds the 64-bit hashes of its distinct word n-grams (A-Z in lower case; fewer words than n: the whole
sequence as one). Documents with equal sets are one class, stood for by its smallest id. Shingles are ordered by how many
documents' shingles share their bucket in a frequency sketch over the whole corpus, rare first, then by hash; any fixed order
keeps the prefix filter exact. The sketch has ``PER_ROW`` counters for each row, between ``LEAST`` and ``MOST`` powers of two,
so that what is broadcast is 16 MB at most. Of a set of s shingles the first s - ceil(t s) + 1 are its prefix; two linked
sets share one of them.

Candidates pass the length filter, a bound on the sets' difference from parity signatures (``BITS`` bits: the parity of the
number of shingles behind each), the positional filter (what can still match after the first shared shingle) and the suffix
filter (the same bound for what follows the first shared shingle in either set, its signature being the set's without the
prefix up to there). First every class meets the smallest class that shares a prefix shingle with it; what these verified
links join needs no further comparison for components. Then all pairs that share a prefix shingle, are not joined yet and
were not compared before are. So a group of near copies takes rows in proportion to its size as long as its members resemble
the first of them, and no link between different components is lost. With ``every_pair`` nothing is skipped, and the verified
pairs are the whole join between classes.

Verification streams sorted texts: one of a pair comes first, its partners follow, one set is held at a time. A text with many
partners is sent to several groups, each of about ``TEXTS`` texts at most and ``GROUP`` bytes or 16 times that text.

Null texts and texts without words have the empty set and link with nothing; rows without an id link with nothing and have a
null component. Repeated rows fall into one class; of several texts under one id each takes part, and the id has the smallest
component of them. Texts are whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import Memo, Scratch, connected_components, dropped, gram_hashes, mix, picked, slices, small_batches, stored, word_hashes

#: Counters of the sketch for each row of the table, as many as a power of two from LEAST to MOST; counters of a block.
PER_ROW, LEAST, MOST, COUNTERS = 16, 16, 22, 1 << 16
#: Bits of a parity signature.
BITS = 1024
#: Bytes and texts of a group to verify, about.
GROUP, TEXTS = 1 << 18, 64
#: Most ids that are broadcast to pick out texts; more are shuffled.
MOST_IDS = 500_000


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, _, _, offsets = word_hashes(column, lower=True)
    grams = gram_hashes(words, n)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield gram_hashes(words[a:b], b - a) + np.uint64(b - a)
        else:
            yield np.zeros(0, np.uint64)


def signature(u: np.ndarray) -> bytes:
    """Parities of the numbers of hashes by their highest ten bits."""
    return np.packbits(np.bincount((u >> np.uint64(54)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1, bitorder="little").tobytes()


class Threshold(NamedTuple):
    """Link when den * intersection >= num * union."""

    num: int
    den: int

    def prefix(self, size: int) -> int:
        return size - -(-self.num * size // self.den) + 1

    def overlap(self, x: Column, y: Column) -> Column:
        """Smallest intersection of linked sets of sizes x and y."""
        return F.ceil(self.num * (x + y) / F.lit(self.num + self.den))

    def lengths(self, x: Column, y: Column) -> Column:
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two signatures differ: the sets differ in as many shingles at least."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), F.col(text).alias("text"))


def _sets(df: DataFrame, n: int, counters: int) -> DataFrame:
    """One pass over all texts. Rows of documents: (id, size, bytes, s1, s2), the size of each set, the bytes of the text and two
    order-free 64-bit hashes of the set. Rows of the sketch: (block, counts), a task's counters, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("jaccard")
        total = np.zeros(counters, np.int32)
        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), n))
                all_of = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                total += np.bincount((all_of & np.uint64(counters - 1)).astype(np.int64), minlength=counters).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(u) for u in sets])]).astype(np.int64)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(x))]) for x in (all_of + np.uint64(1), all_of ^ np.uint64(0x5851F42D4C957F2D))]
                one, two = ((s[ends[1:]] - s[ends[:-1]]).view(np.int64) for s in sums)
                size = pa.array(np.diff(ends), pa.int64())
                width = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("id"), size, width, pa.array(one), pa.array(two), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], _SETS)
        if kind is not None:
            for k, part in enumerate(total.reshape(-1, COUNTERS)):
                if part.any():
                    one = pa.nulls(1, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), one, one, one, one, pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], _SETS)

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, size long, bytes long, s1 long, s2 long, block int, counts binary")


_SETS = ["id", "size", "bytes", "s1", "s2", "block", "counts"]


def _sketch(parts: DataFrame, counters: int) -> np.ndarray:
    """Sum of the tasks' counters: in groups of about 256 at a time, so that no task holds more; the total reaches the driver."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS, np.int64)
        for c in t.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.int32)
        total = np.minimum(total, (1 << 31) - 1).astype(np.int32)
        return pa.table([t.column("block").slice(0, 1), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["block", "counts"])

    many = -(-parts.count() // (counters // COUNTERS))
    while many > 256:
        many = -(-many // 256)
        parts = stored(parts.groupBy("block", F.pmod(F.xxhash64("counts"), F.lit(many))).applyInArrow(add, "block int, counts binary"), "counters")
    out = np.zeros(counters, np.int32)
    for r in parts.groupBy("block").applyInArrow(add, "block int, counts binary").collect():
        out[r["block"] * COUNTERS : (r["block"] + 1) * COUNTERS] = np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    return out


def _prefixes(df: DataFrame, n: int, t: Threshold, sketch: np.ndarray) -> DataFrame:
    """(id, size, s1, sig, prefix) of every document that has shingles."""
    shared = df.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("jaccard")
        counts = shared.value
        mask = np.uint64(len(counts) - 1)
        for batch in batches:
            for part in slices(batch, "text"):
                keep, size, one, sig, prefix = [], [], [], [], []
                for i, u in enumerate(shingle_sets(part.column("text"), n)):
                    if len(u):
                        order = np.argsort(counts[(u & mask).astype(np.int64)], kind="stable")[: t.prefix(len(u))]
                        keep.append(i), size.append(len(u)), one.append(mix(u + np.uint64(1)).sum(dtype=np.uint64))
                        sig.append(signature(u)), prefix.append(u[order].view(np.int64))
                sigs = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1) * (BITS // 64), pa.int32()), pa.array(np.frombuffer(b"".join(sig), np.int64)))
                prefixes = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(y) for y in prefix]), pa.int32()), pa.array(np.concatenate(prefix) if prefix else np.zeros(0), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep, pa.int64())), pa.array(size, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), sigs, prefixes], ["id", "size", "s1", "sig", "prefix"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, size long, s1 long, sig array<long>, prefix array<long>")


def _suffixed(pairs: DataFrame, lines: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b) of ``pairs`` (a, b, p) that pass the positional and the suffix filter; p is the place of the first shared shingle in a."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "sides")
    side = stored(picked(lines.select("id", "size", "sig", "prefix"), ids, "left_semi", MOST_IDS), "side")
    a, b = (side.select(*[F.col(c).alias(c if c == "id" else f"{k}{c}") for c in side.columns]).withColumnRenamed("id", k) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("q", F.expr("cast(array_position(bprefix, element_at(aprefix, p + 1)) - 1 as int)"))
    heads = F.concat(F.slice("aprefix", 1, F.col("p") + 1), F.slice("bprefix", 1, F.col("q") + 1))
    word = lambda h: F.shiftrightunsigned(h, 60)
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 54).bitwiseAND(F.lit(63)).cast("int"))
    # The heads' bits turn the difference of the sets' signatures into that of the suffixes'.
    turned = F.transform(F.zip_with("asig", "bsig", lambda x, y: x.bitwiseXOR(y)), lambda v, i: F.aggregate(F.filter(heads, lambda h: word(h) == i), v, lambda acc, h: acc.bitwiseXOR(bit(h))))
    apart = F.aggregate(turned, F.lit(0), lambda acc, v: acc + F.bit_count(v))
    x, y = F.col("asize") - F.col("p") - 1, F.col("bsize") - F.col("q") - 1
    need = t.overlap(F.col("asize"), F.col("bsize"))
    return both.filter((1 + F.least(x, y) >= need) & (2 + x + y - apart >= 2 * need)).select("a", "b").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, widths: DataFrame, n: int, t: Threshold) -> DataFrame:
    """The distinct, stored pairs (a, b) that are linked, by their whole sets; ``widths`` has the bytes of each id's text."""
    w = widths.select("id", "bytes")
    per = pairs.join(w.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("bytes").alias("all"), F.count("*").alias("n"))
    per = per.join(w.withColumnRenamed("id", "a"), "a").groupBy("a").agg(F.max(F.greatest(F.floor(F.col("all") / F.greatest(F.lit(GROUP), 16 * F.col("bytes"))), F.floor(F.col("n") / TEXTS)) + 1).alias("groups"))
    dealt = stored(pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("g")), "dealt")
    sent = stored(dealt.select("a", "g", F.lit(1).alias("o"), F.col("b").alias("id")).union(dealt.select("a", "g", F.lit(0), "a").distinct()), "sent")
    rows = docs.join(F.broadcast(sent) if sent.count() <= MOST_IDS else sent.hint("shuffle_hash"), "id").select("a", "g", "o", "id", "text")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("jaccard")
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                good = []
                tops, groups, second = part.column("a").to_pylist(), part.column("g").to_pylist(), part.column("o").to_pylist()
                for i, u in enumerate(shingle_sets(part.column("text"), n)):
                    if not second[i]:
                        at, own = (tops[i], groups[i]), u
                    elif at == (tops[i], groups[i]) and len(own) and len(u):
                        common = int((own[np.minimum(np.searchsorted(own, u), len(own) - 1)] == u).sum())
                        if common * (t.num + t.den) >= t.num * (len(u) + len(own)):
                            good.append(i)
                take = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("a").take(take), part.column("id").take(take)], ["a", "b"])

    order = rows.repartition(F.col("a"), F.col("g")).sortWithinPartitions("a", "g", "o")
    out = stored(order.mapInArrow(run, f"a {kind}, b {kind}").distinct(), "links")
    dropped(dealt, sent)
    return out


def similarity_join(df: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", key: str = "doc_id", every_pair: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links), both stored: (key, n_shingles, class_id) of every row, and verified links (a, b), a < b, between classes.

    Without ``every_pair`` the links are enough to give all components, not all links inside one."""
    small_batches(df.sparkSession)
    t, docs = Threshold(num, den), _rows(df, key, text)
    counters = 1 << min(MOST, max(LEAST, (PER_ROW * docs.count()).bit_length()))
    with Scratch(df.sparkSession) as scratch:
        found = stored(_sets(docs, n, counters), "sets")
        own = found.filter("block IS NULL").select("id", "size", "bytes", "s1", "s2")
        sketch = _sketch(found.filter("block IS NOT NULL").select("block", "counts"), counters)
        sets = ["size", "s1", "s2"]
        named = own.filter("size > 0 AND id IS NOT NULL")
        groups = stored(named.groupBy(*sets).agg(F.min("id").alias("rep"), F.max("id").alias("top")).filter("rep <> top").drop("top"), "groups")
        copies = stored(named.join(groups, sets).filter("id <> rep").select("id", "rep", "s1"), "copies")
        members = own.join(copies.select(F.col("id").alias("i"), F.col("rep"), F.col("s1").alias("s")), F.expr("id = i AND s1 = s"), "left")
        members = scratch.result(members.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id")), "members")
        several = named.count() > named.select("id").distinct().count()
        # Copies need no prefix. Few of them stay out of the texts, else of the prefixes, which are narrower.
        gone = copies.select("id").distinct()
        few = not several and gone.count() <= MOST_IDS
        texts = docs.filter("id IS NOT NULL")
        lines = _prefixes(texts.join(F.broadcast(gone), "id", "left_anti") if few else texts, n, t, sketch)
        if not few:
            lines = lines.join(copies.select("id", "s1").distinct().hint("shuffle_hash"), ["id", "s1"], "left_anti")
        lines = stored(lines.dropDuplicates(["id", "s1"]) if several else lines, "lines")
        tokens = lines.select("id", F.posexplode("prefix").alias("p", "token"))
        # Stored, so that a shingle in very many prefixes meets its rows in a join that Spark can split.
        hubs = stored(tokens.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("top")).filter("hub <> top").select("token", "hub"), "hubs")
        rows = stored(tokens.join(hubs, "token"), "rows")  # of shared shingles only; most are in one class alone
        dropped(hubs)
        facts = lines.select("id", "size", "sig")
        fits = lambda x, y: _apart(F.col(f"{x}sig"), F.col(f"{y}sig")) <= F.col(f"{x}size") + F.col(f"{y}size") - 2 * t.overlap(F.col(f"{x}size"), F.col(f"{y}size"))
        side, links, first = rows.select("token", "id", "p"), None, None
        if every_pair:
            side = side.withColumn("c", F.col("id"))
        else:
            first = rows.filter("id <> hub").groupBy("id", "hub").agg(F.min("p").alias("p")).groupBy("id").agg(F.min(F.struct("hub", "p")).alias("m")).select("id", "m.hub", "m.p")
            first = first.join(facts, "id").join(facts.select(F.col("id").alias("hub"), F.col("size").alias("hsize"), F.col("sig").alias("hsig")), "hub")
            first = stored(first.filter(t.lengths(F.col("size"), F.col("hsize")) & fits("", "h")).select(F.col("id").alias("a"), F.col("hub").alias("b"), "p").distinct(), "first")
            tried = stored(_suffixed(first, lines, t).select(F.col("b").alias("a"), F.col("a").alias("b")), "tried")
            links = _verified(tried, docs, own, n, t)
            # Two steps up the verified links: equal tops are surely in one component.
            up = links.select(F.col("b").alias("id"), F.col("a").alias("top"))
            two = up.join(up.select(F.col("id").alias("top"), F.col("top").alias("over")), "top", "left").select("id", F.coalesce("over", "top").alias("top"))
            side = side.join(two, "id", "left").withColumn("c", F.coalesce("top", "id")).drop("top")
        side = stored(side, "climbed")
        mixed = stored(side.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token"), "mixed")
        side = stored(side.join(mixed, "token", "left_semi").join(facts, "id"), "met")
        x, y = (side.select(*[F.col(c).alias(f"{k}{c}") for c in ("token", "id", "p", "size", "sig", "c")]) for k in "xy")
        left = 1 + F.least(F.col("xsize") - F.col("xp") - 1, F.col("ysize") - F.col("yp") - 1)
        met = (F.col("xtoken") == F.col("ytoken")) & (F.col("xid") < F.col("yid")) & (F.col("xc") != F.col("yc")) & t.lengths(F.col("xsize"), F.col("ysize")) & (left >= t.overlap(F.col("xsize"), F.col("ysize"))) & fits("x", "y")
        pairs = x.join(y, met).groupBy(F.col("xid").alias("a"), F.col("yid").alias("b")).agg(F.min("xp").alias("p"))
        if first is not None:  # the pairs tried before do not come again
            pairs = pairs.join(first.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = stored(_suffixed(stored(pairs, "pairs"), lines, t), "passed")
        dropped(lines, rows, side)
        rest = _verified(pairs, docs, own, n, t)
        links = scratch.result(rest if links is None else links.unionByName(rest), "links")
    return members, links


def near_duplicates(df: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row, stored; a component's id is its smallest document id."""
    with Scratch(df.sparkSession) as scratch:
        members, links = similarity_join(df, n, num, den, text, key)
        tops = stored(connected_components(links).withColumnRenamed("id", "class_id"), "tops")
        out = members.join(tops, "class_id", "left").select(key, "n_shingles", F.coalesce("component_id", "class_id").alias("component_id"))
        return scratch.result(out, "near")
