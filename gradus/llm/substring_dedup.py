"""Substring deduplication with a log-structured index of window fingerprints.

A window is ``n`` consecutive words of one document; a word goes if a window that covers it also starts in a document with a
smaller id. A window's fingerprint is the smallest hash of its ``gram``-word runs, so that neighbouring windows mostly share
theirs and equal windows always do. The index holds, for each batch of documents, an immutable run: a table of
(fingerprint, id, text hash), bucketed and sorted by fingerprint. A new batch is written as a run and merge-joined with itself and
the older runs, bucket by bucket, without a shuffle or a sort. Once ``fan`` runs have gathered, the next batch compacts them into one first. Fingerprints
found in two documents mark both. At the end the marked documents' windows behind shared fingerprints are verified, once for
all batches: they are compared by the hash of all their words, and the smallest id that has one wins. Texts are thus read
once to index and once to verify, however many batches there are.

Fingerprints that hold more than 1 / ``HOT`` of a batch's rows, found by a sketch of frequent items, do not enter the bucketed
runs, where one bucket would have to hold them: their rows lie in a plain table and are all marked, and the at most ``2 * HOT``
such fingerprints are broadcast. Copies of a smaller id's whole text skip the index. Windows meet their smallest id in a join
of two stored tables, whose hot groups Spark splits.

An index given to :func:`dedup` stays open, so that the next call judges new documents against all earlier ones (``history``)
without indexing those again. Words are separated by space and the bytes from tab to carriage return.

Null texts and texts shorter than a window keep all they have. Rows without an id keep all their words and remove no others'.
Rows under one id do not remove each other's words; each of its texts is judged by itself. Texts are whole, of any length; ids of any ordered type. An empty
table gives an empty result. Other columns are read by :func:`trimmed` alone, which passes them through.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gradus.llm.common import Memo, Scratch, dropped, gram_hashes, picked, removed, settings, shared_dir, slices, small_batches, stored, tidy_shuffles, word_hashes

WINDOW, GRAM, FAN, BATCHES = 13, 6, 2, 3
#: Most ids that are broadcast to pick out texts; more are shuffled.
MOST_IDS = 1_000_000
#: A fingerprint with more than this part of a batch's rows is hot; items that the sketch tracks.
HOT, TRACKED = 512, 10_000
#: Rows that a bucket of a run holds on average at most.
PER_BUCKET = 4_000_000
#: Scans of bucketed tables keep their buckets and the order of the one file in each.
ORDERED = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true", "spark__sql__sources__bucketing__autoBucketedScan__enabled": "false"}


def fingerprints(words: np.ndarray, offsets: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts: place of the first word, number of the text, fingerprint."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    low, span, left = gram_hashes(words, gram), 1, n - gram + 1
    while span < left:  # minima over runs of 1, 2, 4, ... and at last of all grams in a window
        step = min(span, left - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return place, text, low[place]


def _take(column: pa.Array, at: np.ndarray) -> pa.Array:
    return column.take(pa.array(at, pa.int64()))


def _anchors(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """(fp, id, h): the fingerprints of each document, those of neighbouring windows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("substring")
        for batch in batches:
            for part in slices(batch, "text"):
                words, _, _, offsets = word_hashes(part.column("text"))
                _, text, fp = fingerprints(words, offsets, n, gram)
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), _take(part.column("id"), text[new]), _take(part.column("h"), text[new])], ["fp", "id", "h"])

    return docs.mapInArrow(run, f"fp long, id {docs.schema['id'].dataType.simpleString()}, h long")


def _windows(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """(w, id, h): hashes of the windows whose fingerprint is among the document's ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("substring")
        for batch in batches:
            for part in slices(batch, "text"):
                words, _, _, offsets = word_hashes(part.column("text"))
                place, text, fp = fingerprints(words, offsets, n, gram)
                whole = gram_hashes(words, n)
                cut = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=part.num_rows))])
                out, who = [], []
                lists = part.column("fps")
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
                for i in range(part.num_rows):
                    a, b = cut[i], cut[i + 1]
                    hit = np.isin(fp[a:b], flat[ends[i] : ends[i + 1]])
                    got = np.unique(whole[place[a:b][hit]])
                    out.append(got), who.append(np.full(len(got), i))
                at = np.concatenate(who)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), _take(part.column("id"), at), _take(part.column("h"), at)], ["w", "id", "h"])

    return docs.mapInArrow(run, f"w long, id {docs.schema['id'].dataType.simpleString()}, h long")


class FingerprintIndex:
    """Runs of the batches seen so far, below the shared folder; :meth:`close` deletes them.

    A run is a table bucketed by fingerprint, one sorted file for each bucket, so that runs join as they lie: read with
    :data:`ORDERED`, neither side is shuffled or sorted again. All runs have the same number of buckets, which grows when compaction
    rewrites them."""

    def __init__(self, spark: SparkSession, n: int = WINDOW, gram: int = GRAM, fan: int = FAN):
        self.spark, self.n, self.gram, self.fan = spark, n, min(gram, n), fan
        self.buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.runs: list[str] = []
        self.hot: list[str] = []
        self.paths: dict[str, str] = {}
        self.compactions = 0

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def _place(self, kind: str) -> tuple[str, str]:
        """Name of a new table, and the option that puts it into the shared folder."""
        name = f"gradus_{kind}_{uuid.uuid4().hex}"
        self.paths[name] = f"{shared_dir(self.spark)}/{name}"
        return name, self.paths[name]

    def _write(self, rows: DataFrame) -> tuple[str, str | None, list[int]]:
        """Names of the run and of the hot rows' table, if there are any, and the hot fingerprints, old and new."""
        found = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(fp, {2 * HOT}, {TRACKED})").alias("top")).first()
        if not self.runs:  # later batches are about as large, up to the next compaction
            self.buckets = max(self.buckets, found["n"] * max(1, self.fan - 1) // PER_BUCKET)
        known = [r["fp"] for r in self._of(self.hot).select("fp").distinct().collect()] if self.hot else []  # 2 * HOT a run at most
        hot = sorted({*known, *(x["item"] for x in found["top"] or [] if x["count"] > max(1, found["n"] // HOT))})
        run, at = self._place("run")
        listed = F.broadcast(self.spark.createDataFrame([(v,) for v in hot], "fp long"))
        with tidy_shuffles(self.spark):
            self.runs.append(run)
            plain = rows.join(listed, "fp", "left_anti") if hot else rows
            plain.repartition(self.buckets, "fp").write.format("parquet").option("path", at).bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(run)
            if hot:
                aside, at = self._place("hot")
                self.hot.append(aside)
                rows.join(listed, "fp", "left_semi").write.format("parquet").option("path", at).saveAsTable(aside)
        return run, aside if hot else None, hot

    def _of(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def merged(self, run: str, other: str) -> DataFrame:
        """Rows of ``run`` whose fingerprints the other run holds as well: sorted buckets are merged as they lie."""
        return self.spark.table(run).join(self.spark.table(other).select("fp").hint("merge"), "fp", "left_semi")

    def add(self, batch: DataFrame) -> DataFrame:
        """Indexes a batch of (id, h, text): (fp, id, h) of its documents and earlier ones that share fingerprints, stored.

        Runs that have gathered are compacted first."""
        small_batches(self.spark)
        if len(self.runs) >= self.fan:
            self.compact()
        with Scratch(self.spark) as scratch:
            rows = stored(_anchors(batch, self.n, self.gram), "anchors")
            old, aside = list(self.runs), list(self.hot)
            new, hot_rows, hot = self._write(rows)
            dropped(rows)
            with settings(self.spark, **ORDERED):
                own = self.spark.table(new)
                low = own.groupBy("fp").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("fp")
                parts = [own.join(low.hint("merge"), "fp", "left_semi")]
                for run in old:  # both ways: what the run shares with the batch, and the batch with the run
                    parts += [self.merged(run, new), self.merged(new, run)]
                if hot:
                    listed = F.broadcast(self.spark.createDataFrame([(v,) for v in hot], "fp long"))
                    parts += [self.spark.table(name).join(listed, "fp", "left_semi") for name in old + aside]
                    parts.append(self.spark.table(hot_rows))
                marked = parts[0]
                for part in parts[1:]:
                    marked = marked.unionByName(part)
                return scratch.result(marked, "marked")

    def compact(self) -> None:
        """Merges all runs into one; a fingerprint that is hot no more joins the others."""
        runs, aside, self.runs, self.hot = self.runs, self.hot, [], []
        try:
            self._write(self._of(runs + aside))
        finally:
            self._drop(runs + aside)
        self.compactions += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, self.paths.pop(name))

    def close(self) -> None:
        self._drop(self.runs + self.hot)
        self.runs, self.hot = [], []


def _cut(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """``text`` without the words marked in ``gone`` and the separators after them."""
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    out.append(text[at:])
    return b"".join(out)


def _trimmed(rows: DataFrame, at: int, n: int, digest: bool) -> DataFrame:
    """Applies the hits ``_ws`` and ``_copy``, the last two columns of ``rows``, to the text, its column ``at``.

    With ``digest`` the columns before them are followed by n_words, n_removed, kept_sha256, else by n_removed alone."""
    own = rows.columns[:-2]
    counts = [StructField("_n_words", LongType()), StructField("_n_removed", LongType()), StructField("_kept_sha256", StringType())]
    more_fields = counts if digest else counts[1:2]
    names = [f.name for f in more_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.enter("substring")
        for batch in batches:
            for part in slices(batch, at):
                size, removed, sha, kept = [], [], [], []
                column, copies = part.column(at), part.column(len(own) + 1).to_pylist()
                hits = part.column(len(own))
                some = np.flatnonzero(np.asarray(hits.is_valid()))
                got = {}
                if len(some):
                    words, starts, ends, offsets = word_hashes(_take(column, some))
                    base = np.concatenate([[0], np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in _take(column, some).cast(pa.binary())])])
                    whole = gram_hashes(words, n)
                    for k, i in enumerate(some):
                        a, b = int(offsets[k]), int(offsets[k + 1])
                        gone = np.zeros(b - a, bool)
                        if b - a >= n:
                            first = np.flatnonzero(np.isin(whole[a : b - n + 1], hits[int(i)].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                            cover = np.zeros(b - a + 1, np.int64)
                            np.add.at(cover, first, 1)
                            np.add.at(cover, first + n, -1)
                            gone = np.cumsum(cover[:-1]) > 0
                        got[int(i)] = (gone, starts[a:b] - base[k], ends[a:b] - base[k])
                for i, text in enumerate(column.to_pylist()):
                    raw = (text or "").encode()
                    words = raw.split() if digest or copies[i] else []
                    gone, left, new = 0, words, text
                    if copies[i] and len(words) >= n:
                        gone, left, new = len(words), [], ""
                    elif i in got:
                        mask, starts, ends = got[i]
                        gone = int(mask.sum())
                        new = _cut(raw, starts, ends, mask).decode() if gone else text
                        left = [w for w, g in zip(words, mask.tolist()) if not g]
                    removed.append(gone), kept.append(new)
                    if digest:
                        size.append(len(words)), sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
                columns = [*part.columns[:-2]]
                columns[at] = pa.array(kept, pa.string())
                more = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())] if digest else [pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + more, own + names)

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-2], *more_fields]))


def _found(docs: DataFrame, n: int, batches: int, gram: int, fan: int, index: FingerprintIndex | None, history: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """For (id, text): stored (id, ws), the hashes of each document's windows that start in a smaller id; and ids of copies."""
    spark = docs.sparkSession
    keys = ["id", "h"]
    with Scratch(spark) as scratch:
        given = docs.filter("text IS NOT NULL AND id IS NOT NULL")
        prints = given.select(*keys, F.md5(F.col("text").cast("binary")).alias("m"), F.length("text").alias("l"))
        # Stored, so that the join below is one of two plain inputs, whose hot groups Spark can split.
        first = stored(prints.groupBy("m", "l").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi"), "groups")
        copies = scratch.result(prints.join(first, ["m", "l"]).filter("id > lo").select(*keys).distinct(), "copies")
        dropped(first)
        fresh = picked(given, copies, "left_anti", MOST_IDS, more=("h",))
        own = index or FingerprintIndex(spark, n, gram, fan)
        try:
            part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(batches))
            marked = [own.add(fresh.filter(part == k)) for k in range(batches)]
        finally:
            if index is None:
                own.close()
        rows = marked[0]
        for more in marked[1:]:
            rows = rows.unionByName(more)
        lists = stored(rows.groupBy(*keys).agg(F.collect_set("fp").alias("fps")), "lists")
        dropped(*marked)
        texts = fresh if history is None else fresh.unionByName(history.filter("text IS NOT NULL AND id IS NOT NULL"))
        windows = stored(_windows(picked(texts, lists.select(*keys), "left_semi", MOST_IDS, more=("h",)).join(lists.hint("shuffle_hash"), keys), n, min(gram, n)), "windows")
        dropped(lists)
        low = stored(windows.groupBy("w").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("w", "lo"), "first")
        hits = windows.join(low, "w").filter("id > lo").groupBy(*keys).agg(F.collect_set("w").alias("ws"))
        return scratch.result(hits, "hits"), copies


def _judged(df: DataFrame, key: str, text: str, n: int, batches: int, gram: int, fan: int, index: FingerprintIndex | None, history: DataFrame | None, digest: bool) -> DataFrame:
    small_batches(df.sparkSession)
    # A document is an id and a text. Where no id has two rows, the id says it all, and nothing else has to travel.
    rows, ids = df.agg(F.count(key), F.count_distinct(key)).first()
    alone = rows == ids and index is None and history is None
    h = (lambda column: F.lit(0).cast("long")) if alone else (lambda column: F.xxhash64(column))
    docs = df.select(F.col(key).alias("id"), h(F.col(text)).alias("h"), F.col(text).alias("text"))
    if history is not None:
        history = history.select(F.col(key).alias("id"), h(F.col(text)).alias("h"), F.col(text).alias("text"))
    hits, copies = _found(docs, n, batches, gram, fan, index, history)
    lists = hits.select("id", "h", "ws", F.lit(False).alias("copy")).unionByName(copies.select("id", "h", F.lit(None).cast("array<long>").alias("ws"), F.lit(True).alias("copy")))
    # Rows without hits stay where they are; the rest meets its hits.
    touched = stored(lists.select("id", "h").distinct(), "touched")
    names, at = df.columns, df.columns.index(text)
    rows = df.select(F.col(key).alias("id"), h(F.col(text)).alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    own = [f"c{i}" for i in range(len(names))]
    plain = picked(rows, touched, "left_anti", MOST_IDS, more=("h",)).select(*own, F.lit(None).cast("array<long>").alias("_ws"), F.lit(False).alias("_copy"))
    met = picked(rows, touched, "left_semi", MOST_IDS, more=("h",)).join(lists.hint("shuffle_hash"), ["id", "h"]).select(*own, F.col("ws").alias("_ws"), F.col("copy").alias("_copy"))
    return _trimmed(plain, at, n, digest).unionByName(_trimmed(met, at, n, digest))


def dedup(df: DataFrame, n: int = WINDOW, batches: int = BATCHES, text: str = "text", key: str = "doc_id", texts: bool = False, gram: int = GRAM, fan: int = FAN, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256 and, with ``texts``, the text that is left) of every row, stored.

    The table goes through the index in ``batches`` parts of equal size. A given ``index`` must have been built with the same
    ``n`` and ``gram``; ``history`` then holds the documents it indexed before."""
    with Scratch(df.sparkSession) as scratch:
        out = _judged(df.select(key, text), key, text, n, batches, gram, fan, index, history, True)
        return scratch.result(out.select(F.col("c0").alias(key), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"), *[F.col("c1").alias(text)] * texts), "deduplicated")


def trimmed(df: DataFrame, n: int = WINDOW, batches: int = BATCHES, text: str = "text", key: str = "doc_id", gram: int = GRAM, fan: int = FAN, removed: str | None = None) -> DataFrame:
    """``df`` with all its columns and what is left of each text; ``removed`` names a column for the number of words cut."""
    out = _judged(df, key, text, n, batches, gram, fan, None, None, False)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col("_n_removed").alias(removed)] * bool(removed))
