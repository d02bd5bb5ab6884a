"""Helpers shared by the training-data operators: shared storage, word splitting, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import filterfalse
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the controls from tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``. Only a session on one machine gets one of its own without it."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="gradus-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings, dots as double underscores, that hold inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy_shuffles(spark: SparkSession):
    """Writes inside delete their shuffle files once they are done: nothing reads them again."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


class Scratch:
    """Owner of the frames that :func:`stored` writes inside a ``with``; their files go at its end, also after an error.

    What :meth:`result` stores belongs to the surrounding owner, if there is one, else to whoever asked. Owners are those of
    the running context, so that queries in several threads keep apart."""

    owners: ClassVar[ContextVar[tuple[Scratch, ...]]] = ContextVar("owners", default=())

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.outer = Scratch.owners.get()
        Scratch.owners.set((*self.outer, self))
        return self

    def __exit__(self, *error) -> None:
        Scratch.owners.set(self.outer)
        for path in self.paths:
            removed(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name, owned=False)
        if self.outer:
            self.outer[-1].paths.append(out._gradus_path)
        return out


def stored(df: DataFrame, name: str, owned: bool = True) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if owned and (owners := Scratch.owners.get()):
        owners[-1].paths.append(path)
    with tidy_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gradus_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of frames made by :func:`stored` once nothing reads them any more."""
    for df in frames:
        removed(df.sparkSession, df._gradus_path)


def picked(df: DataFrame, ids: DataFrame, how: str, most: int, key: str = "id", more: tuple[str, ...] = ()) -> DataFrame:
    """``df`` joined by its ``key`` with the stored, distinct ``ids`` (id): broadcast up to ``most`` ids, else a shuffle without a sort.

    ``more`` names further columns that must agree."""
    ids = ids.withColumnRenamed("id", key)
    return df.join(F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_hash"), [key, *more], how)


def id_hash_mod(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n``: the fixed train / held-out division."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of the session hold 4 MB, where its user has not set a size: by default thousands of texts go together."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "4m")


def bounded_sample(df: DataFrame, h: Column, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` at most: those whose hash ``h`` is in a range that depends on the number of rows alone."""
    n = df.count()
    return df if n <= most else df.filter(h.bitwiseAND(F.lit(0x7FFFFFFF)) < int(most / n * (1 << 31)))


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns memory that is free to the system, where the C library can: a Python worker lives on beside the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str | int, most: int = 2 << 20):
    """Parts of a batch that hold about ``most`` bytes of text at a time, so that memory stays bounded."""
    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most)))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo:
    """Table of strings already worked on, in two generations of ``most`` entries and ``MOST_CHARS`` characters each: what stays
    in use survives. Strings of more than ``LONG`` characters serve one call only.

    A Python worker outlives its stage, so tables of another ``owner`` are emptied when one of this owner is used."""

    LONG, MOST_CHARS = 256, 8 << 20
    everyone: ClassVar[weakref.WeakSet] = weakref.WeakSet()
    in_use: ClassVar[str] = ""

    def __init__(self, make: Callable[[list[str]], Iterable], most: int, owner: str):
        self.make, self.most, self.owner = make, most, owner
        self.empty()
        Memo.everyone.add(self)

    @classmethod
    def enter(cls, owner: str) -> None:
        """Empties the tables of all other owners, once."""
        if cls.in_use != owner:
            cls.in_use = owner
            for memo in cls.everyone:
                if memo.owner != owner:
                    memo.empty()
            gc.collect()
            give_back()

    def empty(self) -> None:
        self.new, self.old, self.chars, self.once = {}, {}, 0, []

    def table(self, rows: list[list[str]]) -> dict:
        """A dict that holds every string of ``rows``."""
        Memo.enter(self.owner)
        for w in self.once:
            self.new.pop(w, None)
        self.once = []
        if len(self.new) > self.most or self.chars > self.MOST_CHARS:
            self.old, self.new, self.chars = self.new, {}, 0
        missing: set[str] = set()
        for r in rows:
            missing.update(filterfalse(self.new.__contains__, r))
        asked = []
        for w in missing:
            if (got := self.old.get(w)) is None:
                asked.append(w)
            else:
                self.new[w] = got
            if len(w) > self.LONG:
                self.once.append(w)
            else:
                self.chars += len(w)
        self.new.update(zip(asked, self.make(asked)))
        return self.new


_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, count=n + 1, offset=column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return raw[first:last], offsets - first


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: 64-bit hashes, start and end bytes, and the n + 1 offsets into the words by text.

    A word's hash folds in eight bytes at a time, so that it depends on the word alone."""
    raw, offsets = text_buffer(column)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SEP[raw]
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cuts[1:-1]
    starts = np.flatnonzero(begins)
    ends_mark = inside.copy()
    ends_mark[:-1] &= ~inside[1:] | cuts[1:-1]
    ends = np.flatnonzero(ends_mark) + 1
    by_text = np.searchsorted(starts, offsets)
    data = _LOWER[raw] if lower else raw
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) + _BASE)
    left, at, live = lengths.copy(), starts.copy(), np.arange(len(starts))
    lanes = np.lib.stride_tricks.sliding_window_view(padded, 8)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    while len(live):
        piece = np.ascontiguousarray(lanes[at]).view("<u8").ravel() & masks[np.minimum(left, 8)]
        hashes[live] = mix((hashes[live] + _BASE) ^ mix(piece + _BASE))
        keep = left > 8
        left, at, live = left[keep] - 8, at[keep] + 8, live[keep]
    return hashes, starts, ends, by_text


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes; the order of the words counts.

    A polynomial over the word hashes, joined from runs of lengths 1, 2, 4 and so on."""
    if n < 1 or len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    run, power, length = words, int(_BASE), 1  # sums over ``length`` words, and the base to that power
    out, done = np.zeros(size, np.uint64), 0
    while done < n:
        if n & length:
            out = out * np.uint64(power) + run[done : done + size]
            done += length
        if done < n:
            run = run[: len(run) - length] * np.uint64(power) + run[length:]
            power = power * power & (1 << 64) - 1
            length *= 2
    return mix(out + np.uint64(n))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component_id): every id of ``edges`` with the smallest id it reaches.

    Alternates large-star and small-star steps until the edge set is a forest of stars around the minima. Each round is
    two shuffles by id, hubs are only ever grouped through a minimum, and every round is stored in the shared folder."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        new = stored(small.select("a", "b"), "edges")
        same = new.join(e, ["a", "b"], "left_anti").isEmpty() and e.join(new, ["a", "b"], "left_anti").isEmpty()
        dropped(e)
        e = new
        if same:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
