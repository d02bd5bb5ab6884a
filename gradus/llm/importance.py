"""Importance resampling of a corpus towards a target, by hashed n-gram features over a dictionary of words.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. The dictionary gives every
distinct word of corpus and target an integer id, once. A feature is a tuple of ids; the distinct tuples are counted, each is
spelt out and its bytes hashed into a bucket once, and bucket counts of corpus and target give each bucket's gain. Gains are
joined back to the tuples, and a document's weight is the sum over its features: those of common tuples are looked up where
the text lies, all others meet their gains in a join by tuple, as (text, tuple, count) rows. A word is its own tuple of one,
so that runs of one word need no second table.

The draw takes the highest scores, weight plus Gumbel noise that comes from a hash of seed and id. Ranks come from a range
partition by score, with one count for each range, so that no task sorts all rows.

Null texts and texts without a word have no features and weight 0. A row without an id draws its noise from an empty id
and comes last among ties; rows repeated under one id, with the same or other texts, are documents each. Texts are whole, of any
length. With an empty target every bucket's gain tells of the corpus alone. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import Scratch, small_batches, stored
from gradus.llm.words import HEAD, Splitter, binaries, counted, head, letters_and_digits, md5, rare_pairs, rewritten, together

BUCKETS = 10_000
#: Rows of a range that are ranked together.
PER_RANGE = 200_000


def spelt_buckets(tuples: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """(word, n, s, t, bucket) of distinct tuples, binary columns of 64-bit ids: each is spelt out through the dictionary and hashed once."""
    ids = F.expr("transform(sequence(0, length(word) div 8 - 1), i -> conv(hex(substring(word, i * 8 + 1, 8)), 16, 10))")
    place = tuples.select("word", F.posexplode(F.transform(ids, lambda x: x.cast("long"))).alias("i", "id"))
    spelt = place.join(words.select("id", F.col("word").alias("w")), "id").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("i", F.col("w").cast("string").alias("w")))).alias("x"))
    hashed = spelt.select("word", F.pmod(F.crc32(F.array_join("x.w", " ").cast("binary")), F.lit(buckets)).alias("bucket"))
    return tuples.join(hashed, "word")


def runs(n: int) -> Splitter:
    """Splitter of id rows, binary columns of big-endian 64-bit ids, into all tuples of exactly ``n`` neighbours."""

    def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        flat = np.frombuffer(b"".join(x or b"" for x in column.to_pylist()), ">i8")
        starts, count = np.cumsum(sizes) - sizes, np.maximum(sizes - n + 1, 0)
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], count) + np.repeat(starts, count)
        own = flat[at[:, None] + np.arange(n)] if len(at) else np.zeros((0, n), ">i8")
        return binaries(np.ascontiguousarray(own).view(np.uint8).ravel(), np.arange(len(at) + 1) * 8 * n), ends

    return split


def _gains(table: DataFrame, buckets: int) -> DataFrame:
    """``table`` (word, n, s, t, bucket) with each bucket's gain; sums are taken by bucket, of which there are ``buckets`` at most."""
    total = table.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    by = table.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    one, more = F.lit(1.0), float(buckets)
    ratio = (F.col("t") + one) * F.lit(total["s"] + more) / ((F.col("s") + one) * F.lit(total["t"] + more))
    return table.join(F.broadcast(by.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))), "bucket").select("word", "n", "gain")


def _both(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """(word, n, s, t) of the words, or tuples, of both: counts in the corpus and in the target."""
    parts = corpus.withColumns({"s": F.col("n"), "t": F.lit(0)}).unionByName(target.withColumns({"s": F.lit(0), "t": F.col("n")}))
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("t").alias("t"))


def masked(column: pa.Array, hidden: np.ndarray) -> pa.Array:
    """``column`` with nulls where ``hidden``. Arrow's if_else of a slice of a binary array and a null scalar gives offsets out of bounds."""
    return column.take(pa.array(np.arange(len(column)), mask=hidden))


def _sums(docs: DataFrame, table: DataFrame, split: Splitter, most: int) -> DataFrame:
    """(r, n_features, weight): numbers of features and sums of gains of the rows (r, text), stored."""
    shared = docs.sparkSession.sparkContext.broadcast(head(table, "gain", most))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in together(batches, "text"):
            words, offsets = split(part.column("text"))
            places = shared.value.of(words)
            gains = pc.fill_null(shared.value.payload.take(places), 0).to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(gains, dtype=np.int64)])
            lacking = np.concatenate([[0], np.cumsum(np.asarray(places.is_null()), dtype=np.int64)])
            per = lambda x: pa.array(x[offsets[1:]] - x[offsets[:-1]])
            m = masked(part.column("m"), lacking[offsets[1:]] == lacking[offsets[:-1]])
            yield pa.RecordBatch.from_arrays([part.column("r"), m, pa.array(np.diff(offsets).astype(np.int64)), per(total)], ["r", "m", "n_features", "w"])

    small_batches(docs.sparkSession)
    kind = docs.schema["r"].dataType.simpleString()
    rows = stored(docs.select("r", md5("text").alias("m"), "text").mapInArrow(near, f"r {kind}, m binary, n_features long, w long"), "sums")
    # Copies of a text send the same rows, so that a sum over all of them is that of one text times their number.
    pairs = rare_pairs(docs.filter("text IS NOT NULL").select(md5("text").alias("m"), "text"), split, shared)
    far = stored(pairs.join(table.select("word", "gain"), "word").groupBy("m").agg(F.sum(F.col("k") * F.col("gain")).alias("more")), "far")
    copies = stored(rows.filter("m IS NOT NULL").groupBy("m").agg(F.count("*").alias("copies")), "copies")
    per = far.join(copies, "m").select("m", F.expr("more div copies").alias("more"))
    met = rows.filter("m IS NOT NULL").join(stored(per, "per"), "m").select("r", "n_features", (F.col("w") + F.col("more")).alias("weight"))
    return stored(rows.filter("m IS NULL").select("r", "n_features", F.col("w").alias("weight")).unionByName(met), "weights")


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, most: int = HEAD) -> DataFrame:
    """(r, words, n_features, weight) of rows (r, text): features are all runs of 1 to ``n`` words, counted with repeats."""
    words = stored(_both(counted(docs, letters_and_digits), counted(target, letters_and_digits)).withColumn("id", F.monotonically_increasing_id()), "dictionary")
    plain = words.withColumn("bucket", F.pmod(F.crc32("word"), F.lit(buckets)))
    if n == 1:
        table = stored(_gains(plain, buckets), "gains")
        return _sums(docs, table, letters_and_digits, most).withColumn("words", F.col("n_features"))
    # Longer runs: texts as rows of ids, then the same steps over tuples of ids in place of words.
    coded = words.withColumn("code", F.expr("unhex(lpad(hex(id), 16, '0'))"))
    ids = lambda df, key: rewritten(df, coded, "code", letters_and_digits, key=key, most=most, finish=lambda x: x.withColumnRenamed("code", "text"))
    own, other = ids(docs, "r"), ids(target.select(F.lit(0).alias("r"), "text"), "r")
    tables = [plain.select("word", "n", "s", "t", "bucket", F.lit(1).alias("size"))]
    for size in range(2, n + 1):
        tuples = stored(_both(counted(own, runs(size)), counted(other, runs(size))), "tuples")
        tables.append(spelt_buckets(tuples, words, buckets).select("word", "n", "s", "t", "bucket", F.lit(size).alias("size")))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    every = stored(every, "features")
    gains = stored(_gains(every.withColumn("word", F.struct("word", "size")), buckets).select("word.word", "word.size", "n", "gain"), "gains")
    out = _sums(docs, gains.filter("size = 1").drop("size"), letters_and_digits, most).withColumn("words", F.col("n_features"))
    for size in range(2, n + 1):
        out = out.unionByName(_sums(own, gains.filter(f"size = {size}").drop("size"), runs(size), most).withColumn("words", F.lit(0)))
    return stored(out.groupBy("r").agg(F.sum("words").alias("words"), F.sum("n_features").alias("n_features"), F.sum("weight").alias("weight")), "weights")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 g), g Gumbel noise of the first 32 bits of sha256('seed:key')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], per: int = PER_RANGE) -> DataFrame:
    """Stored ``rows`` with ``rank`` from 1 in ``order``, which must tell rows apart: ranges of the order are sorted one by one."""
    ranges = max(1, -(-rows.count() // per))
    dealt = stored(rows.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    before, sizes = 0, []
    for r in sorted(dealt.groupBy("_p").count().collect()):
        sizes.append((r["_p"], before))
        before += r["count"]
    base = F.broadcast(rows.sparkSession.createDataFrame(sizes, "_p int, _before long"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_i", inside).join(base, "_p").withColumn("rank", F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def resample(df: DataFrame, target: DataFrame, n: int = 1, least_words: int = 20, percent: int = 10, seed: int = 2024, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id", most: int = HEAD, per: int = PER_RANGE) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row, stored; ``rank`` is null for what is not drawn.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn, rounded down."""
    with Scratch(df.sparkSession) as scratch:
        rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
        target = target.select(F.col(text).alias("text"))
        if n == 1:  # one sum a row, so that ids can stay with the texts
            sums = weights(rows.withColumnRenamed("id", "r"), target, n, buckets, most).withColumnRenamed("r", "id")
        else:
            rows = stored(rows.withColumn("r", F.monotonically_increasing_id()), "rows")
            sums = rows.select("r", "id").join(weights(rows.select("r", "text"), target, n, buckets, most), "r").drop("r")
        scored = stored(sums.withColumns({"score": F.col("weight") + noise(F.col("id"), seed), "r": F.monotonically_increasing_id()}), "scored")
        fit = scored.filter(F.col("words") >= least_words)
        taken = fit.count() * percent // 100
        placed = ranked(fit, [F.desc("score"), F.asc_nulls_last("id"), F.asc("r")], per)
        rank = F.when(F.col("rank") <= taken, F.col("rank")).cast("long").alias("rank")
        out = placed.select("id", "n_features", "weight", "score", rank).unionByName(scored.filter(F.col("words") < least_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
        return scratch.result(out.withColumnRenamed("id", key), "resampled")
