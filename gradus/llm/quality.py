"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Each token counts as two words: its lower-case core and its shape (``Xx.``, ``X+!+``, ``x+$+``; a token whose core is that of the
one before has the shape AGAIN), and each text ends with an END token. Words are hashed to a fixed number of buckets. Every
bucket has a sparse random index vector; a bucket's word vector is the sum of the index vectors of its neighbours' buckets over
the whole corpus, centred and scaled to unit length. A document is the mean of its words' vectors and of its shapes' vectors.
The network has one hidden layer; its logits are divided by a temperature that fits a held-out part of the training rows, so
that the scores are probabilities.

Word vectors come from all documents by one distributed sum of ``BUCKETS`` rows; the network takes at most ``SAMPLE``
labelled rows, those in a range of the hash of id and text. Scores cover whole texts, of any length.

Null and empty texts are a document of the END token alone. Without labelled rows, or with one class alone, every score is the
share of label 1 (0.5 without rows). Several labels of one document count as their largest; a null id has no label. Rows
repeated under one id count once in training and are scored alike. An empty table gives an empty result. Other columns are not
read, and :func:`scored` passes them through, but for those named like its results, which these replace.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gradus.llm.common import Memo, bounded_sample, slices, small_batches

#: Word buckets, shape buckets, dimensions, non-zero entries of an index vector.
WORDS, SHAPES, DIMENSIONS, ENTRIES = 4096, 1024, 64, 4
BUCKETS = WORDS + SHAPES
#: Buckets of the shapes of a repeated word and of the end of a text; length of a document vector.
AGAIN, END, WIDTH = BUCKETS - 2, BUCKETS - 1, 2 * DIMENSIONS
#: Most labelled rows, hidden units, epochs; entries of a worker's table of tokens.
SAMPLE, HIDDEN, EPOCHS, CACHE = 20_000, 24, 60, 120_000
THRESHOLD = 0.3
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def shape(token: str) -> str:
    """Letters as X or x, digits as 0, other characters as themselves; a run of one sign as the sign and ``+``.

    Tokens of any length count whole; long ones are marked a part at a time, so that memory stays near their size."""
    marks = "".join("".join(["x" if c.islower() else "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in token[at : at + 4096]]) for at in range(0, len(token), 4096))
    return _RUN.sub(r"\1+", marks)


def buckets(tokens: list[str]) -> list[bytes]:
    """Word and shape bucket of each token, as two unsigned 16-bit numbers."""
    out = []
    for t in tokens:
        word = t.lower() if t.isalpha() else re.sub(r"^\W+|\W+$", "", t.lower())
        pair = (zlib.crc32(word.encode("utf-8", "replace")) % WORDS, WORDS + zlib.crc32(shape(t).encode("utf-8", "replace")) % (SHAPES - 2))
        out.append(pair[0].to_bytes(2, "little") + pair[1].to_bytes(2, "little"))
    return out


_MEMO = Memo(buckets, CACHE, "quality")


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) buckets of all tokens, an END token after each text, and the offsets of the texts."""
    rows = [(t or "").split() for t in texts]
    get = _MEMO.table(rows).__getitem__
    end = zlib.crc32(b"") % WORDS
    mark = end.to_bytes(2, "little") + END.to_bytes(2, "little")
    raw = b"".join([b"".join(map(get, r)) + mark for r in rows])
    pairs = np.frombuffer(raw, "<u2").reshape(-1, 2).copy()
    offsets = np.cumsum([0] + [len(r) + 1 for r in rows])
    again = np.zeros(len(pairs), bool)
    again[1:] = pairs[1:, 0] == pairs[:-1, 0]
    again[offsets[:-1]] = False
    again[offsets[1:] - 1] = False
    pairs[again, 1] = AGAIN
    return pairs, offsets


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places.astype(np.int64), rng.choice([-1, 1], (BUCKETS, ENTRIES))


def context_sums(pairs: np.ndarray, offsets: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for each bucket; neighbours are the next tokens on both sides, of either kind."""
    out = np.zeros(BUCKETS * DIMENSIONS)
    if len(pairs) < 2:
        return out
    inside = np.ones(len(pairs) - 1, bool)
    cuts = offsets[(offsets > 0) & (offsets < len(pairs))]
    inside[cuts - 1] = False
    left, right = pairs[:-1][inside], pairs[1:][inside]
    for kind in (0, 1):
        # Counts of (bucket, neighbour) pairs come first; each pair then adds its index vector once, weighted.
        a, b = left[:, kind].astype(np.int64), right[:, kind].astype(np.int64)
        codes, n = np.unique(np.concatenate([a * BUCKETS + b, b * BUCKETS + a]), return_counts=True)
        who, other = codes // BUCKETS, codes % BUCKETS
        for e in range(ENTRIES):
            out += np.bincount(who * DIMENSIONS + places[other, e], n * signs[other, e], len(out))
    return out


def word_vectors(df: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets, summed over every text of ``df``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for part in slices(batch, "text"):
                total += context_sums(*tokens(part.column("text").to_pylist()), places, signs)
        rows = total.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(rows.any(axis=1))
        for at in range(0, len(used), 1000):
            own = used[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[pa.array(rows[own, c].astype(np.float32)) for c in range(DIMENSIONS)]], ["bucket", *[f"v{c}" for c in range(DIMENSIONS)]])

    parts = df.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, " + ", ".join(f"v{c} float" for c in range(DIMENSIONS)))
    summed = parts.groupBy("bucket").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(DIMENSIONS)])
    got = summed.toArrow()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, DIMENSIONS))
    out[got.column("bucket").to_numpy()] = np.stack([got.column(f"v{c}").to_numpy() for c in range(DIMENSIONS)], axis=1)
    out = np.sign(out) * np.log1p(np.abs(out))
    used = out.any(axis=1)
    if used.any():
        out[used] -= out[used].mean(axis=0)
        out[used] /= np.maximum(np.linalg.norm(out[used], axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def bucket_means(pairs: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, block: int = 64) -> np.ndarray:
    """Mean word vector and mean shape vector of each text: bucket counts of a few texts at a time, times the vectors."""
    n = np.diff(offsets)
    out = np.zeros((len(n), 2 * DIMENSIONS), np.float32)
    for at in range(0, len(n), block):
        stop = min(len(n), at + block)
        own = pairs[offsets[at] : offsets[stop]].astype(np.int64)
        text = np.repeat(np.arange(stop - at), n[at:stop])
        for kind, first, size in ((0, 0, WORDS), (1, WORDS, SHAPES)):
            counts = np.bincount(text * size + own[:, kind] - first, minlength=(stop - at) * size).reshape(-1, size).astype(np.float32)
            out[at:stop, kind * DIMENSIONS : (kind + 1) * DIMENSIONS] = counts @ vectors[first : first + size]
    return out / np.maximum(n, 1)[:, None]


def document_vectors(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One row of length ``WIDTH`` for each text."""
    return bucket_means(*tokens(texts), vectors)


class Network:
    """Standardised inputs, one tanh layer, one logit, one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.share = float(y.mean()) if len(y) else 0.5
        self.constant = len(np.unique(y)) < 2
        if self.constant:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        held = np.arange(len(x)) % 5 == 0
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held[:] = False
        z = (x - self.mean) / self.scale
        a, b = z[~held], y[~held].astype(float)
        p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.array([np.log(self.share / (1 - self.share))])]
        m, s, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(a))
            for at in range(0, len(a), 256):
                i = order[at : at + 256]
                h = np.tanh(a[i] @ p[0] + p[1])
                d = (_sigmoid(h @ p[2] + p[3]) - b[i]) / len(i)
                dh = d[:, None] * p[2] * (1 - h * h)
                g = [a[i].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            logit = self.logits(x[held])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, logit / g) - y[held] * logit / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.constant else _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts of ``df``, and the network of a sample of the labelled ones; equal rows of an id count once."""
    vectors = word_vectors(df, text)
    shared = df.sparkSession.sparkContext.broadcast(vectors)
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).filter(learn).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    ids = bounded_sample(rows.select("key", "h").join(own, "key").distinct(), F.col("h"), sample)
    picked = rows.join(F.broadcast(ids.drop("key")), "h").groupBy("h", "y").agg(F.min("text").alias("text"))  # about ``sample`` ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = document_vectors(part.column("text").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], ["h", "y", "x"])

    got = picked.mapInArrow(run, "h long, y int, x array<float>").toArrow().combine_chunks()
    h, y = got.column("h").to_numpy(), got.column("y").to_numpy()
    order = np.lexsort((y, h))[:sample]
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    return vectors, Network(x[order].astype(np.float64), y[order])


def scored(df: DataFrame, model: tuple[np.ndarray, Network], text: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``df`` with all its columns, its score and its class; the rows stay where they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = [c for c in df.columns if c.lower() not in (score.lower(), predicted.lower())]
    at = own.index(text)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            for part in slices(batch, at):
                p = network.scores(document_vectors(part.column(at).to_pylist(), vectors).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [*own, score, predicted])

    kept = df.select(*own)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(score, DoubleType()), StructField(predicted, IntegerType())]))


def score(df: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) of every row of ``df``; only labels of rows that ``learn`` (over ``key``) marks are used."""
    model = fit(df, labels, learn, text, key, label, sample)
    return scored(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), model, "_text", threshold=threshold).select(F.col("_key").alias(key), "score", "predicted")
