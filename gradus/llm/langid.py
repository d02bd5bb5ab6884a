"""Language ID by a linear-chain conditional random field over the words of a text.

A word's features are its affixes of one to three letters, the character bigrams and trigrams of its padded form, and whether a
lexicon of the training words lists it for a language. Weights and transitions are learned together on sequences that
switch languages, made from runs of words of different documents. Words are labelled by forward-backward; a document's
language has the largest mean posterior over its words that hold a letter, and that mean is the score.

A word of more than ``PIECE`` characters, such as a text written without spaces, counts as several words: overlapping pieces
that hold each of its n-grams once, so that all of it is scored in bounded memory.

Chains of any length run in blocks: the product of each block's step matrices first, then the states between blocks, then the
steps inside all blocks at once. Training takes at most ``SAMPLE`` distinct texts, about ``CHARS`` characters together: the languages in
turn, each in the order of its texts' hashes, so that all of them are learned whatever their shares and however often a text
repeats. A text of more than ``TEXT`` characters gives runs of words from all over it. The gradient holds the exact marginals of
words and of neighbouring pairs. Prediction takes whole texts.

Null and empty texts and those without a letter get ``und`` with score 0. Without usable labels, or on an empty table, every
text is ``und``. Ties go to the language first in order. A null id is an id like others. Repeated rows are predicted alike; other
columns are not read, and :func:`labelled` passes them through, but for those named like its results, which these replace.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gradus.llm.common import Memo, Scratch, mix, slices, small_batches, stored

#: Most rows that training takes, and about as many characters of all their texts.
SAMPLE, CHARS = 2000, 1_200_000
#: Characters that one text contributes at most.
TEXT = 20_000
#: Words of a training sequence, rounds of training, words of a block, entries of a worker's table of words.
SEQUENCE, ROUNDS, BLOCK, CACHE = 32, 40, 64, 120_000
#: Most characters of a word that is scored in one piece.
PIECE = 80
UNKNOWN = "und"


def core(word: str) -> str:
    """Lower-case word without the non-letters at its ends; a piece as it is if it holds a letter."""
    if word.isalpha():
        return word.lower()
    if word[:1] == " " or word[-1:] == " ":
        return word if any(map(str.isalpha, word)) else ""
    a, b = 0, len(word)
    while a < b and not word[a].isalpha():
        a += 1
    while b > a and not word[b - 1].isalpha():
        b -= 1
    return word[a:b].lower()


def pieces(word: str) -> list[str]:
    """The word, or the pieces of its core where that is long; a space marks an end at which the word goes on."""
    if len(word) <= PIECE:
        return [word]
    w = core(word)
    if len(w) <= PIECE:
        return [w or "-"]
    step = PIECE - 2  # the last two characters begin the next piece, so that no trigram is lost or repeated
    return [" " * (i > 0) + w[i : i + PIECE] + " " * (i + PIECE < len(w)) for i in range(0, len(w) - 2, step)]


def in_pieces(words: list[str]) -> list[str]:
    """``words`` with the long ones in pieces."""
    return [p for w in words for p in pieces(w)] if max(map(len, words), default=0) > PIECE else words


def features(w: str) -> list[str]:
    """Affixes, n-grams and the word itself; the learned lexicon decides whether the last counts."""
    if not w:
        return ["<none>"]
    head, tail = w[0] != " ", w[-1] != " "
    p = "^" * head + w.strip(" ") + "$" * tail
    out = [p[:k] for k in range(2, 5) if head] + [p[-k:] for k in range(2, 5) if tail]
    out += [p[i : i + 2] for i in range(not head, len(p) - 1)] + [p[i : i + 3] for i in range(len(p) - 2)]
    out.append("=" + w)
    return out


class Crf:
    """Feature index, weights (features x languages) and transition scores (from x to)."""

    def __init__(self, languages: list[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.index, self.weights, self.transitions = languages, index, weights.astype(np.float32), transitions
        self.name = uuid.uuid4().hex

    def emissions(self, words: list[str]) -> list[bytes]:
        """For each word, its scores per language and whether it holds a letter, as bytes of 32-bit floats."""
        if not words:
            return []
        get = self.index.get
        at, sizes = [], []
        cores = [core(w) for w in words]
        for w in cores:
            own = [i for f in features(w) if (i := get(f)) is not None]
            at += own
            sizes.append(len(own))
        ends = np.cumsum([0, *sizes])
        sums = np.vstack([np.zeros((1, len(self.languages))), np.cumsum(self.weights[at].astype(np.float64), axis=0)]) if at else np.zeros((1, len(self.languages)))
        got = np.empty((len(words), len(self.languages) + 1), np.float32)
        got[:, :-1] = sums[ends[1:]] - sums[ends[:-1]]
        got[:, -1] = [bool(w) for w in cores]
        raw, width = got.tobytes(), got.shape[1] * 4
        return [raw[i : i + width] for i in range(0, len(raw), width)]


def posteriors(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginal probabilities of each word's language; ``offsets`` cut the words into chains."""
    n, k = scores.shape
    if not n:
        return np.zeros((0, k), np.float32)
    step = np.exp(transitions - transitions.max()).astype(np.float32)
    lengths = np.diff(offsets)
    per = -(-lengths // block)
    chain_first = np.cumsum(per) - per
    blocks = int(per.sum())
    chain = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(blocks) - chain_first[chain]
    begin = offsets[chain] + nth * block
    size = np.minimum(block, offsets[chain + 1] - begin)
    place = begin[:, None] + np.arange(block)[None, :]
    valid = np.arange(block)[None, :] < size[:, None]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)
    em = np.where(valid[:, :, None], e[np.minimum(place, n - 1)], np.float32(1))
    head = nth == 0
    whole = np.broadcast_to(np.eye(k, dtype=np.float32), (blocks, k, k)).copy()
    many = per.max(initial=0) > 1
    if many:
        for t in range(block):
            moved = (whole.reshape(-1, k) @ step).reshape(blocks, k, k)
            if t == 0:
                moved[head] = whole[head]
            moved *= em[:, t, None, :]
            moved /= moved.max(axis=(1, 2), keepdims=True)
            whole = np.where(valid[:, t, None, None], moved, whole)
    enter = np.full((blocks, k), np.float32(1 / k))
    leave = np.full((blocks, k), np.float32(1 / k))
    for j in range(1, int(per.max(initial=0))):
        here = chain_first[per > j] + j
        v = np.einsum("ni,nij->nj", enter[here - 1], whole[here - 1])
        enter[here] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(per.max(initial=0)) - 1, 0, -1):
        here = chain_first[per > j] + j
        v = np.einsum("nij,nj->ni", whole[here], leave[here])  # includes the step into the block
        leave[here - 1] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((block, blocks, k), np.float32)
    state = enter
    for t in range(block):
        moved = state @ step
        if t == 0:
            moved[head] = state[head]
        moved *= em[:, t]
        moved /= moved.sum(axis=1, keepdims=True)
        state = np.where(valid[:, t, None], moved, state)
        alpha[t] = state
    beta = leave
    gamma = np.empty((n, k), np.float32)
    for t in range(block - 1, -1, -1):
        here = np.flatnonzero(valid[:, t])
        g = alpha[t, here] * beta[here]
        gamma[place[here, t]] = g / g.sum(axis=1, keepdims=True)
        back = (beta * em[:, t]) @ step.T
        back /= back.sum(axis=1, keepdims=True)
        beta = np.where(valid[:, t, None], back, beta)
    return gamma


def expectations(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chains of equal length (chains x words x languages): each word's marginals, and the expected number of each move.

    A move from word t - 1 to t has the marginal alpha(t - 1) x step x emission(t) x beta(t), normalised."""
    n, length, k = scores.shape
    step = np.exp(transitions - transitions.max())
    e = np.exp(scores - scores.max(axis=2, keepdims=True)) + 1e-12
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        v = (alpha[:, t - 1] @ step) * e[:, t]
        alpha[:, t] = v / v.sum(axis=1, keepdims=True)
    beta[:, -1] = 1 / k
    for t in range(length - 2, -1, -1):
        v = (e[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = v / v.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    moves = np.zeros((k, k))
    for t in range(1, length):
        right = e[:, t] * beta[:, t]
        whole = ((alpha[:, t - 1] @ step) * right).sum(axis=1, keepdims=True)
        moves += step * ((alpha[:, t - 1] / whole).T @ right)
    return gamma, moves


def train(samples: list[tuple[str, list[str]]], seed: int = 11, rounds: int = ROUNDS, sequence: int = SEQUENCE) -> Crf | None:
    """Fits a CRF to (language, words) samples on sequences that switch between samples of different languages."""
    samples = [(lang, [w for w in words if w]) for lang, words in samples]
    samples = [x for x in samples if x[1]]
    languages = sorted({x[0] for x in samples})
    if not languages:
        return None
    of = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    seen: dict[str, Counter] = {}
    for lang, words in samples:
        for w in words:
            seen.setdefault(core(w), Counter())[lang] += 1
    types = sorted(seen)
    type_of = {w: i for i, w in enumerate(types)}
    # Lexicon: words with a clear home. Other features: those of several word types.
    lexicon = {w for w, c in seen.items() if (m := c.most_common(1)[0][1]) >= 3 and m >= 0.9 * c.total()}
    spread = Counter(f for w in types for f in set(features(w)))
    index = {f: i for i, f in enumerate(sorted(f for f, c in spread.items() if (c >= 3 if f[0] != "=" else f[1:] in lexicon) or f == "<none>"))}
    flat, sizes = [], []
    for w in types:
        own = [i for f in features(w) if (i := index.get(f)) is not None]
        flat += own
        sizes.append(len(own))
    flat_at, owner = np.array(flat, np.int64), np.repeat(np.arange(len(types)), sizes)
    # Runs of 4 to 16 words of one sample after the other, in a shuffled order of all runs.
    runs = []
    for lang, words in samples:
        ids = [type_of[core(w)] for w in words]
        at = 0
        while at < len(ids):
            n = int(rng.integers(4, 17))
            runs.append((of[lang], ids[at : at + n]))
            at += n
    rng.shuffle(runs)
    x = np.array([i for _, r in runs for i in r])
    y = np.array([lang for lang, r in runs for _ in r])
    n = len(x) // sequence * sequence
    if not n:
        x, y, n = np.resize(x, sequence), np.resize(y, sequence), sequence
    x, y = x[:n], y[:n]
    k = len(languages)
    gold = np.zeros((n, k))
    gold[np.arange(n), y] = 1
    inside = np.flatnonzero(np.arange(n) % sequence)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (y[inside - 1], y[inside]), 1)
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    m1, m2, r1, r2 = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)
    per_type = lambda g: np.stack([np.bincount(x, g[:, c], len(types)) for c in range(k)], axis=1)
    target = per_type(gold)
    for t in range(1, rounds + 1):
        by_type = np.stack([np.bincount(owner, weights[flat_at, c], len(types)) for c in range(k)], axis=1)
        gamma, pairs = expectations(by_type[x].reshape(-1, sequence, k), moves)
        g = per_type(gamma.reshape(n, k)) - target
        gw = np.stack([np.bincount(flat_at, g[owner, c], len(index)) for c in range(k)], axis=1) / n + 1e-7 * weights
        gm = (pairs - gold_moves) / n + 1e-6 * moves
        for grad, p, a, b in ((gw, weights, m1, m2), (gm, moves, r1, r2)):
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            p -= 0.15 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
    return Crf(languages, index, weights, moves)


def _chosen(rows: DataFrame, sample: int, chars: int, most: int) -> list[tuple[int, str, int]]:
    """(h, lang, length) of the distinct (h, lang) rows to train on: languages in turn, each in the order of its hashes, until
    ``sample`` rows or ``chars`` characters are full, of which a text counts ``most`` at most. Each language has one row at least."""
    keys = stored(rows.groupBy("h", "lang").agg(F.max(F.length("text")).alias("size")), "training")
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}
    want = max(32, 3 * sample // max(len(counts), 1))  # rows of each language that may be looked at, about
    bar = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 31, int(want / n * (1 << 31))))]) if counts else F.create_map()
    near = keys.filter(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF)) < F.element_at(bar, F.col("lang"))) if counts else keys
    queues: dict[str, list] = {}
    for r in sorted(near.collect(), key=lambda r: (r["h"] & 0x7FFFFFFF, r["h"]), reverse=True):
        queues.setdefault(r["lang"], []).append((r["h"], r["lang"], r["size"]))
    out, total = [queues[lang].pop() for lang in sorted(queues)], 0
    total = sum(min(x[2], most) for x in out)
    while len(out) < sample and total < chars and any(queues.values()):
        for lang in sorted(queues):
            if queues[lang] and len(out) < sample and total < chars:
                out.append(queues[lang].pop())
                total += min(out[-1][2], most)
    return out


def _part(text: str, h: int, most: int, run: int = 16) -> str:
    """The text, or, of one that is longer than ``most``, about as many characters: runs of words from all over it, by hash."""
    if len(text) <= most:
        return text
    words = in_pieces(text.split())
    starts = np.arange(0, len(words), run)
    with np.errstate(over="ignore"):
        order = mix(starts.astype(np.uint64) + np.uint64(h & (1 << 64) - 1))
    held = order < np.uint64(min((1 << 64) - 1, int(most / len(text) * 2.0**64)))
    held[int(np.argmin(order))] = True
    return "\n".join(" ".join(words[a : a + run]) for a in starts[held])


def fit(df: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, chars: int = CHARS, most: int = TEXT) -> Crf | None:
    """Trains on the rows that ``learn`` marks and whose language and text are not null; a text that repeats counts once.

    Every language among them is learned: see :func:`_chosen`. A text longer than ``most`` gives runs of its words."""
    rows = df.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(text)).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.regexp_like("text", F.lit(r"\S")))
    with Scratch(df.sparkSession):
        keys = _chosen(rows, sample, chars, most)
        if not keys:
            return None
        listed = F.broadcast(df.sparkSession.createDataFrame([x[:2] for x in keys], "h long, lang string"))  # ``sample`` rows, or one a language
        small_batches(df.sparkSession)

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [_part(t, h, most) for t, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(got, pa.string())], ["h", "lang", "text"])

        picked = rows.join(listed, ["h", "lang"], "left_semi").mapInArrow(parts, "h long, lang string, text string")
        got = sorted(picked.groupBy("h", "lang").agg(F.min("text").alias("text")).toArrow().to_pylist(), key=lambda r: (r["h"], r["lang"]))
    return train([(r["lang"], in_pieces(r["text"].split())) for r in got])


_MEMOS: dict[str, Memo] = {}


def _memo(model: Crf) -> Memo:
    if model.name not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[model.name] = Memo(model.emissions, CACHE, "langid")
    return _MEMOS[model.name]


def label_texts(model: Crf, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word posteriors of all texts, the word offsets, and which words hold a letter; long words are in pieces."""
    rows = [in_pieces((t or "").split()) for t in texts]
    get = _memo(model).table(rows).__getitem__
    raw = b"".join([b"".join(map(get, r)) for r in rows])
    got = np.frombuffer(raw, np.float32).reshape(-1, len(model.languages) + 1)
    offsets = np.cumsum([0] + [len(r) for r in rows])
    return posteriors(got[:, :-1], offsets, model.transitions), offsets, got[:, -1] > 0


def labelled(df: DataFrame, model: Crf | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Every row of ``df`` with all its columns, the predicted language and its score; the rows stay where they are."""
    if model is None:
        return df.withColumns({lang_pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = [c for c in df.columns if c.lower() not in (lang_pred.lower(), score.lower())]
    at = own.index(text)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        names = np.array([*crf.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                gamma, offsets, lettered = label_texts(crf, part.column(at).to_pylist())
                sums = np.vstack([np.zeros((1, len(crf.languages))), np.cumsum(np.where(lettered[:, None], gamma, 0), axis=0, dtype=np.float64)])
                count = np.concatenate([[0], np.cumsum(lettered)])
                total, n = sums[offsets[1:]] - sums[offsets[:-1]], count[offsets[1:]] - count[offsets[:-1]]
                share = total / np.maximum(n, 1)[:, None]
                best = np.where(n > 0, share.argmax(axis=1), len(crf.languages))
                value = np.where(n > 0, np.clip(share.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(value, pa.float64())], [*own, lang_pred, score])

    kept = df.select(*own)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(lang_pred, StringType()), StructField(score, DoubleType())]))


def predict(df: DataFrame, model: Crf | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every text."""
    return labelled(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), model, "_text").select(F.col("_key").alias(key), "lang_pred", "score")


def words(df: DataFrame, model: Crf, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, words array<struct<word, lang, p>>): the most likely language of every word of each text."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                gamma, offsets, _ = label_texts(crf, texts)
                out = []
                for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
                    own = (t or "").split()
                    n = np.array([len(pieces(w)) for w in own], np.int64)
                    mean = np.add.reduceat(gamma[a:b], np.cumsum(n) - n) / n[:, None] if own else gamma[a:b]
                    out.append([{"word": w, "lang": crf.languages[i], "p": float(mean[j, i])} for j, (w, i) in enumerate(zip(own, mean.argmax(axis=1)))])
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])))], ["key", "words"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, words array<struct<word:string,lang:string,p:double>>").withColumnRenamed("key", key)
