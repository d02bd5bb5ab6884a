"""Byte-level BPE on a sentencepiece model written straight from a rank file.

The rank file's tokens become byte-mapped pieces whose score is the negative rank, with identity normalisation, so that the
library merges in rank order. Each match of the pattern is encoded on its own; ids are ranks. Decoding maps ids back to bytes.

Nulls count as empty texts; an empty text has no ids. Texts of any length are taken whole: they fall apart at safe
boundaries first. Repeated rows repeat in the result, and rows without an id stay. An empty table gives an empty result. Other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import Memo, slices, small_batches

#: Entries a worker keeps of chunks already encoded; the table starts anew beyond it.
CACHE = 400_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    kept = [b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in set(kept) else next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """Serialised sentencepiece model whose piece i is ``tokens[i]`` with score -i; the last piece is the unknown one.

    Field numbers are those of the public sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3), trainer 2
    (model_type 3, vocab_size 4, unk 40, bos 41, eos 42, pad 43), normaliser 3 (name 1, flags 3 to 5)."""
    letters = byte_letters()
    bpe, normal, unknown = 2, 1, 2
    out = [_field(1, _field(1, "".join(letters[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    out.append(_field(2, _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
        self.ids = [r for r, _ in ranks]
        self.rank = {t: r for r, t in ranks}
        self.letters = {b: ord(c) for b, c in enumerate(byte_letters())}
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model_bytes([t for _, t in ranks]))
        of = {c: b for b, c in enumerate(byte_letters())}
        self.token = {r: bytes([of[c] for c in self.model.id_to_piece(k)]) for k, r in enumerate(self.ids)}  # the inverse mapping
        self.matches = regex.compile(pattern).findall
        self.safe = pattern == public_tokenizers.PATTERN  # the rule for chunks holds for this one
        self.known = Memo(self.encode_pretokens, CACHE // 2, "bpe")
        self.cache = Memo(self.encode_chunks, CACHE, "bpe")

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token; a pre-token that is itself a token is that token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        out = [[self.rank[r]] if r in self.rank else None for r in raw]
        asked = [i for i, o in enumerate(out) if o is None]
        if asked:
            for i, got in zip(asked, self.model.encode([raw[i].decode("latin-1").translate(self.letters) for i in asked], out_type=int, num_threads=1)):
                out[i] = [self.ids[k] for k in got]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def encode_chunks(self, chunks: list[str]) -> list[tuple[str, int, bytes]]:
        """For each chunk: its ids as text, their number, and the bytes that they decode to."""
        rows = [self.matches(c) for c in chunks]
        known = self.known.table(rows)
        out = []
        for r in rows:
            ids = [i for p in r for i in known[p]]
            out.append((",".join(map(str, ids)), len(ids), self.decode(ids)))
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        got = self.matches(text)
        known = self.known.table([got])
        return [i for p in got for i in known[p]]

    def chunks(self, text: str) -> list[str]:
        """Cuts before a run of spaces and newlines that follows another character: no match of the public pattern crosses
        such a place.

        Texts with any other white space stay whole, since a match may end inside a mixed run, and so does any text under
        another pattern. Such long chunks serve one call and are not kept."""
        return _CHUNK(text) if self.safe and not _ODD_SPACE(text) else [text]


_CHUNK = regex.compile(r"[ \n]*+[^ \n]++|[ \n]++").findall
_ODD_SPACE = regex.compile(r"[^\S \n]|[\x1c-\x1f]").search


@lru_cache(2)
def encoder(path: str | None, pattern: str) -> ByteBpe:
    """Of the public rank file, found where this runs, unless a path is given."""
    return ByteBpe(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, ids array<int>) of every text."""
    small_batches(df.sparkSession)
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [bpe.chunks(t or "") for t in part.column("text").to_pylist()]
                seen = bpe.cache.table(rows)
                n, sha, back, out = [], [], [], []
                for r in rows:
                    got = [seen[c] for c in r]
                    n.append(sum([g[1] for g in got]))
                    joined = ",".join([g[0] for g in got])
                    sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    back.append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
                    if ids:
                        out.append([int(x) for x in joined.split(",")] if joined else [])
                columns = [part.column("key"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(out, pa.list_(pa.int32()))] if ids else []), ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, decoded binary) of id lists; null lists decode to no bytes, an unknown id fails the row's task."""
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], ["key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, decoded binary").withColumnRenamed("key", key)
