"""Tokenising, packing, chat and URL operators: libraries, round trips and edge cases."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradus.llm import bpe, chat, packing, url_filter

TEXTS = ["", " ", "a  b\n\n c\t d", "x  y  z\r\n\r\n  q", "don't I'll 's  ", "日本語 テスト😀 👍🏽 é ́", "a" * 5000, "  \n \n  lead", "tail  \n ", "\x1c a \x1f b\x85 c", "<|endoftext|> foo<|startoftext|>bar", "ΑΣ Σ İstanbul ß", "a\x00b", "ﬁ ² Ⅷ", "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (101, "word " * 30000, "y"), (0, "", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)


def test_bpe_like_the_library(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(got).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.count() == docs.count()
    for r in got.collect():
        t = texts[r["doc_id"]] or ""
        want = own.encode_ordinary(t)
        assert r["ids"] == want
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert back[r["doc_id"]].decode() == t


def test_pieces_like_the_library(docs):
    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in packing.pieces(docs, ids=True, size=64).collect():
        ids = own.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        cut = np.array(ids[r["start"] : r["start"] + 64], "<u4").tobytes()
        assert (bytes(r["ids"]), r["length"], r["ids_crc32"], r["start"]) == (cut, len(cut) // 4, zlib.crc32(cut), 64 * r["piece"])


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(docs):
    rows = packing.best_fit(docs, size=64).collect()
    total = sum(r["length"] for r in rows)
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) - 1  # document 0 comes twice
    assert check_packing(rows, 64) <= total // 64 + 2


def test_plan_swaps_a_member_for_two():
    assert sum(n for n, _ in packing.plan({6: 1, 3: 1, 2: 2, 1: 0}, 10)) == 2
    best = packing.plan({7: 1, 2: 1}, 10)
    assert best == [(1, [7, 2])]
    # 6 + 3 leaves one free; 2 + 2 in place of 3 fills the bin.
    assert (1, [6, 2, 2]) in packing.plan({6: 1, 3: 1, 2: 2}, 10)
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 3000)
    counts = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    plan = packing.plan(counts, 100)
    used = {}
    for n, members in plan:
        assert sum(members) <= 100
        for m in members:
            used[m] = used.get(m, 0) + n
    assert used == counts
    assert sum(n for n, _ in plan) <= 1.01 * max(-(-lengths.sum() // 100), (lengths > 50).sum())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none).count() == 0
    assert packing.best_fit(none).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), [("block", "a.org", "/")]).count() == 0
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, parts array<struct<kind:string,text:string>>")).count() == 0


HARD = ["\\### Assistant: </turn> ok", "<turn user>\n", "<\\turn \\\\", "</turn>\n<turn assistant>\nx</turn>\n", "<part image 0>", "<\\\\turn", "", None, "é😀\n\n"]


def test_chat_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "a\nb>\n<\\turn\n")[i % 3], t) for i, t in enumerate(HARD)] + [(2, 0, None, "x"), (None, None, "user", "y"), (None, 1, "assistant", "z" * 30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    got = {r["conv_id"]: r for r in out.withColumn("back", chat.read_back(F.col("formatted"), F.col("turns"))).collect()}
    assert set(got) == {1, 2, None}
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: -1 if x[1] is None else x[1])
        assert [(b["role"], b["text"]) for b in r["back"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert [b["loss"] for b in r["back"] if b["loss"] is not None] == [x[3] or "" for x in mine if x[2] == "assistant"]
        assert r["formatted"].count("<turn ") == len(mine)


def test_chat_parts(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [
        (1, 0, "user", [("text", "see <part ", None, None, None, None, None), ("image", None, "a.png", 1024, 512, None, None), ("audio", None, "b.wav", None, None, 2.5, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3)]),
        (1, 2, "user", None),
    ]
    r = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert r["formatted"] == "<turn user>\nsee <\\part <part image 0><part audio 1></turn>\n<turn assistant>\n<part document 2></turn>\n<turn user>\n</turn>\n"
    assert [(a["index"], a["kind"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 85 + 340), (1, "audio", "b.wav", 75), (2, "document", "c.pdf", 2400)]
    assert r["n_tokens"] == 3 + 425 + 75 + 2400


def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    cases = [
        ("http://example.org/es/x", "example.org/es/", "block"), ("https://A.B.EXAMPLE.org/en/123?q", "example.org/en/1", "block"), ("http://notexample.org/es/", "org/", "allow"),
        ("http://example.org", None, "allow"), ("x://y.com/de/#/fr/", "com/de/", "block"), ("http://com/fr/", "com/fr/", "allow"), ("no scheme.com/de/", None, "allow"), (None, None, "allow"),
        ("http://example.org?/es/", None, "allow"), ("http://.org/", "org/", "allow"), ("http:///de/", None, "allow"), ("http://x.net/de/", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, "old", 7) for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host string, extra int")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["extra"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {i: (rule, verdict, 7) for i, (_, rule, verdict) in enumerate(cases)}


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("xxhash64(key) % 37 = 0")
    levels = url_filter.cascade(listed, universe)
    wrong = universe.withColumn("in", url_filter.contains(F.col("key"), levels)).filter("in <> (xxhash64(key) % 37 = 0)")
    assert len(levels) > 1
    assert wrong.count() == 0
    assert url_filter.cascade(listed.limit(0), universe) == []


def test_chat_ties_go_by_the_texts_as_they_come(spark):
    rows = [(1, 0, "user", t) for t in ("<turn", "<a", "\\b", "\\", "<u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    r = out.withColumn("back", chat.read_back(F.col("formatted"), F.col("turns"))).first()
    assert [b["text"] for b in r["back"]] == sorted(t for _, _, _, t in rows)


def test_another_pattern_is_not_cut_into_chunks(spark):
    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), r"\s*\S+\s*|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = "one  two \n\n three  "
    assert bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), pattern=pattern).first()["ids"] == own.encode_ordinary(text)


def test_memo_is_bounded_by_characters():
    from gradus.llm.common import Memo

    made = []
    memo = Memo(lambda ws: [made.append(w) or len(w) for w in ws], 10**6, "test")
    memo.MOST_CHARS = 1000
    long = "x" * (Memo.LONG + 1)
    for i in range(50):
        rows = [[f"{i:03d}" + "y" * 97, long]]
        got = memo.table(rows)
        assert [got[w] for w in rows[0]] == [100, len(long)]
        assert sum(map(len, memo.new)) + sum(map(len, memo.old)) <= 2500
    assert made.count(long) == 50


def test_rules_beyond_the_bitmaps_are_joined(spark, monkeypatch):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "com", "/de/")]
    urls = ["http://a.example.org/es/1", "http://example.org/", "http://x.com/de/?q", "https://y.com/fr/", None, "nothing", "http://z.net/", "http://z.net/"]
    df = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, _hit long")
    want = sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str)
    assert all(r[2] == r[0] for r in want)
    monkeypatch.setattr(url_filter, "MOST_BYTES", 0)
    assert sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str) == want


def test_equal_rows_spread_over_shards(spark):
    df = spark.createDataFrame([(None, "same text")] * 3000, "doc_id long, text string").repartition(1)
    cut = packing.pieces(df, shards=16)
    assert {r["count"] for r in cut.groupBy("_shard").count().collect()} <= {187, 188}
    rows = packing.best_fit(df, size=64).collect()
    assert len(rows) == 3000 == len({(r["sequence_id"], r["offset"]) for r in rows})


def test_queries_match_the_libraries_on_whole_tables(spark, sf):
    """op2 and op9 of the smallest tables, row by row."""
    from gradus.llm import queries

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op2_byte_bpe(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        want = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    words = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*words.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = queries.op9_best_fit(spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == {
        (i, k, k * 4096, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 4096)) for p in [x[k * 4096 : (k + 1) * 4096]]
    }
    check_packing(rows, 4096)
