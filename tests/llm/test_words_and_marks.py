"""Words of the byte-level BPE end at marks: fewer distinct ones are encoded and joined, and the ids stay the library's."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradus.llm import word_bpe, words

TEXTS = [
    "the. the, the&&& the", "don't don'T 'tis l'été, ''s'' it's's", "É. é! ×. a×! ÷? ȿ. Ɂ. ǅ, ß; é. ö!", "a-b c--d e.f, (g) [h] {i}_j k~", "x<|endoftext|>y. <|endoftext|>. t|endoftext|>",
    "a　.b . c\u0085, d ! e ? f . g . h​.", "1. a1. 2a. 日本。 日本. 🙂. a🙂.", "", "...", "w." * 3000,
]


def test_marks_behind_letters_are_words_of_their_own():
    library = Tokenizer.from_file(public_tokenizers.path(word_bpe.FILE))
    got, offsets = words.spaced(word_bpe.added_tokens(), marks=True)(pa.array(TEXTS))
    assert [w.decode() for w in got[: offsets[1]].to_pylist()] == ["the", ".", " the", ",", " the", "&&&", " the"]
    for i, t in enumerate(TEXTS):
        own = [w.decode() for w in got[offsets[i] : offsets[i + 1]].to_pylist()]
        assert "".join(own) == t
        assert [k for w in own for k in library.encode(w, add_special_tokens=False).ids] == library.encode(t, add_special_tokens=False).ids
        encoded = word_bpe.encode_words(own, None, "<|endoftext|>")
        assert encoded == word_bpe.encode_words(own, None, "") and len(encoded) == len(own)


def test_a_text_is_cut_twice_in_all(spark):
    """Once to count its words, once to store their places; what the join finds is put in without the text."""
    seen = spark.sparkContext.accumulator(0)
    cut = words.spaced(word_bpe.added_tokens(), marks=True)

    def split(column):
        seen.add(len(column))
        return cut(column)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    table = word_bpe.word_table(df)
    assert table.filter("word = cast(' the' AS binary)").first()["n"] == 3
    out = words.rewritten(df, table, "ids", split, most=12)
    assert seen.value == len(TEXTS)
    library = Tokenizer.from_file(public_tokenizers.path(word_bpe.FILE))
    assert {r["doc_id"]: bytes(r["code"]) for r in out.select("doc_id", F.col("code")).collect()} == {i: b"".join(k.to_bytes(4, "little") for k in library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
