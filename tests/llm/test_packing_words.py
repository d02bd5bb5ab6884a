"""Words of a text under the packing tokenizer: each stem is encoded once, and the ids are those of the whole word."""

import public_tokenizers

from gradus.llm.packing import WordCache


def test_words_are_encoded_by_stem_and_mark():
    cache = WordCache(public_tokenizers.path("word_bpe_49k.json"))
    asked, runs = [], cache.encode_runs

    def counted(words):
        asked.extend(words)
        return runs(words)

    cache.stems.make = counted
    got = cache.encode(["The the THE, the. Kelvin", "tHe; it's It's. WE'RE! .. ? <|ENDOFTEXT|> <|endoftext|>. İ. ß: a1, don't,  É, K."])
    assert asked.count("the") == 1 and "The" not in asked and "THE," not in asked
    for text, ids in zip(["The the THE, the. Kelvin", "tHe; it's It's. WE'RE! .. ? <|ENDOFTEXT|> <|endoftext|>. İ. ß: a1, don't,  É, K."], got):
        want = cache.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in want)


def test_distinct_parts_are_encoded_once():
    """Runs of marks and Latin-1 letters part too, and words beyond them stay whole."""
    cache = WordCache(public_tokenizers.path("word_bpe_49k.json"))
    asked, runs = [], cache.encode_runs

    def counted(words):
        asked.extend(words)
        return runs(words)

    cache.stems.make = counted
    texts = [
        "École école, ÉCOLE&&& école,%%% école", None, "", " \n ", "Éa", "é", "×a ÷. a×! a÷, Ÿ ÿ. ŸA, Ā, Œuf.", "don't don'T!! 's 'S '' a' 't' it's's", "a.b a.. ..a .. é.é É", "x<|endoftext|>y <|endoftext|> <|ENDOFTEXT|>, <|endoftext|>.", "é. é́! ä",
        "tab\tsep. a b, K. K, İ. ß. ẞ,", "1. a1. 12,3 a_b a_ _a", "ǅ. ａ. 漢字。 🙂. a🙂, é" + "é" * 5000 + ".",
    ]
    import pyarrow as pa

    got = cache.encode_column(pa.array(texts))
    assert asked.count("école") == 1 and not {"École", "ÉCOLE&&&", "école,", "école,%%%"} & set(asked)
    for text, ids in zip(texts, got, strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in cache.tokenizer.encode(text or "", add_special_tokens=False).ids), text
