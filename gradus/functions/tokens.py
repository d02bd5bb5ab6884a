"""Token counts by a tokenizer, for whatever takes a count: ``text.token_count(m, tokens.by_tokenizer(path))``."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def by_tokenizer(path: str, special: bool = False, most: int = 64) -> Callable[[Column], Column]:
    """A count of the tokens of texts by a file of the tokenizers library, which every executor must find under ``path``; null texts have
    none. Texts are encoded ``most`` at a time, each whole."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode, out = _loaded(path).encode_batch, []
        for a in range(0, len(texts), most):
            out += [len(e.ids) for e in encode([t or "" for t in texts.iloc[a : a + most].tolist()], add_special_tokens=special)]
        return pd.Series(out, index=texts.index, dtype="int64")

    return count
