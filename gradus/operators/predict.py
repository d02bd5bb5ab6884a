"""Predictions by an injected client, cache first, offline by default."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



class Answer(NamedTuple):
    """What a client may give instead of a text: with the reasoning apart, and tokens used."""

    text: str | None
    reasoning: str | None = None
    input_tokens: int | None = None
    output_tokens: int | None = None


Client = Callable[[list[str]], list[str | Answer]]


def with_cache(prompts: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``pred`` from the cache where it has a non-empty one."""
    hits = cache.filter((F.col("pred").isNotNull()) & (F.col("pred") != "")).select(*keys, "pred")
    return prompts.join(hits, keys, "left")


#: The mark that reasoning begins with.
THINK = re.compile(r"^\s*<think>")


class Refused(Exception):
    """A client's error that another try would not mend."""


def predicted(prompts: DataFrame, client: Client | None = None, prompt: str = "prompt", tries: int = 5, wait: Callable[[int], float] = lambda k: min(30.0, 2.0**k), at_once: int | None = None, usage: bool = False) -> DataFrame:
    """Fills null ``pred`` by the client, row by row where a batch fails; adds ``error`` and ``latency_s``.

    A call is tried ``tries`` times, with a pause of ``wait(k)`` seconds before try k, but for :class:`Refused`. A row that still
    fails keeps a null prediction and its error; the others are not touched by it. Without a client nothing is called.

    ``at_once`` bounds the calls that run at a time, over all executors. With ``usage`` the columns ``reasoning``, ``input_tokens`` and
    ``output_tokens`` follow, and reasoning that a new answer holds between think marks is taken out of ``pred``."""
    kinds = {"error": "string", "latency_s": "double"} | ({"reasoning": "string", "input_tokens": "long", "output_tokens": "long"} if usage else {})
    empty = prompts.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    if client is None:
        return empty
    if at_once is not None:
        prompts = prompts.repartition(at_once)  # a partition calls for one batch after the other

    def asked(texts: list[str]) -> tuple[list[str | None], str | None]:
        for k in range(tries):
            if k:
                time.sleep(wait(k))
            try:
                return client(texts), None
            except Refused as e:
                return [None] * len(texts), str(e)
            except Exception as e:  # noqa: BLE001 - whatever a client raises, the row is told and the job goes on
                error = str(e)
        return [None] * len(texts), error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in kinds:
                b[c] = None
            todo = b.index[b["pred"].isna()].tolist()
            groups = [todo] if todo else []
            while groups:
                group = groups.pop()
                began = time.perf_counter()
                got, error = asked(b.loc[group, prompt].tolist())
                if error is not None and len(group) > 1:  # find the rows that fail
                    groups += [[i] for i in group]
                    continue
                answers = [x if isinstance(x, Answer) else Answer(x) for x in got]
                if usage:
                    answers = [x if x.reasoning or not x.text or "</think>" not in x.text else x._replace(reasoning=THINK.sub("", x.text.split("</think>", 1)[0]).strip(), text=x.text.split("</think>", 1)[1].strip()) for x in answers]
                    for c in ("reasoning", "input_tokens", "output_tokens"):
                        b.loc[group, c] = pd.Series([getattr(x, c) for x in answers], index=group, dtype=object)
                b.loc[group, "pred"] = pd.Series([x.text for x in answers], index=group, dtype=object)
                b.loc[group, "error"] = error
                b.loc[group, "latency_s"] = (time.perf_counter() - began) / len(group)
            b["latency_s"] = b["latency_s"].astype(float)
            yield b

    return prompts.mapInPandas(run, empty.schema)
