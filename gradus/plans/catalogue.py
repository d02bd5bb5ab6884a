"""Registry of the benchmark and evaluation queries with their SQL oracles."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradus.plans.views import SQL, Views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries when imported.
MODULES = ("core", "drawing", "texts", "analytics", "details", "features", "traces", "extras", "records", "questions")


def query(sql: str | None = None) -> Callable:
    """Registers ``f(views) -> DataFrame`` under its name, with the DuckDB SQL that has the same rows.

    Views named in the SQL become common table expressions in front of it."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            named = lambda v, text: re.search(rf"\b(FROM|JOIN)\s+{v}\b", text)
            direct = [v for v in SQL if named(v, sql)]
            used = [v for v in SQL if v in direct or any(named(v, SQL[d]) for d in direct)]
            head = "WITH " + ("RECURSIVE " if "RECURSIVE" in sql else "")
            body = sql.strip().replace("WITH RECURSIVE", "WITH")
            own = [f"{v} AS ({SQL[v]})" for v in used]
            if body.startswith("WITH "):
                _ORACLES[f.__name__] = head + ",\n".join(own + [body[5:]])
            else:
                _ORACLES[f.__name__] = (head + ",\n".join(own) + "\n" if own else "") + body
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"gradus.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
