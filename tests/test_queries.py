"""Every query against its oracle, on the smallest tables."""

import duckdb
import pytest

from gradus.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x.item() if hasattr(x, "item") else x


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_oracle(spark, sf, duck, name):
    mine = catalogue.queries()[name](spark, sf)
    theirs = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(mine.columns)
    assert cols == sorted(theirs.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in mine.collect()), key=repr)
    at = [theirs.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)
    assert a == b


def test_queries_without_oracle_run(spark, sf):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        catalogue.queries()[name](spark, sf).count()
