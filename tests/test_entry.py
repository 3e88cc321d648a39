from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from larkspur import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    cell = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(core.QUERIES) == set(core.ORACLE_SQL)


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_gives_what_sql_gives(spark, sf, db, name):
    got, want = core.QUERIES[name](spark, sf).toPandas(), db.sql(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
