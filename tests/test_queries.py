"""Every query against its SQL on the small tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from slotwise.plans import more, stored  # noqa: F401
from slotwise.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, bool) or not isinstance(x, (int, float)) and not hasattr(x, "dtype"):
            return str(x).replace(" 00:00:00", "")
        return round(float(x), 7) if not math.isnan(float(x)) else None

    return sorted(str([cell(x) for x in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_has_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
