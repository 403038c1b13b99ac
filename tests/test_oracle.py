"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from tideworks.plans import registry

DIR = "/root/testdata/sf0.001"
SLOW = {"stream_winning_bids", "stream_q6"}  # each runs stream_q4's stream once more

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return con


def values(df):
    df = df[sorted(df.columns)].astype(object)
    text = lambda x: "null" if x is None or x is np.nan else repr(float(x)) if isinstance(x, (float, np.floating)) else str(x)
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in registry.SQL if n not in SLOW])
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_names_and_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["category", "avg_price"]
