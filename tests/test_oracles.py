"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from scriptorium.oracle import ORACLES
from scriptorium.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(r) for r in df.where(df.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
