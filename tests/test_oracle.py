"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from chainloom.plans import reference_queries

SQL = reference_queries.oracle_sql()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v.tolist() if hasattr(v, "tolist") else v
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    ours = reference_queries.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(reference_queries.queries()) - set(SQL)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert reference_queries.queries()[name](spark, sf_dir).count() > 0
