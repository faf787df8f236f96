"""Rows of a query against DuckDB's rows of its SQL."""

import os

import duckdb


def same_as_sql(spark, sf_dir, name, queries):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    theirs = con.sql(queries.oracle_sql()[name])
    ours = queries.queries()[name](spark, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = sorted(ours.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in ours.select(*order).collect()), key=key) == sorted(theirs.select(*order).fetchall(), key=key)
