import inspect

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert all(len(inspect.signature(f).parameters) == 2 for f in q.values())
