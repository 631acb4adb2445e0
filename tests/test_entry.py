"""Driver contract: entry runs, every query has a callable, oracles name known queries."""

import __spark_entry__ as e


def test_entry_runs(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 12 and df.columns == ["matrix_id", "k", "sigma"]


def test_registry_consistent():
    qs, ors = e.queries(), e.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 70 and len(ors) >= 70
