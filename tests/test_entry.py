"""The driver's contract."""

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderstatus", "n"] and df.count() > 0


def test_queries_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
