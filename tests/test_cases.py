"""Every registered query of the engine against its SQL."""

import decimal
import math

import duckdb
import pytest

from indexframe import cases

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.6g}"
    return value


def test_every_sql_has_its_query():
    assert set(cases.oracle_sql()) <= set(cases.queries())


@pytest.mark.parametrize("name", sorted(cases.oracle_sql()))
def test_case(spark, oracle, name):
    df = cases.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = oracle.sql(cases.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
