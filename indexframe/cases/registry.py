"""Registration of queries with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collection import Collection
from ..plans import keys as K

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def case(sql: str | None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of the tables under its own name; ``sql`` is the oracle, None where SQL has none."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return register


#: A key with nulls, said alike in Spark and SQL.
STATUS = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END"


def orders(t: Tables) -> Collection:
    keys = [
        K.Key("status", "o_orderstatus"),
        K.Key("status_or_null", STATUS),
        K.Key("priority", "o_orderpriority"),
        K.Key("customer", "o_custkey"),
        K.NumberKey("price", "o_totalprice"),
        K.SecondsKey("date", "o_orderdate"),
        K.YearMonthKey("month", "o_orderdate"),
    ]
    return Collection(t.orders, "o_orderkey").with_keys(*keys)


def rounded(column, places: int = 2):
    return F.round(column.cast("double"), places)
