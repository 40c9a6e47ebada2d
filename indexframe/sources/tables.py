"""Stored tables: roots by name, export and import by type, schema evolution, statistics, and slices for viewers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def save_root(df: DataFrame, path: str, root: str, *, append: bool = False) -> None:
    """Writes a named root; ``append`` adds a batch."""
    df.write.mode("append" if append else "overwrite").parquet(f"{path}/{root}")


def load_root(spark: SparkSession, path: str, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{root}")


def load_by_type(df: DataFrame, column: str, *types: str) -> DataFrame:
    return df.where(F.col(column).isin(list(types)))


def load_by_ids(df: DataFrame, column: str, ids: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(ids)))


def export_types(df: DataFrame, path: str, column: str) -> None:
    """A folder a type."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def import_types(spark: SparkSession, path: str, into: DataFrame | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found if into is None else into.unionByName(found.select(*into.columns))


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def evolve(df: DataFrame, target: T.StructType, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """Rows in another schema.

    ``mapping``: new field -> old field, or None for a field that starts null.  Other fields come from the old one of the same
    name, else of the same name but for case, ``_`` and ``-``; without one they are null.  Old fields without use go.
    """
    plain = lambda n: n.lower().replace("_", "").replace("-", "")
    by_plain = {plain(c): c for c in df.columns}
    mapping = mapping or {}

    def source(f: T.StructField) -> Column:
        old = mapping[f.name] if f.name in mapping else f.name if f.name in df.columns else by_plain.get(plain(f.name))
        return (F.lit(None) if old is None else F.col(old)).cast(f.dataType).alias(f.name)

    return df.select(*map(source, target))


def file_statistics(df: DataFrame) -> DataFrame:
    """Rows and size of each file that a table read from files has."""
    return df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("rows"))


def roots(named: Mapping[str, DataFrame]) -> DataFrame:
    """root and entries of each named table."""
    found = None
    for name, rows in named.items():
        one = rows.agg(F.count(F.lit(1)).alias("entries")).select(F.lit(name).alias("root"), "entries")
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no roots")
    return found


def element_page(df: DataFrame, column: str, offset: int, length: int) -> DataFrame:
    """Rows with their list cut to a page of its elements; rows without elements there go."""
    return df.withColumn(column, F.slice(F.col(column), F.lit(offset + 1), F.lit(length))).where(F.size(column) > 0)


def type_dictionary(df: DataFrame) -> str:
    return df.schema.json()


def members(df: DataFrame, entity_id: str, value, offset: int = 0, length: int = 20) -> DataFrame:
    """One entity for a viewer: arrays cut to a slice, strings to a piece."""

    def cut(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.slice(F.col(f.name), F.lit(offset + 1), F.lit(length)).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.substring(F.col(f.name), offset + 1, length).alias(f.name)
        return F.col(f.name)

    return df.where(F.col(entity_id) == F.lit(value)).select(*map(cut, df.schema))


def adjacency(tables: Mapping[str, tuple[DataFrame, str, Mapping[str, str]]]) -> DataFrame:
    """Reference edges (src, dst) of tables.  ``tables``: name -> (rows, id column, reference column -> table referred to)."""
    edges = None
    for name, (rows, key, references) in tables.items():
        node = F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))
        for column, other in references.items():
            found = rows.where(F.col(column).isNotNull()).select(node.alias("src"), F.concat(F.lit(f"{other}:"), F.col(column).cast("string")).alias("dst"))
            edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        raise ValueError("no table has references")
    return edges
