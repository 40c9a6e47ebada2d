"""CSV in the converter's dialect: ``;`` between fields, ``t`` and ``f`` for booleans, ``[a,b]`` for lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The dialect.
SEPARATOR, TRUE, FALSE, LIST_OPEN, LIST_CLOSE, LIST_SEPARATOR = ";", "t", "f", "[", "]", ","
NULL = "\\N"


def _out(f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, T.BooleanType):
        return F.when(c, TRUE).when(~c, FALSE).alias(f.name)
    if isinstance(f.dataType, T.ArrayType):
        # A separator or bracket inside an element is escaped.
        inner = F.transform(c.cast(T.ArrayType(T.StringType())), lambda x: F.regexp_replace(x, r"([\\,\[\]])", r"\\$1"))
        return F.when(c.isNotNull(), F.concat(F.lit(LIST_OPEN), F.array_join(inner, LIST_SEPARATOR), F.lit(LIST_CLOSE))).alias(f.name)
    return c.cast("string").alias(f.name)


def _in(f: T.StructField) -> Column:
    c = F.col(f.name)
    if isinstance(f.dataType, T.BooleanType):
        return F.when(c == TRUE, True).when(c == FALSE, False).alias(f.name)
    if isinstance(f.dataType, T.ArrayType):
        inner = F.substring(c, 2, 1 << 30)
        inner = F.left(inner, F.length(inner) - 1)
        parts = F.transform(F.split(inner, r"(?<!\\),"), lambda x: F.regexp_replace(x, r"\\([\\,\[\]])", "$1"))
        empty = F.array().cast(f.dataType)
        return F.when(c.isNull(), F.lit(None)).when(F.length(inner) == 0, empty).otherwise(parts.cast(f.dataType)).alias(f.name)
    return c.cast(f.dataType).alias(f.name)


def to_strings(df: DataFrame) -> DataFrame:
    return df.select(*map(_out, df.schema))


def from_strings(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*map(_in, schema))


def write_csv(df: DataFrame, path: str) -> None:
    """Nulls are written as a mark and empty strings quoted."""
    to_strings(df).write.mode("overwrite").csv(path, sep=SEPARATOR, header=True, nullValue=NULL, emptyValue='""', escape='"')


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    strings = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    return from_strings(spark.read.schema(strings).csv(path, sep=SEPARATOR, header=True, nullValue=NULL, emptyValue="", escape='"', multiLine=True), schema)
