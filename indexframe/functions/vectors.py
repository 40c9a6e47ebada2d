"""Similarity of arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE, DOT_PRODUCT, EUCLIDEAN = "COSINE", "DOT_PRODUCT", "EUCLIDEAN"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def unit(a: Column) -> Column:
    """The vector at length one, in double precision; a zero vector stays zero."""
    length = F.sqrt(dot(a, a))
    return F.get(F.transform(F.array(length), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))), F.lit(0))


def similarity(a: Column, b: Column, kind: str = COSINE) -> Column:
    """Higher is more alike.  COSINE and DOT_PRODUCT are the plain measures, EUCLIDEAN is 1 / (1 + squared distance)."""
    if kind == DOT_PRODUCT:
        return dot(a, b)
    if kind == EUCLIDEAN:
        d2 = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
        return 1 / (1 + d2)
    if kind != COSINE:
        raise ValueError(f"unknown similarity {kind}")
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)
