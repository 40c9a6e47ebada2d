"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space without the non-breaking spaces.
_BLANK = r"^[\s\x1c-\x1f\p{Z}&&[^\u00a0\u2007\u202f]]*$"


def is_blank(text: Column) -> Column:
    """Null, empty or white space only; never null."""
    return text.isNull() | F.coalesce(text.rlike(_BLANK), F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order; an empty array for null."""
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(split, lambda t: t != "")
