"""Registered queries of the engine's own operators, each with the SQL that should give the same rows."""

from __future__ import annotations

from . import fields, flows, predicates, searches, tables  # noqa: F401  they register
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
