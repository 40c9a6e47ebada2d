"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries()`` and ``oracle_sql()`` list the
registered queries and the SQL of those that SQL can express.  They import all operators when they are called: a Python worker
that needs one operator doesn't load the libraries of the others.
"""

from __future__ import annotations

from collections.abc import Callable


def queries() -> dict[str, Callable]:
    from . import catalog

    return catalog.queries()


def oracle_sql() -> dict[str, str]:
    from . import catalog

    return catalog.oracle_sql()
