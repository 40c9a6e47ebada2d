"""Queries: a mutable builder over a collection that ends in a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .condition import And, Condition, Membership, Not, Term

if TYPE_CHECKING:
    from ..operators.collection import Collection
    from .keys import Key

ID = "_id"


def apply_condition(rows: DataFrame, condition: Condition) -> DataFrame:
    """The rows that satisfy a condition.

    What AND joins at the top is one filter, pushed to the scan, and a semi or anti join for each membership in it;
    a membership inside OR becomes a flag from a left join on distinct keys.
    """
    plain: list[Condition] = []
    joins: list[tuple[Membership, bool]] = []
    todo = [condition]
    while todo:
        c = todo.pop()
        inner = c.part if isinstance(c, Not) else c
        while isinstance(inner, Term):
            inner = inner.part
        if isinstance(c, Term):
            todo.append(c.part)
        elif isinstance(c, And):
            todo.extend(c.parts)
        elif isinstance(inner, Membership):
            joins.append((inner, c is not inner and isinstance(c, Not)))
        else:
            plain.append(c)
    columns, flags = rows.columns, {}
    for c in plain:
        for m in c.members():
            if id(m) not in flags:
                name = f"__member{len(flags)}"
                values = m.values.select(F.col("__value").alias(f"{name}_key"), F.lit(True).alias(name))
                rows = rows.join(values, m.key.column.eqNullSafe(F.col(f"{name}_key")), "left")
                flags[id(m)] = name
    for c in plain:
        rows = rows.where(c.lower(True, lambda m: F.col(flags[id(m)])))
    rows = rows.select(*columns) if flags else rows
    for m, negated in joins:
        values = m.values.select(F.col("__value").alias("__key"))
        rows = rows.join(values, m.key.column.eqNullSafe(F.col("__key")), "left_anti" if negated else "left_semi")
    return rows


class Query:
    """Conditions, an id range and sub-queries; each call changes the builder and returns it.

    ``and_`` binds tighter than ``or_``; a condition given in is closed.  Without a condition every row satisfies it, and
    id ranges and sub-queries hold all the same.
    """

    def __init__(self, collection: Collection, condition: Condition | None = None) -> None:
        self.collection, self.condition = collection, None
        self._low: int | None = None
        self._high: int | None = None
        self._subs: list[Any] = []
        if condition is not None:
            self.query(condition)

    def query(self, condition: Condition) -> Query:
        return self.and_(condition)

    def and_(self, condition: Condition | Query | DataFrame | Iterable[int]) -> Query:
        """A condition; or a sub-query, scored rows or ids, whose ids the result must have."""
        if isinstance(condition, Condition):
            self.condition = Term(condition) if self.condition is None else self.condition.and_(condition)
            return self
        if condition is self:
            return self
        if isinstance(condition, Query) and condition._uses(self):
            raise ValueError("a query can't be its own sub-query")
        self._subs.append(condition)
        return self

    def or_(self, condition: Condition) -> Query:
        self.condition = Term(condition) if self.condition is None else self.condition.or_(condition)
        return self

    def _uses(self, other: Query) -> bool:
        return any(s is other or isinstance(s, Query) and s._uses(other) for s in self._subs)

    def key(self, name: str) -> _Named:
        """Conditions by key name: ``query.key("status").is_("F")``; linked by ``and_key`` or ``or_key``."""
        return _Named(self, self.collection.key(name), self.and_)

    and_key = key

    def or_key(self, name: str) -> _Named:
        return _Named(self, self.collection.key(name), self.or_)

    def id_start(self, start: int) -> Query:
        """Ids from ``start``."""
        self._low = start
        return self

    def id_bound(self, bound: int) -> Query:
        """Ids below ``bound``."""
        self._high = bound
        return self

    def id_range(self, start: int, bound: int) -> Query:
        return self.id_start(start).id_bound(bound)

    # --- results ---

    def df(self) -> DataFrame:
        """The matching rows, in no order."""
        rows, at = self.collection.df, self.collection.id
        if self._low is not None:
            rows = rows.where(F.col(at) >= self._low)
        if self._high is not None:
            rows = rows.where(F.col(at) < self._high)
        if self.condition is not None:
            rows = apply_condition(rows, self.condition)
        for sub in self._subs:
            if isinstance(sub, Query):
                ids = sub.df().select(F.col(sub.collection.id).alias("__sub"))
            elif isinstance(sub, DataFrame):
                ids = sub.select(F.col(sub.columns[0]).alias("__sub"))
            else:
                ids = list(sub)
                rows = rows.where(F.col(at).isin(ids)) if ids else rows.where(F.lit(False))
                continue
            rows = rows.join(ids, F.col(at) == F.col("__sub"), "left_semi")
        return rows

    def ordered(self) -> DataFrame:
        return self.df().orderBy(self.collection.id)

    def page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A page in ascending id order."""
        if offset < 0 or limit is not None and limit < 0:
            raise ValueError("offset and limit can't be negative")
        rows = self.ordered()
        rows = rows.offset(offset) if offset else rows
        return rows if limit is None else rows.limit(limit)

    def distinct_page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A page without its ids and without repeated entities: the page is taken first."""
        return self.page(offset, limit).drop(self.collection.id).distinct()

    def ids(self) -> DataFrame:
        return self.df().select(self.collection.id)

    def first(self) -> DataFrame:
        return self.ordered().limit(1)

    def find_first(self) -> Row | None:
        return self.first().head()

    def count(self) -> int:
        return self.df().count()

    def to_list(self, offset: int = 0, limit: int | None = None) -> list[Row]:
        return self.page(offset, limit).collect()

    def __iter__(self) -> Iterator[Row]:
        """Rows in ascending id order, a partition at a time."""
        return self.ordered().toLocalIterator()

    def iterate(self, consumer: Callable[[Row], Any]) -> None:
        for row in self:
            consumer(row)

    def execute(self, consumer: Callable[[Iterator[Row]], None]) -> None:
        """Runs a consumer on the executors, once a partition."""
        self.df().foreachPartition(consumer)

    def sliced(self, slices: int, *aggregates: Column) -> DataFrame:
        """Aggregates a slice of the id range: ``slices`` ranges of equal width from the least to the largest id."""
        if slices < 1:
            raise ValueError("slices must be positive")
        at = self.collection.id
        rows = self.df()
        low, high = rows.agg(F.min(at), F.max(at)).head()
        width = max(1, -(-(high - low + 1) // slices)) if low is not None else 1
        placed = rows.withColumn("slice", F.floor((F.col(at) - F.lit(low or 0)) / F.lit(width)).cast("int"))
        return placed.groupBy("slice").agg(*aggregates)

    def resolve(self, resolver: Callable, schema: str) -> DataFrame:
        """Entities by a function over batches of rows, on the executors."""
        return self.df().mapInPandas(resolver, schema)


class _Named:
    """The conditions of a key, linked to a query as they are made."""

    def __init__(self, query: Query, key: Key, link: Callable[[Condition], Query]) -> None:
        self._query, self._key, self._link = query, key, link

    def __getattr__(self, name: str) -> Callable[..., Query]:
        make = getattr(self._key, name)
        return lambda *args: self._link(make(*args))
