"""Typed collections of records with ids, keys and constraints.

A collection is an immutable snapshot: mutations return a new one.  Ids are ascending, never reused, and kept
in a column of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import keys as K
from ..plans.condition import Condition
from ..plans.query import ID, Query, apply_condition
from . import flow


class ConstraintViolation(ValueError):
    """Rows break a constraint."""


@dataclass(frozen=True)
class Unique:
    """No two rows have the same key; null keys count."""

    key: K.Key

    def violations(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key.column.alias("key")).agg(F.count(F.lit(1)).alias("count")).where("count > 1")


@dataclass(frozen=True)
class Custom:
    """Every row satisfies a condition."""

    name: str
    condition: Condition

    def violations(self, rows: DataFrame) -> DataFrame:
        return apply_condition(rows, ~self.condition)


@dataclass(frozen=True)
class CustomChange:
    """A test of old against new: gets the columns of both as functions of a name; true where a change is allowed."""

    name: str
    allows: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Collection:
    df: DataFrame
    id: str = ID
    keys: Mapping[str, K.Key] = field(default_factory=dict)
    constraints: tuple[Any, ...] = ()
    #: The next id; None: one above the largest.
    next_id: int | None = None

    @staticmethod
    def of(rows: DataFrame, order: Sequence[Column | str], *more: Any, start: int = 0) -> Collection:
        """A collection of rows without ids: they get ids in a total order, a range of it a task."""
        return Collection(flow.numbered(rows, ID, order, start), ID, {k.name: k for k in more if isinstance(k, K.Key)})

    # --- keys ---

    def with_keys(self, *more: K.Key, replace_existing: bool = False) -> Collection:
        """Adds keys; a name that exists is an error unless it may be replaced."""
        clash = [k.name for k in more if k.name in self.keys]
        if clash and not replace_existing:
            raise ValueError(f"keys exist: {clash}")
        return replace(self, keys={**self.keys, **{k.name: k for k in more}})

    def ensure_keys(self, *more: K.Key) -> Collection:
        return self.with_keys(*[k for k in more if k.name not in self.keys])

    def without_key(self, name: str) -> Collection:
        self.key(name)
        return replace(self, keys={n: k for n, k in self.keys.items() if n != name})

    def key(self, name: str) -> K.Key:
        if name not in self.keys:
            raise KeyError(f"no key {name!r}; there are {sorted(self.keys)}")
        return self.keys[name]

    # --- reading ---

    def query(self, condition: Condition | None = None) -> Query:
        return Query(self, condition)

    def get(self, entity_id: int) -> Row | None:
        return self.at(entity_id).head()

    peek = get

    def at(self, entity_id: int) -> DataFrame:
        return self.df.where(F.col(self.id) == entity_id)

    def scan(self) -> DataFrame:
        """All rows in ascending id order."""
        return self.df.orderBy(self.id)

    def size(self) -> int:
        return self.df.count()

    def highest_used_id(self) -> int:
        if self.next_id is not None:
            return self.next_id - 1
        top = self.df.agg(F.max(self.id)).head()[0]
        return -1 if top is None else top

    def distinct_keys(self, name: str) -> DataFrame:
        return self.key(name).keys(self.df).select("key").distinct()

    def key_entity_pairs(self, name: str) -> DataFrame:
        return self.key(name).keys(self.df).select("key", self.id)

    def statistics(self, name: str) -> DataFrame:
        """Rows a key."""
        return self.key(name).keys(self.df).groupBy("key").agg(F.count(F.lit(1)).alias("entries"))

    def by_example(self, names: Sequence[str], sample: Mapping[str, Any]) -> Query:
        query = self.query()
        for name in names:
            query.and_(self.key(name).like(sample))
        return query

    def test(self, condition: Condition, row: Mapping[str, Any]) -> bool:
        """Whether a row in memory satisfies a condition."""
        schema = T.StructType([f for f in self.df.schema if f.name in row])
        one = self.df.sparkSession.createDataFrame([tuple(row[f.name] for f in schema)], schema)
        return not apply_condition(one, condition).isEmpty()

    # --- constraints ---

    def with_constraint(self, *more: Any) -> Collection:
        """Adds constraints that all rows keep; else raises."""
        added = replace(self, constraints=(*self.constraints, *more))
        added._check(self.df, more)
        return added

    def without_constraint(self, constraint: Any) -> Collection:
        return replace(self, constraints=tuple(c for c in self.constraints if c is not constraint))

    def _check(self, rows: DataFrame, constraints: Iterable[Any]) -> None:
        for c in constraints:
            if isinstance(c, CustomChange):
                continue
            if bad := c.violations(rows).head():
                raise ConstraintViolation(f"{c}: {bad}")

    def _next(self, rows: DataFrame, **changes: Any) -> Collection:
        self._check(rows, self.constraints)
        return replace(self, df=rows, **changes)

    # --- mutation: new snapshots ---

    def add(self, rows: DataFrame, order: Sequence[Column | str]) -> Collection:
        """All rows or, if they break a constraint, none; their ids ascend in ``order`` above all ids ever given."""
        start = self.highest_used_id() + 1
        numbered = flow.numbered(rows, self.id, order, start)
        return self._next(self.df.unionByName(numbered.select(*self.df.columns)), next_id=start + numbered.count())

    def _issued(self, ids: Iterable[int]) -> list[int]:
        wanted, top = list(ids), self.highest_used_id()
        if any(i < 0 or i > top for i in wanted):
            raise ValueError(f"ids up to {top} were given out")
        return wanted

    def set(self, rows: DataFrame) -> Collection:
        """Puts rows at ids that were given out before, whether they are in use or free again."""
        ends = rows.agg(F.min(self.id), F.max(self.id)).head()
        self._issued([x for x in ends if x is not None])
        kept = self.df.join(rows.select(self.id), self.id, "left_anti").select(*self.df.columns)
        return self._next(kept.unionByName(rows.select(*self.df.columns)), next_id=self.highest_used_id() + 1)

    def update(self, condition: Condition, changes: Mapping[str, Column]) -> Collection:
        """New values of columns in the matching rows.  A change that breaks a constraint raises and changes nothing."""
        mark = condition.lower(True, lambda m: (_ for _ in ()).throw(ValueError("an update takes no membership")))
        hit = F.coalesce(mark, F.lit(False))
        for c in self.constraints:
            if isinstance(c, CustomChange):
                new = lambda name: changes.get(name, F.col(name))
                if self.df.where(hit & ~F.coalesce(c.allows(F.col, new), F.lit(False))).head():
                    raise ConstraintViolation(c.name)
        rows = self.df.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in self.df.columns])
        return self._next(rows, next_id=self.highest_used_id() + 1)

    def replace_entity(self, entity_id: int, changes: Mapping[str, Column]) -> Collection:
        self._issued([entity_id])
        return self.update(K.Key(self.id).is_(entity_id), changes)

    def remove(self, ids: DataFrame | Iterable[int]) -> Collection:
        """Without these ids; they aren't given out again."""
        if isinstance(ids, DataFrame):
            gone = ids.select(F.col(ids.columns[0]).alias("__gone"))
            rows = self.df.join(gone, F.col(self.id) == F.col("__gone"), "left_anti")
        else:
            wanted = list(ids)
            rows = self.df.where(~F.col(self.id).isin(wanted)) if wanted else self.df
        return self._next(rows, next_id=self.highest_used_id() + 1)

    def remove_all(self) -> Collection:
        """Empty, with ids from the start."""
        return replace(self, df=self.df.where(F.lit(False)), next_id=0)


_BY_TYPE = {T.StringType: K.TextKey, T.BooleanType: K.BoolKey, T.DateType: K.DateKey, T.TimestampType: K.SecondsKey, T.TimestampNTZType: K.SecondsKey, T.ArrayType: K.MultiKey}


def derive_keys(schema: T.StructType) -> list[K.Key]:
    """A key a field by its type.  Field metadata may say ``key`` (exact, instant, month, time, none) and ``name``."""
    kinds = {"exact": K.ExactKey, "instant": K.InstantKey, "month": K.YearMonthKey, "time": K.TimeOfDayKey}
    found = []
    for f in schema:
        kind = f.metadata.get("key")
        if kind == "none" or isinstance(f.dataType, (T.MapType, T.StructType)):
            continue
        make = kinds.get(kind) or next((k for t, k in _BY_TYPE.items() if isinstance(f.dataType, t)), K.OrderedKey)
        found.append(make(f.metadata.get("name", f.name), F.col(f.name)))
    return found
