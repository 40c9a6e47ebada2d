"""Boolean conditions over keys, and how they become Catalyst expressions.

Conditions are two-valued: a row that doesn't satisfy a condition satisfies its negation, null keys included.
SQL's NOT isn't, so negation is pushed down to the leaves here (De Morgan) and every leaf knows its own
negative form.  These forms use ``<=>``, ``IS NULL`` and plain comparisons only, which reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .keys import Key

_INVERSE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def _compare(column: Column, op: str, bound: Column) -> Column:
    return {"<": column < bound, "<=": column <= bound, ">": column > bound, ">=": column >= bound}[op]


class Condition:
    """An immutable boolean tree.  ``&``, ``|`` and ``~`` combine whole operands.

    ``and_`` and ``or_`` chain as text would be read: AND binds tighter, so ``a.or_(b).and_(c)`` is ``a | (b & c)``.
    An operand given to them is closed, as if in parentheses.
    """

    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        raise NotImplementedError

    def members(self) -> list[Membership]:
        """The leaves that need a join."""
        return []

    def __and__(self, other: Condition) -> Condition:
        return And((*_flat(self, And), *_flat(other, And)))

    def __or__(self, other: Condition) -> Condition:
        return Or((*_flat(self, Or), *_flat(other, Or)))

    def __invert__(self) -> Condition:
        return Not(self)

    def and_(self, other: Condition) -> Condition:
        return And((*_flat(self, And), Term(other)))

    def or_(self, other: Condition) -> Condition:
        return Or((*_flat(self, Or), Term(other)))


def _flat(condition: Condition, kind: type) -> tuple[Condition, ...]:
    return condition.parts if isinstance(condition, kind) else (condition,)


@dataclass(frozen=True)
class _Many(Condition):
    parts: tuple[Condition, ...]

    def members(self) -> list[Membership]:
        return [m for p in self.parts for m in p.members()]

    def _joined(self, positive: bool, conjunction: bool, member: Callable[[Membership], Column]) -> Column:
        first, *rest = (p.lower(positive, member) for p in self.parts)
        for c in rest:
            first = first & c if conjunction else first | c
        return first


class And(_Many):
    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        return self._joined(positive, positive, member)


class Or(_Many):
    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        return self._joined(positive, not positive, member)

    def and_(self, other: Condition) -> Condition:
        return Or((*self.parts[:-1], self.parts[-1].and_(other)))


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    def members(self) -> list[Membership]:
        return self.part.members()

    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        return self.part.lower(not positive, member)


@dataclass(frozen=True)
class Term(Condition):
    """A closed condition: chaining goes on beside it, not inside."""

    part: Condition

    def members(self) -> list[Membership]:
        return self.part.members()

    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        return self.part.lower(positive, member)


@dataclass(frozen=True)
class Always(Condition):
    value: bool = True

    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        return F.lit(self.value == positive)


@dataclass(frozen=True)
class Leaf(Condition):
    """A pair of expressions: one that is true where the condition holds, one that is true where it doesn't."""

    holds: Column
    fails: Column

    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        return self.holds if positive else self.fails


@dataclass(frozen=True, eq=False)
class Membership(Condition):
    """The key is (or, negated, isn't) among the values of a one-column DataFrame; null matches null."""

    key: Key
    values: DataFrame

    def members(self) -> list[Membership]:
        return [self]

    def lower(self, positive: bool, member: Callable[[Membership], Column]) -> Column:
        flag = member(self)
        return flag.isNotNull() if positive else flag.isNull()


# --- leaves -----------------------------------------------------------------------------------


def equals(column: Column, value: Any) -> Condition:
    same = column.isNull() if value is None else column.eqNullSafe(F.lit(value))
    return Leaf(same, column.isNotNull() if value is None else ~same)


def among(column: Column, values: list) -> Condition:
    known = [v for v in values if v is not None]
    if not known:
        return equals(column, None) if values else Always(False)
    found = column.isin(known)
    if len(known) < len(values):
        return Leaf(found | column.isNull(), ~found & column.isNotNull())
    return Leaf(found, ~found | column.isNull())


def compare(column: Column, op: str, bound: Any) -> Condition:
    """Null keys satisfy no comparison, so they satisfy the negation."""
    b = bound if isinstance(bound, Column) else F.lit(bound)
    return Leaf(_compare(column, op, b), _compare(column, _INVERSE[op], b) | column.isNull())


def span(column: Column, low: Any, high: Any, *, open_end: bool) -> Condition:
    """``low <= key <= high``, or ``< high`` if ``open_end``."""
    lo, hi = F.lit(low), F.lit(high)
    if open_end:
        return Leaf((column >= lo) & (column < hi), (column < lo) | (column >= hi) | column.isNull())
    return Leaf((column >= lo) & (column <= hi), (column < lo) | (column > hi) | column.isNull())


def null_false(test: Column, column: Column) -> Condition:
    """A test that is null for null keys only; null counts as false."""
    return Leaf(test, ~test | column.isNull())


def judged(test: Column) -> Condition:
    """Any boolean expression; null counts as false.  Correct but not pushed to the scan when negated."""
    return Leaf(test, ~F.coalesce(test, F.lit(False)))


def total(test: Column) -> Condition:
    """A boolean expression that is never null."""
    return Leaf(test, ~test)
