"""Keys: named, typed expressions on the rows of a collection, and the conditions they offer."""

from __future__ import annotations

import datetime as dt
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from .condition import Always, Condition, Membership, among, compare, equals, judged, null_false, span, total

if TYPE_CHECKING:
    from .query import Query


def _column(expression: Column | str) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression


def _need(bound: Any) -> Any:
    if bound is None:
        raise ValueError("a bound can't be null")
    return bound


class Key:
    """A named expression with equality conditions; null is a key like any other."""

    def __init__(self, name: str, expression: Column | str | None = None) -> None:
        self.name, self.column = name, _column(name if expression is None else expression)

    def is_(self, value: Any) -> Condition:
        return equals(self.column, value)

    def not_(self, value: Any) -> Condition:
        return ~self.is_(value)

    def is_null(self) -> Condition:
        return self.is_(None)

    def not_null(self) -> Condition:
        return ~self.is_null()

    def in_(self, *values: Any) -> Condition:
        return among(self.column, list(values))

    def not_in(self, *values: Any) -> Condition:
        return ~self.in_(*values)

    def in_query(self, query: Query | DataFrame, column: Column | str | None = None) -> Condition:
        """The key is among the values of ``column`` (this key's name if not given) of a query's rows."""
        rows = query if isinstance(query, DataFrame) else query.df()
        return Membership(self, rows.select(_column(self.name if column is None else column).alias("__value")).distinct())

    def not_in_query(self, query: Query | DataFrame, column: Column | str | None = None) -> Condition:
        return ~self.in_query(query, column)

    def matches(self, test: Callable[[Column], Column]) -> Condition:
        """A predicate over the key as an expression; it sees null keys, and a null result counts as false."""
        return judged(test(self.column))

    def matches_python(self, rows: DataFrame, test: Callable[[Any], bool]) -> Condition:
        """An opaque predicate: called once a distinct key, on the executors; the rows are then met by a semi join."""
        distinct = rows.select(self.column.alias("__value")).distinct()

        def run(batches):
            for batch in batches:
                yield batch.filter([bool(test(v)) for v in batch.column(0).to_pylist()])

        return Membership(self, distinct.mapInArrow(run, distinct.schema))

    def value_of(self, sample: Mapping[str, Any]) -> Any:
        """The key of a sample row given by field; the key's own name is looked up."""
        return sample.get(self.name)

    def like(self, sample: Mapping[str, Any]) -> Condition:
        return self.is_(self.value_of(sample))

    def unlike(self, sample: Mapping[str, Any]) -> Condition:
        return ~self.like(sample)

    def keys(self, rows: DataFrame) -> DataFrame:
        """Each row's keys, for statistics and key listings."""
        return rows.withColumn("key", self.column)

    def equal_keys(self, a: Mapping[str, Any], b: Mapping[str, Any]) -> bool:
        return self.value_of(a) == self.value_of(b)


class OrderedKey(Key):
    """A key with comparisons.  Null keys satisfy none of them; nor does anything satisfy one with a null bound.

    ``sortable`` maps key or bound to what is compared, for an order of its own.
    """

    strict = False

    def __init__(self, name: str, expression: Column | str | None = None, sortable: Callable[[Column], Column] | None = None) -> None:
        super().__init__(name, expression)
        self.sortable = sortable or (lambda c: c)

    def _compare(self, op: str, bound: Any) -> Condition:
        if self._bad(bound):
            return Always(False)
        return compare(self.sortable(self.column), op, self.sortable(F.lit(bound)))

    def _bad(self, bound: Any) -> bool:
        if bound is None and self.strict:
            raise ValueError("a bound can't be null")
        return bound is None

    def less_than(self, bound: Any) -> Condition:
        return self._compare("<", bound)

    def less_than_equal(self, bound: Any) -> Condition:
        return self._compare("<=", bound)

    def greater_than(self, bound: Any) -> Condition:
        return self._compare(">", bound)

    def greater_than_equal(self, bound: Any) -> Condition:
        return self._compare(">=", bound)

    def between(self, low: Any, high: Any) -> Condition:
        """Both ends included."""
        if self._bad(low) or self._bad(high):
            return Always(False)
        return self.greater_than_equal(low) & self.less_than_equal(high)


class NumberKey(OrderedKey):
    """Numbers whose bounds are checked: null raises, so does NaN; -0.0 counts as 0.0."""

    strict = True

    def _compare(self, op: str, bound: Any) -> Condition:
        if isinstance(bound, float) and math.isnan(bound):
            raise ValueError("a bound can't be NaN")
        return super()._compare(op, bound + 0.0 if isinstance(bound, float) else bound)


class ExactKey(Key):
    """Equality only, and no null: numbers, strings or UUIDs that serve as identifiers."""

    def is_(self, value: Any) -> Condition:
        if value is None:
            raise ValueError("this key has no null")
        return equals(self.column, str(value) if isinstance(value, uuid.UUID) else value)

    def in_(self, *values: Any) -> Condition:
        if not values:
            return Always(False)
        first, *rest = map(self.is_, values)
        for c in rest:
            first = first | c
        return first


class TextKey(OrderedKey):
    def contains(self, part: str) -> Condition:
        return null_false(self.column.contains(_need(part)), self.column)

    def contains_ignore_case(self, part: str) -> Condition:
        return null_false(F.lower(self.column).contains(part.lower()), self.column)

    def starts_with(self, part: str) -> Condition:
        return null_false(self.column.startswith(_need(part)), self.column)

    def starts_with_ignore_case(self, part: str) -> Condition:
        return null_false(F.lower(self.column).startswith(part.lower()), self.column)

    def ends_with(self, part: str) -> Condition:
        return null_false(self.column.endswith(_need(part)), self.column)

    def ends_with_ignore_case(self, part: str) -> Condition:
        return null_false(F.lower(self.column).endswith(part.lower()), self.column)

    def is_empty(self) -> Condition:
        """Null counts as empty."""
        return self.is_null() | self.is_("")

    def is_blank(self) -> Condition:
        """Null, empty, or white space only."""
        return total(text.is_blank(self.column))


class BoolKey(Key):
    """True or not true: false and null are one key."""

    def is_(self, value: bool | None) -> Condition:
        true = self.column.eqNullSafe(F.lit(True))
        return total(true if value else ~true)

    def in_(self, *values: bool | None) -> Condition:
        first, *rest = map(self.is_, values)
        for c in rest:
            first = first | c
        return first

    def is_true(self) -> Condition:
        return self.is_(True)

    def is_false(self) -> Condition:
        return self.is_(False)


class MultiKey(Key):
    """A list of keys a row.  Null elements are no keys; an empty or null list has none."""

    def _has(self, value: Any) -> Column:
        return F.coalesce(F.array_contains(self.column, F.lit(value)), F.lit(False))

    def is_(self, value: Any) -> Condition:
        if value is None:
            return Always(False)
        return total(self._has(value))

    def is_null(self) -> Condition:
        return total(F.coalesce(F.size(F.array_compact(self.column)), F.lit(0)) <= 0)

    def in_(self, *values: Any) -> Condition:
        wanted = [v for v in values if v is not None]
        if not wanted:
            return Always(False)
        return total(F.coalesce(F.arrays_overlap(self.column, F.array(*map(F.lit, wanted))), F.lit(False)))

    def all_(self, *values: Any) -> Condition:
        """Every value is among the row's keys."""
        if not values:
            return Always(True)
        first, *rest = (self.is_(v) for v in values)
        for c in rest:
            first = first & c
        return first

    def matches(self, test: Callable[[Column], Column]) -> Condition:
        """Some key satisfies the predicate."""
        return total(F.coalesce(F.exists(self.column, lambda x: x.isNotNull() & F.coalesce(test(x), F.lit(False))), F.lit(False)))

    def like(self, sample: Mapping[str, Any]) -> Condition:
        """All of the sample's keys."""
        return self.all_(*[v for v in (self.value_of(sample) or []) if v is not None])

    def keys(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("key", F.explode(F.array_compact(self.column)))


class CompositeKey(Key):
    """Several positions.  A null position of the key asked for is a wildcard; all null matches nothing."""

    def __init__(self, name: str, positions: Sequence[Column | str]) -> None:
        self.positions = [_column(p) for p in positions]
        super().__init__(name, F.struct(*[p.alias(f"p{i}") for i, p in enumerate(self.positions)]))

    def _asked(self, value: Sequence[Any]) -> list[tuple[Column, Any]]:
        if len(value) != len(self.positions):
            raise ValueError(f"{self.name} has {len(self.positions)} positions")
        return [(p, v) for p, v in zip(self.positions, value, strict=True) if v is not None]

    def is_(self, value: Sequence[Any] | None) -> Condition:
        parts = [equals(p, v) for p, v in self._asked(value)] if value is not None else []
        if not parts:
            return Always(False)
        first, *rest = parts
        for c in rest:
            first = first & c
        return first

    def in_(self, *values: Sequence[Any]) -> Condition:
        first, *rest = map(self.is_, values)
        for c in rest:
            first = first | c
        return first

    def matches(self, *tests: Callable[[Column], Column] | None) -> Condition:
        """A predicate a position; None accepts all."""
        parts = [judged(t(p)) for p, t in zip(self.positions, tests, strict=True) if t is not None]
        if not parts:
            return Always(True)
        first, *rest = parts
        for c in rest:
            first = first & c
        return first


# --- dates and times --------------------------------------------------------------------------


def _from(column: Column, low: Any, high: Any | None) -> Condition:
    """``low <= key < high``; without end where the calendar ends."""
    return compare(column, ">=", low) if high is None else span(column, low, high, open_end=True)


def _day_after(day: dt.date) -> dt.date | None:
    return None if day == dt.date.max else day + dt.timedelta(1)


def _check(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}")
    return value


class DateFields(Key):
    """Conditions on the calendar fields of a date or timestamp.  Years and days become ranges, which reach the scan."""

    def _start(self, day: dt.date) -> Any:
        return day

    def is_year(self, year: int) -> Condition:
        after = _day_after(dt.date(year, 12, 31))
        return _from(self.column, self._start(dt.date(year, 1, 1)), after and self._start(after))

    def is_month(self, month: int) -> Condition:
        return equals(F.month(self.column), _check("month", month, 1, 12))

    def is_day(self, day: int) -> Condition:
        return equals(F.dayofmonth(self.column), _check("day", day, 1, 31))

    def is_date(self, year: int, month: int, day: int) -> Condition:
        at = dt.date(year, month, day)
        after = _day_after(at)
        return _from(self.column, self._start(at), after and self._start(after))

    def is_leap_year(self) -> Condition:
        y = F.year(self.column)
        return null_false((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), self.column)

    def year_matches(self, test: Callable[[Column], Column]) -> Condition:
        return judged(test(F.year(self.column)))

    def month_matches(self, test: Callable[[Column], Column]) -> Condition:
        return judged(test(F.month(self.column)))

    def day_matches(self, test: Callable[[Column], Column]) -> Condition:
        return judged(test(F.dayofmonth(self.column)))


class TimeFields(Key):
    """Conditions on the clock fields."""

    def is_hour(self, hour: int) -> Condition:
        return equals(F.hour(self.column), _check("hour", hour, 0, 23))

    def is_minute(self, minute: int) -> Condition:
        return equals(F.minute(self.column), _check("minute", minute, 0, 59))

    def is_second(self, second: int) -> Condition:
        return equals(F.second(self.column), _check("second", second, 0, 59))

    def is_time(self, hour: int, minute: int, second: int) -> Condition:
        return self.is_hour(hour) & self.is_minute(minute) & self.is_second(second)

    def hour_matches(self, test: Callable[[Column], Column]) -> Condition:
        return judged(test(F.hour(self.column)))

    def minute_matches(self, test: Callable[[Column], Column]) -> Condition:
        return judged(test(F.minute(self.column)))

    def second_matches(self, test: Callable[[Column], Column]) -> Condition:
        return judged(test(F.second(self.column)))


class _Timeline(OrderedKey):
    """before, after and so on, with bounds that can't be null."""

    strict = True

    def before(self, bound: Any) -> Condition:
        return self._compare("<", _need(bound))

    def before_equal(self, bound: Any) -> Condition:
        return self._compare("<=", _need(bound))

    def after(self, bound: Any) -> Condition:
        return self._compare(">", _need(bound))

    def after_equal(self, bound: Any) -> Condition:
        return self._compare(">=", _need(bound))


class DateKey(DateFields, _Timeline):
    """Whole days."""


class YearMonthKey(_Timeline):
    """Months: any date of a month stands for it, in keys and in bounds."""

    def __init__(self, name: str, expression: Column | str | None = None) -> None:
        super().__init__(name, expression)
        self.raw, self.column = self.column, F.trunc(self.column, "month")

    def _compare(self, op: str, bound: Any) -> Condition:
        # Truncate the bound instead of the key, so that the scan can use it.
        first = _need(bound).replace(day=1)
        if first >= dt.date(9999, 12, 1) and op in ("<=", ">"):  # the last month has no next one
            return Always(False) if op == ">" else null_false(self.raw.isNotNull(), self.raw)
        after = None if op in ("<", ">=") else (first + dt.timedelta(31)).replace(day=1)
        return compare(self.raw, *{"<": ("<", first), "<=": ("<", after), ">": (">=", after), ">=": (">=", first)}[op])

    def is_(self, value: dt.date | None) -> Condition:
        return super().is_(None) if value is None else self._compare(">=", value) & self._compare("<=", value)

    def is_year_month(self, year: int, month: int) -> Condition:
        return self.is_(dt.date(year, _check("month", month, 1, 12), 1))

    def is_year(self, year: int) -> Condition:
        return _from(self.raw, dt.date(year, 1, 1), _day_after(dt.date(year, 12, 31)))

    def is_month(self, month: int) -> Condition:
        return equals(F.month(self.raw), _check("month", month, 1, 12))


class SecondsKey(DateFields, TimeFields, _Timeline):
    """Timestamps at the precision of seconds: fractions count for nothing, in keys and in bounds.

    Bounds are aligned to the second here, since a truncated key wouldn't reach the scan.
    """

    _second = dt.timedelta(seconds=1)

    def _start(self, day: dt.date) -> dt.datetime:
        return dt.datetime(day.year, day.month, day.day)

    def _compare(self, op: str, bound: dt.datetime) -> Condition:
        at = _need(bound).replace(microsecond=0)
        return compare(self.column, *{"<": ("<", at), "<=": ("<", at + self._second), ">": (">=", at + self._second), ">=": (">=", at)}[op])

    def is_(self, value: dt.datetime | None) -> Condition:
        if value is None:
            return super().is_(None)
        at = value.replace(microsecond=0)
        return span(self.column, at, at + self._second, open_end=True)

    def in_(self, *values: dt.datetime | None) -> Condition:
        if not values:
            return Always(False)
        first, *rest = map(self.is_, values)
        for c in rest:
            first = first | c
        return first

    def is_date_time(self, year: int, month: int, day: int, hour: int, minute: int, second: int) -> Condition:
        return self.is_(dt.datetime(year, month, day, hour, minute, second))


class InstantKey(SecondsKey):
    """Timestamps at full (microsecond) precision."""

    def _compare(self, op: str, bound: dt.datetime) -> Condition:
        return compare(self.column, op, _need(bound))

    def is_(self, value: dt.datetime | None) -> Condition:
        return equals(self.column, value)

    def in_second(self, reference: dt.datetime) -> Condition:
        at = reference.replace(microsecond=0)
        return span(self.column, at, at + self._second, open_end=True)


class ZonedKey(SecondsKey):
    """Local times with a zone, compared as instants in UTC at the precision of seconds; so are bounds with a zone.

    ``zone``: names or offsets (``+02:00``), by row or one for all.  A null time or zone is a null key.
    """

    def __init__(self, name: str, local: Column | str, zone: Column | str) -> None:
        self.local, self.zone = _column(local), _column(zone)
        super().__init__(name, F.convert_timezone(self.zone, F.lit("UTC"), self.local))

    @staticmethod
    def _utc(bound: dt.datetime) -> dt.datetime:
        return bound.astimezone(dt.timezone.utc).replace(tzinfo=None) if bound.tzinfo else bound

    def _compare(self, op: str, bound: dt.datetime) -> Condition:
        return super()._compare(op, self._utc(_need(bound)))

    def is_(self, value: dt.datetime | None) -> Condition:
        return super().is_(None if value is None else self._utc(value))


class TimeOfDayKey(TimeFields, _Timeline):
    """Times of day of a timestamp, compared in seconds."""

    def __init__(self, name: str, expression: Column | str | None = None) -> None:
        super().__init__(name, expression)
        self.seconds = F.hour(self.column) * 3600 + F.minute(self.column) * 60 + F.second(self.column)

    @staticmethod
    def _of(time: dt.time) -> int:
        return time.hour * 3600 + time.minute * 60 + time.second

    def _compare(self, op: str, bound: dt.time) -> Condition:
        return compare(self.seconds, op, self._of(_need(bound)))

    def is_(self, value: dt.time | None) -> Condition:
        return super().is_(None) if value is None else equals(self.seconds, self._of(value))


# --- places -----------------------------------------------------------------------------------


class SpatialKey(Key):
    """A latitude and a longitude in degrees, held as fixed-point numbers of 1e-7 degrees."""

    def __init__(self, name: str, latitude: Column | str, longitude: Column | str) -> None:
        self.latitude, self.longitude = _column(latitude).cast("double"), _column(longitude).cast("double")
        self.lat, self.lon = geo.fixed(self.latitude), geo.fixed(self.longitude)
        super().__init__(name, F.struct(self.lat.alias("lat"), self.lon.alias("lon")))

    def at(self, latitude: float, longitude: float) -> Condition:
        geo.check(latitude, longitude)
        return equals(self.lat, geo.fixed_number(latitude)) & equals(self.lon, geo.fixed_number(longitude))

    is_ = lambda self, value: self.is_null() if value is None else self.at(*value)

    def is_null(self) -> Condition:
        return equals(self.lat, None) & equals(self.lon, None)

    def latitude_between(self, low: float, high: float) -> Condition:
        return self.latitude_above(low) & self.latitude_below(high)

    def latitude_above(self, bound: float) -> Condition:
        return self._beyond(self.latitude, self.lat, ">=", bound)

    def latitude_below(self, bound: float) -> Condition:
        return self._beyond(self.latitude, self.lat, "<=", bound)

    @staticmethod
    def _beyond(raw: Column, fixed: Column, op: str, bound: float) -> Condition:
        """A bound in fixed-point numbers, and a slightly wider one on the degrees themselves, which the scan can use."""
        slack = -2e-7 if op == ">=" else 2e-7
        return compare(raw, op, float(bound) + slack) & compare(fixed, op, geo.fixed_number(bound))

    def longitude_between(self, low: float, high: float) -> Condition:
        return self.longitude_above(low) & self.longitude_below(high)

    def longitude_above(self, bound: float) -> Condition:
        return self._beyond(self.longitude, self.lon, ">=", bound)

    def longitude_below(self, bound: float) -> Condition:
        return self._beyond(self.longitude, self.lon, "<=", bound)

    def within_box(self, south: float, north: float, west: float, east: float) -> Condition:
        """A box that crosses the antimeridian has ``west > east``."""
        band = self.latitude_between(south, north)
        if west > east:
            return band & (self.longitude_above(west) | self.longitude_below(east))
        return band & self.longitude_between(west, east)

    def near(self, latitude: float, longitude: float, km: float) -> Condition:
        """The bounding box of a circle: computed here, so the scan sees constants.  Not the circle itself."""
        south, north, west, east = geo.box(latitude, longitude, km)
        if west is None:
            return self.latitude_between(south, north)
        return self.within_box(south, north, west, east)

    def within_radius(self, latitude: float, longitude: float, km: float) -> Condition:
        """The exact circle, looked for in its bounding box; rows without coordinates are outside."""
        circle = judged(self.distance(latitude, longitude) <= km)
        return self.near(latitude, longitude, km * (1 + 1e-9) + 1e-3) & circle if km >= 0 else circle

    def distance(self, latitude: float, longitude: float) -> Column:
        return geo.haversine(self.latitude, self.longitude, F.lit(float(latitude)), F.lit(float(longitude)))
