"""Dates and times (E), booleans, multi-value and composite keys (F), places (G)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.collection import Collection
from ..plans import keys as K
from .registry import Tables, case, orders

_IDS = "SELECT o_orderkey FROM orders WHERE "
_EVENTS = "SELECT event_id FROM events WHERE "


def _orders(t: Tables, condition) -> DataFrame:
    o = orders(t)
    return o.query(condition(o.key("date"))).df().select("o_orderkey")


def _events(t: Tables, condition, kind=K.SecondsKey) -> DataFrame:
    return Collection(t.events, "event_id").query(condition(kind("ts", "ts"))).df().select("event_id")


@case(_IDS + "year(o_orderdate) = 1996")
def ts_year(t: Tables) -> DataFrame:
    return _orders(t, lambda k: k.is_year(1996))


@case(_IDS + "year(o_orderdate) <> 1996")
def ts_not_year(t: Tables) -> DataFrame:
    return _orders(t, lambda k: ~k.is_year(1996))


@case(_IDS + "year(o_orderdate) % 2 = 1")
def ts_year_predicate(t: Tables) -> DataFrame:
    return _orders(t, lambda k: k.year_matches(lambda y: y % 2 == 1))


@case(_IDS + "month(o_orderdate) = 2")
def ts_month(t: Tables) -> DataFrame:
    return _orders(t, lambda k: k.is_month(2))


@case(_IDS + "day(o_orderdate) = 29")
def ts_day(t: Tables) -> DataFrame:
    return _orders(t, lambda k: k.is_day(29))


@case(_IDS + "CAST(o_orderdate AS DATE) = DATE '1995-06-17'")
def ts_date(t: Tables) -> DataFrame:
    return _orders(t, lambda k: k.is_date(1995, 6, 17))


@case(_IDS + "(year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0))")
def ts_leap(t: Tables) -> DataFrame:
    return _orders(t, lambda k: k.is_leap_year())


@case(_EVENTS + "hour(ts) = 13")
def ts_hour(t: Tables) -> DataFrame:
    return _events(t, lambda k: k.is_hour(13))


@case(_EVENTS + "minute(ts) = 30 AND second(ts) < 10")
def ts_minute_second(t: Tables) -> DataFrame:
    return _events(t, lambda k: k.is_minute(30) & k.second_matches(lambda s: s < 10))


_MIDDLE = "(SELECT ts FROM events ORDER BY event_id LIMIT 1 OFFSET 500)"


def _middle(t: Tables) -> dt.datetime:
    return t.events.orderBy("event_id").offset(500).head()["ts"]


@case(_EVENTS + f"date_trunc('second', ts) < date_trunc('second', {_MIDDLE})")
def ts_before_second(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.before(at))


@case(_EVENTS + f"date_trunc('second', ts) > date_trunc('second', {_MIDDLE})")
def ts_after_second(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.after(at))


@case(_EVENTS + f"date_trunc('second', ts) BETWEEN date_trunc('second', {_MIDDLE}) - INTERVAL 1 HOUR AND date_trunc('second', {_MIDDLE})")
def ts_between_second(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.between(at - dt.timedelta(hours=1), at))


@case(_EVENTS + f"date_trunc('second', ts) = date_trunc('second', {_MIDDLE})")
def ts_is_second(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.is_(at))


@case(_EVENTS + f"ts <= {_MIDDLE}")
def ts_exact_before_equal(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.before_equal(at), K.InstantKey)


@case(_EVENTS + f"ts >= date_trunc('second', {_MIDDLE}) AND ts < date_trunc('second', {_MIDDLE}) + INTERVAL 1 SECOND")
def ts_in_second(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.in_second(at), K.InstantKey)


@case(_EVENTS + f"date_trunc('second', ts) NOT IN (date_trunc('second', {_MIDDLE}))")
def ts_not_in(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.not_in(at))


@case(_EVENTS + f"date_trunc('second', CAST(ts AS TIMESTAMP))::TIME = (SELECT date_trunc('second', ts)::TIME FROM events ORDER BY event_id LIMIT 1 OFFSET 500)")
def ts_time(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.is_time(at.hour, at.minute, at.second))


@case(_EVENTS + f"date_trunc('second', ts) = date_trunc('second', {_MIDDLE})")
def ts_date_time(t: Tables) -> DataFrame:
    at = _middle(t)
    return _events(t, lambda k: k.is_date_time(at.year, at.month, at.day, at.hour, at.minute, at.second))


@case(_IDS + "year(o_orderdate) >= 9999 OR CAST(o_orderdate AS DATE) = DATE '1995-06-17'")
def ts_end_of_calendar(t: Tables) -> DataFrame:
    return _orders(t, lambda k: k.is_year(9999) | k.is_date(9999, 12, 31) | k.is_date(1995, 6, 17))


_ZONE = "CASE event_id % 4 WHEN 0 THEN '+02:00' WHEN 1 THEN '-05:30' WHEN 2 THEN 'UTC' END"
_UTC = "CASE event_id % 4 WHEN 0 THEN ts - INTERVAL 2 HOUR WHEN 1 THEN ts + INTERVAL 330 MINUTE WHEN 2 THEN ts END"


@case(_EVENTS + f"date_trunc('second', {_UTC}) > date_trunc('second', {_MIDDLE}) - INTERVAL 3 HOUR AND date_trunc('second', {_UTC}) <= date_trunc('second', {_MIDDLE})")
def ts_zoned(t: Tables) -> DataFrame:
    key, at = K.ZonedKey("at", "ts", _ZONE), _middle(t)
    east = at.replace(tzinfo=dt.timezone.utc).astimezone(dt.timezone(dt.timedelta(hours=9)))  # the same instant
    return Collection(t.events, "event_id").query(key.after(at - dt.timedelta(hours=3)) & key.before_equal(east)).df().select("event_id")


@case(_EVENTS + f"hour({_UTC}) = 23 OR event_id % 4 = 3")
def ts_zoned_fields(t: Tables) -> DataFrame:
    key = K.ZonedKey("at", "ts", _ZONE)
    return Collection(t.events, "event_id").query(key.is_hour(23) | key.is_null()).df().select("event_id")


@case(_IDS + "date_trunc('month', o_orderdate) >= DATE '1995-02-01' AND date_trunc('month', o_orderdate) <= DATE '1995-04-01'")
def ts_year_month(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("month").between(dt.date(1995, 2, 10), dt.date(1995, 4, 3))).df().select("o_orderkey")


@case(_IDS + "year(o_orderdate) = 1995 AND month(o_orderdate) = 12")
def ts_is_year_month(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("month").is_year_month(1995, 12)).df().select("o_orderkey")


@case(_IDS + "CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-10' AND DATE '1996-01-20'")
def ts_local_date(t: Tables) -> DataFrame:
    key = K.DateKey("day", "cast(o_orderdate as date)")
    return Collection(t.orders, "o_orderkey").query(key.between(dt.date(1996, 1, 10), dt.date(1996, 1, 20))).df().select("o_orderkey")


@case(_EVENTS + "CAST(ts AS TIME) >= TIME '08:30:00' AND CAST(ts AS TIME) < TIME '09:00:01'")
def time_of_day(t: Tables) -> DataFrame:
    return _events(t, lambda k: k.between(dt.time(8, 30), dt.time(9, 0)), K.TimeOfDayKey)


# --- booleans, lists, composites ---

_TOXIC = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 1 END"


@case(f"SELECT doc_id FROM labels WHERE ({_TOXIC}) IS NOT DISTINCT FROM TRUE")
def bool_true(t: Tables) -> DataFrame:
    return Collection(t.labels, "doc_id").query(K.BoolKey("toxic", _TOXIC).is_true()).df().select("doc_id")


@case(f"SELECT doc_id FROM labels WHERE ({_TOXIC}) IS DISTINCT FROM TRUE")
def bool_false_or_null(t: Tables) -> DataFrame:
    return Collection(t.labels, "doc_id").query(K.BoolKey("toxic", _TOXIC).is_false()).df().select("doc_id")


_FLAGS_SQL = "(SELECT l_orderkey AS k, list(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 10) AS flags FROM lineitem GROUP BY l_orderkey)"


def _flags(t: Tables) -> tuple[Collection, K.MultiKey]:
    found = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.when(F.col("l_quantity") > 10, F.col("l_returnflag"))).alias("flags"))
    return Collection(found, "k"), K.MultiKey("flags", "flags")


@case(f"SELECT k FROM {_FLAGS_SQL} WHERE coalesce(list_has_any(flags, ['R', 'A']), FALSE)")
def multi_any(t: Tables) -> DataFrame:
    c, k = _flags(t)
    return c.query(k.in_("R", "A")).df().select("k")


@case(f"SELECT k FROM {_FLAGS_SQL} WHERE coalesce(list_has_all(flags, ['R', 'N']), FALSE)")
def multi_all(t: Tables) -> DataFrame:
    c, k = _flags(t)
    return c.query(k.all_("R", "N")).df().select("k")


@case(f"SELECT k FROM {_FLAGS_SQL} WHERE NOT coalesce(list_has_any(flags, ['R', 'A']), FALSE)")
def multi_none(t: Tables) -> DataFrame:
    c, k = _flags(t)
    return c.query(k.not_in("R", "A")).df().select("k")


@case(f"SELECT k FROM {_FLAGS_SQL} WHERE NOT coalesce(list_contains(flags, 'N'), FALSE)")
def multi_not(t: Tables) -> DataFrame:
    c, k = _flags(t)
    return c.query(k.not_("N")).df().select("k")


@case(f"SELECT k FROM {_FLAGS_SQL} WHERE coalesce(list_contains(flags, 'N') OR list_contains(flags, 'R'), FALSE)")
def multi_predicate(t: Tables) -> DataFrame:
    c, k = _flags(t)
    return c.query(k.matches(lambda x: x > "B")).df().select("k")


@case(f"SELECT k FROM {_FLAGS_SQL} WHERE coalesce(list_has_all(flags, ['A', 'R']), FALSE)")
def multi_like(t: Tables) -> DataFrame:
    c, k = _flags(t)
    return c.query(k.like({"flags": ["A", None, "R"]})).df().select("k")


@case(f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM {_FLAGS_SQL}) GROUP BY flag")
def multi_key_listing(t: Tables) -> DataFrame:
    c, k = _flags(t)
    return c.with_keys(k).statistics("flags").select(F.col("key").alias("flag"), F.col("entries").alias("n"))


@case("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2")
def composite_wildcard(t: Tables) -> DataFrame:
    key = K.CompositeKey("c", ["l_returnflag", "l_linestatus", "l_linenumber"])
    return Collection(t.lineitem, "l_orderkey").query(key.is_(("R", None, 2))).df().select("l_orderkey", "l_linenumber")


@case("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag > 'B' AND l_linenumber % 2 = 0")
def composite_predicate(t: Tables) -> DataFrame:
    key = K.CompositeKey("c", ["l_returnflag", "l_linestatus", "l_linenumber"])
    return Collection(t.lineitem, "l_orderkey").query(key.matches(lambda c: c > "B", None, lambda c: c % 2 == 0)).df().select("l_orderkey", "l_linenumber")


# --- places ---

_LAT, _LON = "(CAST(c_custkey % 1800 AS DOUBLE) / 10.0 - 90.0)", "(CAST(c_custkey * 7 % 3600 AS DOUBLE) / 10.0 - 180.0)"
_FIX = "CAST(trunc({} * 1e7) AS INTEGER)"
_FLAT, _FLON = _FIX.format(_LAT), _FIX.format(_LON)
_PEOPLE = "SELECT c_custkey FROM customer WHERE "


def _places(t: Tables) -> tuple[Collection, K.SpatialKey]:
    place = K.SpatialKey("place", _LAT, _LON)
    return Collection(t.customer, "c_custkey").with_keys(place), place


def _place(t: Tables, condition) -> DataFrame:
    c, k = _places(t)
    return c.query(condition(k)).df().select("c_custkey")


@case(_PEOPLE + f"{_FLAT} = -899000000 AND {_FLON} = -1793000000")
def geo_exact(t: Tables) -> DataFrame:
    return _place(t, lambda k: k.at(-89.9, -179.3))


@case(_PEOPLE + f"{_FLAT} BETWEEN -100000000 AND 200000000 AND {_FLON} BETWEEN -500000000 AND 300000000")
def geo_box(t: Tables) -> DataFrame:
    return _place(t, lambda k: k.within_box(-10, 20, -50, 30))


@case(_PEOPLE + f"{_FLAT} BETWEEN -400000000 AND 400000000 AND ({_FLON} >= 1700000000 OR {_FLON} <= -1650000000)")
def geo_box_antimeridian(t: Tables) -> DataFrame:
    return _place(t, lambda k: k.within_box(-40, 40, 170, -165))


# 3000 km around 10 N, 20 E, by the definition: degrees to the north and south, and to the east and west.
_REACH, _SIDE = "degrees(3000.0 / 6371.0)", "degrees(3000.0 / 6371.0) / cos(radians(10.0))"


@case(_PEOPLE + f"{_LAT} BETWEEN 10.0 - {_REACH} AND 10.0 + {_REACH} AND {_LON} BETWEEN 20.0 - {_SIDE} AND 20.0 + {_SIDE}")
def geo_near(t: Tables) -> DataFrame:
    return _place(t, lambda k: k.near(10.0, 20.0, 3000.0))


_A = "(power(sin(radians(10.0 - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(10.0)) * power(sin(radians(20.0 - {lon}) / 2), 2))".format(lat=_LAT, lon=_LON)
_KM = f"(2 * 6371.0 * atan2(sqrt({_A}), sqrt(1 - {_A})))"


@case(_PEOPLE + f"{_KM} <= 2500")
def geo_radius(t: Tables) -> DataFrame:
    return _place(t, lambda k: k.within_radius(10.0, 20.0, 2500.0))


@case("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1")
def geo_null(t: Tables) -> DataFrame:
    lat, lon = (f"CASE WHEN c_custkey % 4 <> 1 THEN {x} END" for x in (_LAT, _LON))
    return Collection(t.customer, "c_custkey").query(K.SpatialKey("place", lat, lon).is_null()).df().select("c_custkey")


@case(f"SELECT c_custkey, round({_KM}, 4) AS km FROM customer ORDER BY {_KM}, c_custkey LIMIT 10")
def geo_knn(t: Tables) -> DataFrame:
    c, k = _places(t)
    return c.df.withColumn("d", k.distance(10.0, 20.0)).orderBy("d", "c_custkey").limit(10).select("c_custkey", F.round("d", 4).alias("km"))


@case(f"SELECT c_custkey, round({_KM}, 4) AS km FROM customer WHERE {_KM} <= 2500 AND c_custkey <> 100 ORDER BY {_KM}, c_custkey")
def geo_neighbours(t: Tables) -> DataFrame:
    c, k = _places(t)
    found = c.query(k.near(10.0, 20.0, 2500.0)).and_(k.within_radius(10.0, 20.0, 2500.0)).and_(K.Key("c_custkey").not_(100)).df()
    return found.withColumn("d", k.distance(10.0, 20.0)).orderBy("d", "c_custkey").select("c_custkey", F.round("d", 4).alias("km"))


@case(f"SELECT CASE WHEN {_LAT} >= 0 THEN 'north' ELSE 'south' END AS half, count(*) AS n FROM customer WHERE {_FLAT} BETWEEN -234000000 AND 234000000 GROUP BY 1")
def geo_hemisphere(t: Tables) -> DataFrame:
    c, k = _places(t)
    return c.query(k.latitude_between(-23.4, 23.4)).df().groupBy(F.when(k.latitude >= 0, "north").otherwise("south").alias("half")).agg(F.count(F.lit(1)).alias("n"))


@case(_PEOPLE + f"{_FLAT} >= 300000000 AND {_FLON} <= 0 AND {_FLON} >= -1000000000")
def geo_above_below(t: Tables) -> DataFrame:
    return _place(t, lambda k: k.latitude_above(30) & k.longitude_below(0) & k.longitude_above(-100))


@case(f"SELECT c_custkey FROM customer WHERE (c_custkey % 7 = 0) OR abs({_LON}) > 175")
def geo_invalid(t: Tables) -> DataFrame:
    c, k = _places(t)
    lat, lon = F.when(F.col("c_custkey") % 7 != 0, k.latitude), F.when(F.abs(k.longitude) > 175, k.longitude + 360).otherwise(k.longitude)
    return c.df.where(geo.invalid(lat, F.when(F.abs(k.longitude) > 175, F.lit(500.0)).otherwise(lon))).select("c_custkey")


