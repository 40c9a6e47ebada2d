"""Keys of each kind on literal rows."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from indexframe.functions import geo
from indexframe.operators.collection import Collection, derive_keys
from indexframe.plans import keys as K
from indexframe.plans.query import apply_condition


def found(spark, values, kind, condition, cast="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {cast}")
    return [r.i for r in apply_condition(df, condition(kind("v"))).orderBy("i").collect()]


def test_blank_and_empty(spark):
    values = [None, "", " ", "\t", "\x1f", " ", "　", " ", "x", " x "]
    assert found(spark, values, K.TextKey, lambda k: k.is_blank()) == [0, 1, 2, 3, 4, 5, 6]
    assert found(spark, values, K.TextKey, lambda k: k.is_empty()) == [0, 1]
    assert found(spark, values, K.TextKey, lambda k: ~k.is_blank()) == [7, 8, 9]


def test_ignore_case(spark):
    values = ["Straße", "STRASSE", None, "abc"]
    assert found(spark, values, K.TextKey, lambda k: k.contains_ignore_case("STRA")) == [0, 1]
    assert found(spark, values, K.TextKey, lambda k: ~k.ends_with_ignore_case("C")) == [0, 1, 2]


SECONDS = [None, dt.datetime(2024, 2, 29, 10, 0, 0), dt.datetime(2024, 2, 29, 10, 0, 0, 999_999), dt.datetime(2024, 2, 29, 10, 0, 1), dt.datetime(2023, 12, 31, 23, 59, 59, 500_000)]


def times(spark, condition, kind=K.SecondsKey):
    return found(spark, SECONDS, kind, condition, "timestamp_ntz")


def test_seconds(spark):
    at = dt.datetime(2024, 2, 29, 10, 0, 0, 5)
    assert times(spark, lambda k: k.is_(at)) == [1, 2]
    assert times(spark, lambda k: k.before(at)) == [4]
    assert times(spark, lambda k: k.before_equal(at)) == [1, 2, 4]
    assert times(spark, lambda k: k.after(at)) == [3]
    assert times(spark, lambda k: ~k.after(at)) == [0, 1, 2, 4]
    assert times(spark, lambda k: k.in_(at, None)) == [0, 1, 2]
    assert times(spark, lambda k: k.is_year(2023)) == [4]
    assert times(spark, lambda k: k.is_leap_year()) == [1, 2, 3]
    assert times(spark, lambda k: ~k.is_leap_year()) == [0, 4]
    assert times(spark, lambda k: k.is_date(2024, 2, 29) & k.is_second(0)) == [1, 2]
    assert times(spark, lambda k: k.is_date_time(2024, 2, 29, 10, 0, 1)) == [3]


def test_instants_and_times_of_day(spark):
    at = dt.datetime(2024, 2, 29, 10, 0, 0)
    assert times(spark, lambda k: k.is_(at), K.InstantKey) == [1]
    assert times(spark, lambda k: k.in_second(at), K.InstantKey) == [1, 2]
    assert times(spark, lambda k: k.before(dt.time(10, 0, 1)), K.TimeOfDayKey) == [1, 2]
    assert times(spark, lambda k: k.is_(dt.time(23, 59, 59)), K.TimeOfDayKey) == [4]


def test_months(spark):
    assert times(spark, lambda k: k.is_year_month(2024, 2), K.YearMonthKey) == [1, 2, 3]
    assert times(spark, lambda k: k.before(dt.date(2024, 2, 20)), K.YearMonthKey) == [4]
    assert times(spark, lambda k: k.after_equal(dt.date(2023, 12, 31)), K.YearMonthKey) == [1, 2, 3, 4]


def test_bounds_are_checked():
    with pytest.raises(ValueError):
        K.NumberKey("v").less_than(None)
    with pytest.raises(ValueError):
        K.NumberKey("v").between(1.0, float("nan"))
    with pytest.raises(ValueError):
        K.SecondsKey("v").before(None)
    with pytest.raises(ValueError):
        K.SecondsKey("v").is_month(13)
    with pytest.raises(ValueError):
        K.ExactKey("v").is_(None)


def test_minus_zero_and_uuid(spark):
    assert found(spark, [0.0, -0.0, 1.0], K.NumberKey, lambda k: k.between(-0.0, 0.0), "double") == [0, 1]
    u = uuid.uuid4()
    assert found(spark, [str(u), "x", None], K.ExactKey, lambda k: k.is_(u)) == [0]
    assert found(spark, [str(u), "x", None], K.ExactKey, lambda k: k.not_in("x")) == [0, 2]


def test_multi_value(spark):
    values = [None, [], ["a", None], ["a", "b"], ["c"]]
    ask = lambda c: found(spark, values, K.MultiKey, c, "array<string>")
    assert ask(lambda k: k.is_("a")) == [2, 3]
    assert ask(lambda k: k.not_("a")) == [0, 1, 4]
    assert ask(lambda k: k.in_("b", "c")) == [3, 4]
    assert ask(lambda k: k.not_in("b", "c")) == [0, 1, 2]
    assert ask(lambda k: k.all_("a", "b")) == [3]
    assert ask(lambda k: k.matches(lambda x: x > "a")) == [3, 4]
    assert ask(lambda k: k.like({"v": ["a", None]})) == [2, 3]
    assert ask(lambda k: k.is_null()) == [0, 1]


def test_composite(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", None), (2, None, 1), (3, "b", 1)], "i int, x string, y int")
    key = K.CompositeKey("c", ["x", "y"])
    ask = lambda c: [r.i for r in apply_condition(df, c).orderBy("i").collect()]
    assert ask(key.is_(("a", None))) == [0, 1] and ask(key.is_(("a", 1))) == [0] and ask(key.is_((None, None))) == []
    assert ask(~key.is_(("a", None))) == [2, 3]
    assert ask(key.in_(("a", 1), ("b", None))) == [0, 3]
    with pytest.raises(ValueError):
        key.is_(("a",))


def test_places(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 179.9), (2, 0.0, -179.9), (3, 89.95, 10.0), (4, None, None), (5, 0.3, 0.3)], "i int, lat double, lon double")
    key = K.SpatialKey("p", "lat", "lon")
    ask = lambda c: [r.i for r in apply_condition(df, c).orderBy("i").collect()]
    assert ask(key.near(0.0, 180.0, 50)) == [1, 2]
    assert ask(key.near(89.95, -170.0, 50)) == [3]
    assert ask(key.near(0.0, 0.0, 40)) == [0, 5] and ask(key.within_radius(0.0, 0.0, 40)) == [0]
    assert ask(~key.within_radius(0.0, 0.0, 40)) == [1, 2, 3, 4, 5]
    assert ask(key.is_null()) == [4] and ask(key.at(0.3, 0.3)) == [5]
    with pytest.raises(ValueError):
        key.at(91.0, 0.0)
    with pytest.raises(ValueError):
        geo.check(None, 1.0)


def test_keys_by_name_and_type(spark):
    df = spark.createDataFrame([(1, "x", True, [1])], "_id long, s string, b boolean, m array<int>")
    c = Collection(df).with_keys(*derive_keys(df.schema))
    assert isinstance(c.key("s"), K.TextKey) and isinstance(c.key("b"), K.BoolKey) and isinstance(c.key("m"), K.MultiKey)
    with pytest.raises(KeyError):
        c.key("none")
    with pytest.raises(ValueError):
        c.with_keys(K.Key("s"))
    assert c.ensure_keys(K.Key("s")).keys == c.keys and "s" not in c.without_key("s").keys
    assert K.Key("s").equal_keys({"s": 1}, {"s": 1}) and F is not None
