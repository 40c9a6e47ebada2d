"""Two-valued logic, precedence and memberships, over rows with nulls."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from indexframe.operators.collection import Collection
from indexframe.plans import keys as K
from indexframe.plans.condition import Always, And, Not, Or, Term
from indexframe.plans.query import Query, apply_condition

ROWS = [(i, a, b) for i, (a, b) in enumerate(itertools.product([None, 1, 2, 3], [None, "x", "y"]))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "_id long, a int, b string").cache()


def ids(df):
    return sorted(r["_id"] for r in df.collect())


def plain(test):
    return sorted(i for i, a, b in ROWS if test(a, b))


class _Lazy:
    """Keys need a session, so they are made when they are used."""

    def __init__(self, make):
        self._make = make

    def __getattr__(self, name):
        return getattr(self._make(), name)


A, B = _Lazy(lambda: K.OrderedKey("a")), _Lazy(lambda: K.TextKey("b"))
LEAVES = [
    (lambda: A.is_(1), lambda a, b: a == 1),
    (lambda: A.is_(None), lambda a, b: a is None),
    (lambda: A.in_(1, None), lambda a, b: a in (1, None)),
    (lambda: A.not_in(2, 3), lambda a, b: a not in (2, 3)),
    (lambda: A.less_than(2), lambda a, b: a is not None and a < 2),
    (lambda: A.between(2, 3), lambda a, b: a is not None and 2 <= a <= 3),
    (lambda: A.less_than(None), lambda a, b: False),
    (lambda: B.is_empty(), lambda a, b: b in (None, "")),
    (lambda: B.starts_with("x"), lambda a, b: b is not None and b.startswith("x")),
    (lambda: B.matches(lambda c: c == "y"), lambda a, b: b == "y"),
    (lambda: K.BoolKey("t", "a = 1").is_false(), lambda a, b: a != 1),
]


@pytest.mark.parametrize("k", range(len(LEAVES)))
def test_leaf_and_its_negation(rows, k):
    make, test = LEAVES[k]
    condition = make()
    assert ids(apply_condition(rows, condition)) == plain(test)
    assert ids(apply_condition(rows, ~condition)) == plain(lambda a, b: not test(a, b))
    assert ids(apply_condition(rows, ~~condition)) == plain(test)


def test_random_trees(rows):
    rng = random.Random(4)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            make, test = rng.choice(LEAVES)
            return make(), test
        kind = rng.choice("&|~")
        c, f = tree(depth - 1)
        if kind == "~":
            return ~c, lambda a, b: not f(a, b)
        d, g = tree(depth - 1)
        if kind == "&":
            return c & d, lambda a, b: f(a, b) and g(a, b)
        return c | d, lambda a, b: f(a, b) or g(a, b)

    # All at once: one column a tree.
    trees = [tree(4) for _ in range(60)]
    marks = [c.lower(True, None).alias(f"c{i}") for i, (c, _) in enumerate(trees)]
    for r in rows.select("a", "b", *[F.coalesce(m, F.lit(False)) for m in marks]).collect():
        for i, (_, f) in enumerate(trees):
            assert bool(r[2 + i]) == bool(f(r["a"], r["b"])), i


def test_and_binds_tighter_when_chained(rows):
    one, two, x = A.is_(1), A.is_(2), B.is_("x")
    assert ids(apply_condition(rows, one.or_(two).and_(x))) == plain(lambda a, b: a == 1 or a == 2 and b == "x")
    assert ids(apply_condition(rows, (one | two) & x)) == plain(lambda a, b: a in (1, 2) and b == "x")
    assert ids(apply_condition(rows, one.and_(x).or_(two).and_(x))) == plain(lambda a, b: b == "x" and a in (1, 2))
    c = Collection(rows)
    assert ids(c.query(one | two).and_(x).df()) == plain(lambda a, b: a in (1, 2) and b == "x")
    assert ids(c.query(one).or_(two).and_(x).df()) == plain(lambda a, b: a == 1 or a == 2 and b == "x")
    assert isinstance(one.or_(two).and_(x), Or) and isinstance(Term(one | two).and_(x), And)


def test_flattening():
    a, b, c = Always(), Always(False), Not(Always())
    assert len((a & b & c).parts) == 3 and len((a | b | c).parts) == 3


def test_memberships(spark, rows):
    other = spark.createDataFrame([(1,), (None,), (1,)], "a int")
    member = A.in_query(other)
    assert ids(apply_condition(rows, member)) == plain(lambda a, b: a in (1, None))
    assert ids(apply_condition(rows, ~member)) == plain(lambda a, b: a not in (1, None))
    assert ids(apply_condition(rows, ~member | B.is_("x"))) == plain(lambda a, b: a not in (1, None) or b == "x")
    assert ids(apply_condition(rows, ~(member & B.is_("x")))) == plain(lambda a, b: not (a in (1, None) and b == "x"))
    assert ids(apply_condition(rows, A.matches_python(rows, lambda v: v is None or v > 2))) == plain(lambda a, b: a in (None, 3))


def test_opaque_predicate_is_called_once_a_key(spark, rows):
    distinct = A.matches_python(rows, lambda v: True).values
    assert distinct.count() == 4


def test_sub_queries(rows):
    c = Collection(rows)
    inner = c.query(B.is_("x"))
    assert ids(c.query(A.is_(1)).and_(inner).df()) == plain(lambda a, b: a == 1 and b == "x")
    assert ids(c.query().and_([0, 3, 99]).id_range(0, 3).df()) == [0]
    assert ids(c.query().and_([]).df()) == []
    assert ids(c.query().and_(inner).df()) == plain(lambda a, b: b == "x")
    q = c.query(A.is_(1))
    assert q.and_(q) is q
    outer = Query(c).and_(q)
    with pytest.raises(ValueError):
        q.and_(outer)


def test_pages(rows):
    c = Collection(rows)
    assert [r["_id"] for r in c.query().to_list(3, 2)] == [3, 4]
    assert [r["_id"] for r in c.query().id_start(9)] == [9, 10, 11]
    assert c.query(A.is_(99)).find_first() is None and c.query().count() == len(ROWS)
    with pytest.raises(ValueError):
        c.query().page(-1)
    repeated = Collection(rows.select("_id", "b"))
    assert repeated.query().distinct_page(0, 3).count() == 3 and repeated.query().distinct_page(0, 6).count() == 3


def test_filters_reach_the_scan(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    condition = ~(A.less_than(2) & B.is_("x"))
    plan = apply_condition(stored, condition)._jdf.queryExecution().toString()
    pushed = plan.split("PushedFilters:")[-1].split("]")[0]
    assert "GreaterThanOrEqual(a,2)" in pushed and "IsNull(a)" in pushed and "EqualNullSafe(b,x)" in pushed


def test_places_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 1.5D AS lat", "id * 2.5D AS lon").write.parquet(str(tmp_path / "places"))
    saved = spark.read.parquet(str(tmp_path / "places"))
    key = K.SpatialKey("place", "lat", "lon")
    for condition in (key.near(5, 5, 300), key.within_radius(5, 5, 300), key.within_box(1, 2, 3, 4)):
        plan = apply_condition(saved, condition)._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters:")[1]  # longer ones are cut
        assert "LessThanOrEqual(lon," in pushed and "GreaterThanOrEqual(lon," in pushed, plan


def test_ends_of_the_calendar(spark):
    import datetime as dt

    rows = spark.createDataFrame([(1, dt.datetime(9999, 12, 31, 5)), (2, dt.datetime(9998, 1, 1)), (3, None)], "_id long, t timestamp_ntz")
    s, m = K.SecondsKey("t"), K.YearMonthKey("t")
    assert ids(apply_condition(rows, s.is_year(9999))) == ids(apply_condition(rows, s.is_date(9999, 12, 31))) == [1]
    assert ids(apply_condition(rows, ~s.is_year(9999))) == [2, 3]
    assert ids(apply_condition(rows, m.is_year(9999))) == ids(apply_condition(rows, m.is_year_month(9999, 12))) == [1]
    assert ids(apply_condition(rows, m.after(dt.date(9999, 12, 1)))) == [] and ids(apply_condition(rows, m.before_equal(dt.date(9999, 12, 5)))) == [1, 2]
