"""Equality, membership and boolean algebra (B), comparisons (C), strings (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.collection import Collection
from ..plans import keys as K
from ..plans.condition import judged
from .registry import STATUS, Tables, case, orders

_IDS = "SELECT o_orderkey FROM orders WHERE "


@case("""SELECT o_orderstatus, count(*) AS n FROM orders
WHERE (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01') OR o_orderpriority = '1-URGENT' GROUP BY o_orderstatus""")
def pred_is_or_and_precedence(t: Tables) -> DataFrame:
    o = orders(t)
    found = o.query(o.key("priority").is_("1-URGENT")).or_(o.key("status").is_("F")).and_(o.key("date").is_year(1995))
    return found.df().groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@case(_IDS + "(o_orderpriority = '1-URGENT' OR o_orderstatus = 'F') AND o_totalprice >= 100000")
def pred_term_closed(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("priority").is_("1-URGENT") | o.key("status").is_("F")).and_(o.key("price").greater_than_equal(100000.0)).df().select("o_orderkey")


@case(_IDS + f"({STATUS}) IS DISTINCT FROM 'F'")
def pred_not_null_safe(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status_or_null").not_("F")).df().select("o_orderkey")


@case(_IDS + f"({STATUS}) IS NULL")
def pred_is_null(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status_or_null").is_null()).df().select("o_orderkey")


@case(_IDS + f"({STATUS}) IS NOT NULL")
def pred_not_null(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status_or_null").not_null()).df().select("o_orderkey")


@case(_IDS + f"({STATUS}) IN ('F', 'P') OR ({STATUS}) IS NULL")
def pred_in_with_null(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status_or_null").in_("F", "P", None)).df().select("o_orderkey")


@case(_IDS + f"({STATUS}) NOT IN ('F', 'P') OR ({STATUS}) IS NULL")
def pred_not_in_null_safe(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status_or_null").not_in("F", "P")).df().select("o_orderkey")


@case(_IDS + f"NOT coalesce(({STATUS}) = 'F' AND o_totalprice < 200000, FALSE) AND NOT coalesce(o_orderpriority = '5-LOW' OR ({STATUS}) = 'P', FALSE)")
def pred_nested_not(t: Tables) -> DataFrame:
    o = orders(t)
    s, low = o.key("status_or_null"), o.key("price").less_than(200000.0)
    return o.query(~(s.is_("F") & low) & ~(o.key("priority").is_("5-LOW") | s.is_("P"))).df().select("o_orderkey")


@case("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def pred_in_query(t: Tables) -> DataFrame:
    o, c = orders(t), Collection(t.customer, "c_custkey").with_keys(K.Key("custkey", "c_custkey"))
    rich = o.query(o.key("price").greater_than(300000.0))
    return c.query(c.key("custkey").in_query(rich, "o_custkey")).df().select("c_custkey")


@case("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def pred_not_in_query(t: Tables) -> DataFrame:
    c = Collection(t.customer, "c_custkey").with_keys(K.Key("custkey", "c_custkey"))
    return c.query(c.key("custkey").not_in_query(t.orders.where("o_totalprice > 300000"), "o_custkey")).df().select("c_custkey")


@case("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)")
def pred_in_query_under_or(t: Tables) -> DataFrame:
    c = Collection(t.customer, "c_custkey").with_keys(K.Key("custkey", "c_custkey"), K.NumberKey("balance", "c_acctbal"))
    return c.query(c.key("balance").less_than(0.0) | c.key("custkey").not_in_query(t.orders, "o_custkey")).df().select("c_custkey")


@case("SELECT p_partkey FROM part WHERE length(p_type) % 2 = 0")
def pred_key_predicate_column(t: Tables) -> DataFrame:
    return Collection(t.part, "p_partkey").query(K.Key("type", "p_type").matches(lambda c: F.length(c) % 2 == 0)).df().select("p_partkey")


@case("SELECT p_partkey FROM part WHERE list_aggregate(list_transform(regexp_extract_all(p_brand, '[0-9]'), lambda x: CAST(x AS INTEGER)), 'sum') % 2 = 1")
def pred_key_predicate_distinct(t: Tables) -> DataFrame:
    brand = K.Key("brand", "p_brand")
    return Collection(t.part, "p_partkey").query(brand.matches_python(t.part, lambda v: v is not None and sum(int(c) for c in v if c.isdigit()) % 2 == 1)).df().select("p_partkey")


_SAMPLE = "SELECT {} FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)"


@case(f"SELECT p_partkey FROM part WHERE p_brand = ({_SAMPLE.format('p_brand')}) AND p_size = ({_SAMPLE.format('p_size')})")
def pred_by_example(t: Tables) -> DataFrame:
    sample = t.part.orderBy("p_partkey").head().asDict()
    return Collection(t.part, "p_partkey").with_keys(K.Key("p_brand"), K.Key("p_size")).by_example(["p_brand", "p_size"], sample).df().select("p_partkey")


@case(f"SELECT p_partkey FROM part WHERE p_brand IS DISTINCT FROM ({_SAMPLE.format('p_brand')})")
def pred_unlike(t: Tables) -> DataFrame:
    sample = t.part.orderBy("p_partkey").head().asDict()
    return Collection(t.part, "p_partkey").query(K.Key("p_brand").unlike(sample)).df().select("p_partkey")


@case(_IDS + "o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def pred_builder_by_name(t: Tables) -> DataFrame:
    return orders(t).query().and_key("status").is_("O").and_key("priority").in_("1-URGENT", "2-HIGH").df().select("o_orderkey")


@case("SELECT o_orderkey, (o_orderstatus = 'F' AND o_totalprice > 1000) AS satisfied FROM orders ORDER BY o_orderkey LIMIT 5")
def pred_test_in_memory(t: Tables) -> DataFrame:
    o = orders(t)
    c = o.key("status").is_("F") & o.key("price").greater_than(1000.0)
    rows = o.scan().limit(5).collect()
    return t.spark.createDataFrame([(r.o_orderkey, o.test(c, r.asDict())) for r in rows], "o_orderkey long, satisfied boolean")


# --- comparisons ---

_LINES = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "
_NULLABLE = "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END"


def _range(t: Tables, condition) -> DataFrame:
    key = K.OrderedKey("quantity", _NULLABLE)
    return Collection(t.lineitem, "l_orderkey").query(condition(key)).df().select("l_orderkey", "l_linenumber")


@case(_LINES + f"({_NULLABLE}) < 5")
def range_lt(t: Tables) -> DataFrame:
    return _range(t, lambda k: k.less_than(5.0))


@case(_LINES + f"({_NULLABLE}) <= 5")
def range_le(t: Tables) -> DataFrame:
    return _range(t, lambda k: k.less_than_equal(5.0))


@case(_LINES + f"({_NULLABLE}) > 45")
def range_gt(t: Tables) -> DataFrame:
    return _range(t, lambda k: k.greater_than(45.0))


@case(_LINES + f"({_NULLABLE}) >= 45")
def range_ge(t: Tables) -> DataFrame:
    return _range(t, lambda k: k.greater_than_equal(45.0))


@case(_LINES + f"({_NULLABLE}) BETWEEN 10 AND 12")
def range_between(t: Tables) -> DataFrame:
    return _range(t, lambda k: k.between(10.0, 12.0))


@case(_LINES + f"NOT coalesce(({_NULLABLE}) BETWEEN 3 AND 48, FALSE)")
def range_not_between(t: Tables) -> DataFrame:
    return _range(t, lambda k: ~k.between(3.0, 48.0))


@case(_LINES + f"({_NULLABLE}) < NULL")
def range_null_bound(t: Tables) -> DataFrame:
    return _range(t, lambda k: k.less_than(None))


@case(_LINES + "l_extendedprice >= 20000 AND l_extendedprice < 30000 AND l_discount <> 0.05")
def range_bitsliced_double(t: Tables) -> DataFrame:
    price, off = K.NumberKey("price", "l_extendedprice"), K.NumberKey("discount", "l_discount")
    c = price.greater_than_equal(20000.0) & price.less_than(30000.0) & off.not_(0.05)
    return Collection(t.lineitem, "l_orderkey").query(c).df().select("l_orderkey", "l_linenumber")


@case(_LINES + "l_partkey = 7 OR l_suppkey IN (1, 2)")
def range_binary_equality(t: Tables) -> DataFrame:
    part, supplier = K.ExactKey("part", "l_partkey"), K.ExactKey("supplier", "l_suppkey")
    return Collection(t.lineitem, "l_orderkey").query(part.is_(7) | supplier.in_(1, 2)).df().select("l_orderkey", "l_linenumber")


@case("SELECT o_orderkey FROM orders WHERE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) >= 4")
def range_custom_order(t: Tables) -> DataFrame:
    urgency = K.OrderedKey("urgency", "o_orderpriority", lambda c: F.substring(c, 1, 1).cast("int"))
    return Collection(t.orders, "o_orderkey").query(urgency.greater_than_equal("4-NOT SPECIFIED")).df().select("o_orderkey")


# --- strings ---

_PARTS = "SELECT p_partkey FROM part WHERE "


def _parts(t: Tables, condition) -> DataFrame:
    return Collection(t.part, "p_partkey").query(condition(K.TextKey("type", "p_type"))).df().select("p_partkey")


@case(_PARTS + "contains(p_type, 'AN')")
def str_contains(t: Tables) -> DataFrame:
    return _parts(t, lambda k: k.contains("AN"))


@case(_PARTS + "contains(lower(p_type), 'an')")
def str_contains_ci(t: Tables) -> DataFrame:
    return _parts(t, lambda k: k.contains_ignore_case("aN"))


@case(_PARTS + "starts_with(p_type, 'S')")
def str_prefix(t: Tables) -> DataFrame:
    return _parts(t, lambda k: k.starts_with("S"))


@case(_PARTS + "starts_with(lower(p_type), 's')")
def str_prefix_ci(t: Tables) -> DataFrame:
    return _parts(t, lambda k: k.starts_with_ignore_case("s"))


@case(_PARTS + "suffix(p_type, 'D')")
def str_suffix(t: Tables) -> DataFrame:
    return _parts(t, lambda k: k.ends_with("D"))


@case(_PARTS + "suffix(lower(p_type), 'd')")
def str_suffix_ci(t: Tables) -> DataFrame:
    return _parts(t, lambda k: k.ends_with_ignore_case("D"))


@case(_PARTS + "NOT contains(p_type, 'A')")
def str_not_contains(t: Tables) -> DataFrame:
    return _parts(t, lambda k: ~k.contains("A"))


_GAPS = "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' WHEN p_partkey % 5 = 2 THEN '  ' ELSE p_name END"


@case(_PARTS + f"({_GAPS}) IS NULL OR ({_GAPS}) = ''")
def str_empty(t: Tables) -> DataFrame:
    return Collection(t.part, "p_partkey").query(K.TextKey("gaps", _GAPS).is_empty()).df().select("p_partkey")


@case(_PARTS + f"({_GAPS}) IS NULL OR trim(({_GAPS})) = ''")
def str_blank(t: Tables) -> DataFrame:
    return Collection(t.part, "p_partkey").query(K.TextKey("gaps", _GAPS).is_blank()).df().select("p_partkey")


@case(_PARTS + "p_type < 'M' AND p_brand BETWEEN 'Brand#2' AND 'Brand#4'")
def str_range(t: Tables) -> DataFrame:
    kind, brand = K.TextKey("type", "p_type"), K.TextKey("brand", "p_brand")
    return Collection(t.part, "p_partkey").query(kind.less_than("M") & brand.between("Brand#2", "Brand#4")).df().select("p_partkey")


@case("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{4}')")
def str_predicate(t: Tables) -> DataFrame:
    return Collection(t.documents, "doc_id").query(K.TextKey("text").matches(lambda c: c.rlike("[0-9]{4}"))).df().select("doc_id")
