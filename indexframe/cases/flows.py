"""Query execution (H), stream-style operators (I), traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import flow
from ..operators.collection import Collection
from ..plans import keys as K
from ..plans.query import Query
from .registry import Tables, case, orders, rounded

def _n() -> Column:
    return F.count(F.lit(1)).alias("n")


@case("SELECT * FROM region")
def scan_all(t: Tables) -> DataFrame:
    return Collection(t.region, "r_regionkey").scan()


@case("SELECT n_nationkey AS _id, n_name FROM nation")
def scan_with_id(t: Tables) -> DataFrame:
    return Collection(t.nation, "n_nationkey").scan().select(F.col("n_nationkey").alias("_id"), "n_name")


@case("SELECT * FROM supplier WHERE s_suppkey = 5")
def get_by_id(t: Tables) -> DataFrame:
    return Collection(t.supplier, "s_suppkey").at(5)


@case("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def id_range_exclusive(t: Tables) -> DataFrame:
    return orders(t).query().id_range(100, 200).df().select("o_orderkey", "o_orderstatus")


@case("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50 OFFSET 25")
def page_offset_limit(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status").is_("O")).page(25, 50).select("o_orderkey")


@case("SELECT DISTINCT o_orderstatus, o_orderpriority FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 10)")
def to_set_limit(t: Tables) -> DataFrame:
    o = Collection(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    return o.query().distinct_page(10, 40)


@case("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1")
def find_first(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status").is_("P")).first().select("o_orderkey", "o_custkey")


@case("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_totalprice < 1000")
def query_count(t: Tables) -> DataFrame:
    o = orders(t)
    return o.query(o.key("status").is_("F")).or_(o.key("price").less_than(1000.0)).df().agg(_n())


@case("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus = 'P'")
def query_execute(t: Tables) -> DataFrame:
    """A consumer that runs on the executors and adds up what it gets."""
    o, count, keys = orders(t), t.spark.sparkContext.accumulator(0), t.spark.sparkContext.accumulator(0)

    def consume(rows):
        for row in rows:
            count.add(1)
            keys.add(row["o_orderkey"])

    o.query(o.key("status").is_("P")).execute(consume)
    return t.spark.createDataFrame([(count.value, keys.value)], "n long, keys long")


@case("SELECT DISTINCT p_brand AS key FROM part")
def distinct_keys(t: Tables) -> DataFrame:
    return Collection(t.part, "p_partkey").with_keys(K.Key("p_brand")).distinct_keys("p_brand")


@case("SELECT p_brand AS key, p_partkey FROM part")
def key_entity_pairs(t: Tables) -> DataFrame:
    return Collection(t.part, "p_partkey").with_keys(K.Key("p_brand")).key_entity_pairs("p_brand")


@case("SELECT p_brand AS key, count(*) AS entries FROM part GROUP BY p_brand")
def index_statistics(t: Tables) -> DataFrame:
    return Collection(t.part, "p_partkey").with_keys(K.Key("p_brand")).statistics("p_brand")


@case("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderpriority = '1-URGENT'")
def subquery_and(t: Tables) -> DataFrame:
    o = orders(t)
    inner = Query(o, o.key("price").greater_than(200000.0))
    return o.query(o.key("status").is_("F")).and_(inner).and_(o.query(o.key("priority").is_("1-URGENT"))).df().select("o_orderkey")


@case("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 5, 77, 1000) AND o_orderkey >= 5")
def subquery_ids(t: Tables) -> DataFrame:
    return orders(t).query().and_([1, 5, 77, 1000]).id_start(5).df().select("o_orderkey")


@case("""SELECT CAST(floor((o_orderkey - lo) / w) AS INTEGER) AS slice, count(*) AS n FROM orders,
(SELECT min(o_orderkey) AS lo, greatest(1, ceil((max(o_orderkey) - min(o_orderkey) + 1) / 8.0)) AS w FROM orders) GROUP BY 1""")
def sliced_execute(t: Tables) -> DataFrame:
    return orders(t).query().sliced(8, _n())


@case("SELECT o_orderkey, upper(o_orderstatus) || '!' AS label FROM orders WHERE o_orderkey < 100")
def resolve_entities(t: Tables) -> DataFrame:
    def resolver(batches):
        for b in batches:
            yield b[["o_orderkey"]].assign(label=b["o_orderstatus"].str.upper() + "!")

    return orders(t).query().id_bound(100).resolve(resolver, "o_orderkey long, label string")


# --- streams ---


@case("SELECT p_partkey FROM part WHERE p_size < 30 AND p_retailprice > 950")
def flow_filter(t: Tables) -> DataFrame:
    return t.part.where((F.col("p_size") < 30) & (F.col("p_retailprice") > 950)).select("p_partkey")


@case("SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer")
def flow_map(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("label"))


@case("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flow_flat_map(t: Tables) -> DataFrame:
    return flow.flat_map(t.part, F.split("p_name", " "), "word").select("p_partkey", "word")


@case("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def flow_distinct(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey", "c_mktsegment").distinct()


@case("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 5")
def flow_sorted_page(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_size").orderBy(F.desc("p_size"), "p_partkey").offset(5).limit(20)


@case("""SELECT l_returnflag, l_linestatus, count(l_quantity) AS count, CAST(sum(l_quantity) AS BIGINT) AS total, CAST(min(l_quantity) AS DOUBLE) AS least,
round(avg(l_quantity), 4) AS average, CAST(max(l_quantity) AS DOUBLE) AS most FROM lineitem GROUP BY 1, 2""")
def flow_summary(t: Tables) -> DataFrame:
    s = flow.summary(t.lineitem, F.col("l_quantity"), ["l_returnflag", "l_linestatus"])
    return s.select("l_returnflag", "l_linestatus", "count", F.col("sum").cast("long").alias("total"), F.col("min").alias("least"), F.round("average", 4).alias("average"), F.col("max").alias("most"))


@case("""SELECT c_mktsegment, arg_min(c_custkey, row(c_acctbal, c_custkey)) AS poorest, arg_max(c_custkey, row(c_acctbal, c_custkey)) AS richest FROM customer GROUP BY 1""")
def flow_min_max_by(t: Tables) -> DataFrame:
    order = [F.col("c_acctbal"), F.col("c_custkey")]
    key = F.col("c_custkey")
    return t.customer.groupBy("c_mktsegment").agg(flow.first_by(key, order).alias("poorest"), flow.first_by(key, order, last=True).alias("richest"))


@case("SELECT c_nationkey, CAST(list_reduce(list(c_custkey % 97 ORDER BY c_custkey), lambda a, x: (a * 31 + x) % 1000003, 0) AS BIGINT) AS code FROM customer GROUP BY 1")
def flow_reduce(t: Tables) -> DataFrame:
    folded = flow.reduce(F.col("c_custkey") % 97, F.col("c_custkey"), F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 1000003)
    return t.customer.groupBy("c_nationkey").agg(folded.alias("code"))


@case("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY 1")
def flow_grouping(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(_n(), rounded(F.avg("o_totalprice")).alias("mean"), rounded(F.sum("o_totalprice"), 0).alias("total"))


@case("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def flow_group_composite(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(_n())


@case("SELECT p AS partition, (SELECT count(*) FROM orders WHERE (o_totalprice > 150000) = p) AS count FROM (VALUES (TRUE), (FALSE)) v(p)")
def flow_partitioning(t: Tables) -> DataFrame:
    return flow.partitioning_by(t.orders, F.col("o_totalprice") > 150000, F.count(F.lit(1)).alias("count"))


@case("""SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def flow_top_n(t: Tables) -> DataFrame:
    top = flow.top_n_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", "rank")


@case("""SELECT DISTINCT r_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_totalprice > 250000""")
def flow_join_reference(t: Tables) -> DataFrame:
    rich = t.orders.where("o_totalprice > 250000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    named = rich.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_name", "n_name").distinct()


@case("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def flow_exists(t: Tables) -> DataFrame:
    return flow.exists_in(t.customer, t.orders.where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@case("SELECT bool_or(o_totalprice > 400000) AS any_match FROM orders")
def flow_any_match(t: Tables) -> DataFrame:
    return flow.any_match(t.orders, F.col("o_totalprice") > 400000)


@case("SELECT p AS partition, (SELECT count(*) FROM orders WHERE (o_totalprice > 1e12) = p) AS count FROM (VALUES (TRUE), (FALSE)) v(p)")
def flow_partitioning_empty_side(t: Tables) -> DataFrame:
    return flow.partitioning_by(t.orders, F.col("o_totalprice") > 1e12, F.count(F.lit(1)).alias("count"))


@case("SELECT 'positive' AS test, bool_and(o_totalprice > 0) AS all_match FROM orders UNION ALL SELECT 'dear', bool_and(o_totalprice > 50000) FROM orders")
def flow_all_match(t: Tables) -> DataFrame:
    tests = {"positive": F.col("o_totalprice") > 0, "dear": F.col("o_totalprice") > 50000}
    first, second = (flow.all_match(t.orders, c).select(F.lit(n).alias("test"), "all_match") for n, c in tests.items())
    return flow.concat(first, second)


@case("SELECT coalesce(bool_and(o_totalprice > 0), TRUE) AS all_match FROM orders WHERE o_orderkey < 0")
def flow_all_match_of_none(t: Tables) -> DataFrame:
    return flow.all_match(t.orders.where("o_orderkey < 0"), F.col("o_totalprice") > 0)


@case("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def flow_none_match(t: Tables) -> DataFrame:
    return flow.none_in(t.customer, t.orders.where("o_orderstatus <> 'F'"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@case("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def flow_joining(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(flow.joining(F.col("n_name"), F.col("n_nationkey"), ", ").alias("names"))


@case("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def flow_concat(t: Tables) -> DataFrame:
    return flow.concat(t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@case("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def flow_to_map(t: Tables) -> DataFrame:
    maps = t.nation.groupBy("n_regionkey").agg(flow.to_map(F.col("n_nationkey"), F.col("n_name")).alias("m"))
    return maps.select("n_regionkey", F.explode("m").alias("n_nationkey", "n_name"))


@case("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS priorities FROM orders GROUP BY 1")
def flow_collect_set(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@case("SELECT o_orderkey, o_orderdate < TIMESTAMP '1995-01-01' AS early FROM orders WHERE o_orderdate <= TIMESTAMP '1995-03-15' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def flow_floor_entry(t: Tables) -> DataFrame:
    key = F.struct("o_orderdate", "o_orderkey")
    found = flow.floor_entry(t.orders, key, F.struct(F.lit("1995-03-15").cast("timestamp_ntz"), F.lit((1 << 63) - 1)))
    return found.select("o_orderkey", (F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("early"))


_EDGES = """SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL
SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'orders:' || o_orderkey FROM orders"""


def edges(t: Tables) -> DataFrame:
    name = lambda table, key: F.concat(F.lit(f"{table}:"), F.col(key).cast("string"))
    parts = [
        t.nation.select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst")),
        t.customer.select(name("nation", "c_nationkey").alias("src"), name("customer", "c_custkey").alias("dst")),
        t.orders.select(name("customer", "o_custkey").alias("src"), name("orders", "o_orderkey").alias("dst")),
    ]
    return flow.concat(*parts)


@case(f"""WITH RECURSIVE e AS ({_EDGES}), r(node, steps) AS (SELECT 'region:1', 0 UNION ALL SELECT dst, steps + 1 FROM r JOIN e ON node = src)
SELECT node, CAST(min(steps) AS INTEGER) AS steps FROM r GROUP BY node""")
def flow_reachable(t: Tables) -> DataFrame:
    return flow.reachable(edges(t), t.spark.createDataFrame([("region:1",)], "node string"))


@case(f"""WITH RECURSIVE e AS ({_EDGES}), r(node) AS (SELECT 'region:0' UNION SELECT dst FROM r JOIN e ON node = src)
SELECT 'nation:' || n_nationkey AS node FROM nation WHERE 'nation:' || n_nationkey NOT IN (SELECT node FROM r)""")
def graph_orphans(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    return flow.orphans(edges(t), nodes, t.spark.createDataFrame([("region:0",)], "node string"))


@case("SELECT c_nationkey, o_orderkey, (SELECT arg_max(c2.c_custkey, row(c2.c_custkey)) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey AND c2.c_custkey <= o_orderkey) AS latest FROM orders JOIN customer c ON o_custkey = c.c_custkey")
def flow_floor_join(t: Tables) -> DataFrame:
    asks = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey")
    right = t.customer.select("c_nationkey", F.col("c_custkey").alias("at"), F.col("c_custkey").alias("latest"))
    return flow.floor_join(asks, right, "c_nationkey", "o_orderkey", "at", ["latest"]).select("c_nationkey", "o_orderkey", "latest")
