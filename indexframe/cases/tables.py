"""Stored tables (A), mutation, constraints, caches and versions (L), event-time windows (extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import flow, retention, rollup
from ..operators.collection import Collection, Custom, Unique
from ..plans import keys as K
from ..sources import csv_convert
from ..sources import tables as saved
from ..sources.shared import shared_dir
from ..streaming import windows
from .registry import Tables, case


def _folder(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/saved-{uuid.uuid4().hex}"


_TYPED = "n_nationkey % 2 = 0 AS even, [n_name, CAST(n_regionkey AS VARCHAR)] AS tags"


@case("SELECT n_nationkey, n_name, n_nationkey % 2 = 0 AS even, n_name || '|' || n_regionkey AS tags FROM nation")
def csv_round_trip(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", "n_name", (F.col("n_nationkey") % 2 == 0).alias("even"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("tags"))
    folder = _folder(t)
    csv_convert.write_csv(rows, folder)
    back = csv_convert.read_csv(t.spark, folder, rows.schema)
    return back.select("n_nationkey", "n_name", "even", F.array_join("tags", "|").alias("tags"))


@case("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 't' ELSE 'f' END AS even, '[' || n_name || ',' || n_regionkey || ']' AS tags FROM nation")
def csv_dialect(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", (F.col("n_nationkey") % 2 == 0).alias("even"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("tags"))
    return csv_convert.to_strings(rows)


@case("SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 ORDER BY 1 LIMIT 2) GROUP BY 1")
def export_import_types(t: Tables) -> DataFrame:
    folder = _folder(t)
    saved.export_types(t.events, folder, "event_type")
    back = saved.import_types(t.spark, folder)
    wanted = [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return saved.load_by_type(back, "event_type", *wanted).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@case("SELECT * FROM customer WHERE c_custkey IN (1, 17, 33)")
def load_by_ids(t: Tables) -> DataFrame:
    return saved.load_by_ids(t.customer, "c_custkey", [1, 17, 33])


@case("SELECT s_suppkey, s_name AS supplier_name, CAST(s_acctbal AS DOUBLE) AS s_acctbal, CAST(NULL AS VARCHAR) AS note FROM supplier")
def schema_evolution(t: Tables) -> DataFrame:
    target = T.StructType().add("s_suppkey", "long").add("supplier_name", "string").add("S_AcctBal", "double").add("note", "string")
    return saved.evolve(t.supplier, target, {"supplier_name": "s_name", "note": None}).withColumnRenamed("S_AcctBal", "s_acctbal")


@case("SELECT count(*) AS rows, TRUE AS has_files, TRUE AS has_bytes FROM orders")
def file_statistics(t: Tables) -> DataFrame:
    files = saved.file_statistics(t.orders)
    return files.groupBy().agg(F.sum("rows").alias("rows"), (F.count(F.lit(1)) > 0).alias("has_files"), (F.min("file_size") > 0).alias("has_bytes"))


@case("SELECT 'nation' AS root, count(*) AS entries FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def root_listing(t: Tables) -> DataFrame:
    folder = _folder(t)
    for name, rows in (("nation", t.nation), ("region", t.region)):
        saved.save_root(rows, folder, name)
    return saved.roots({name: saved.load_root(t.spark, folder, name) for name in ("nation", "region")})


@case("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 3 AND 5""")
def viewer_nested_page(t: Tables) -> DataFrame:
    """A page of the elements of a list field, for every customer."""
    owners = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"))
    return saved.element_page(owners, "orders", 2, 3).select("o_custkey", F.explode("orders").alias("o_orderkey"))


@case("SELECT doc_id, substr(text, 6, 20) AS text, substr(lang, 6, 20) AS lang, substr(source, 6, 20) AS source, n_chars FROM documents WHERE doc_id = 7")
def viewer_members(t: Tables) -> DataFrame:
    return saved.members(t.documents, "doc_id", 7, 5, 20)


_REFS = """SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey FROM orders"""


def _references(t: Tables) -> DataFrame:
    return saved.adjacency({"customer": (t.customer, "c_custkey", {"c_nationkey": "nation"}), "orders": (t.orders, "o_orderkey", {"o_custkey": "customer"})})


@case(_REFS)
def adjacency_export(t: Tables) -> DataFrame:
    return _references(t)


@case(f"SELECT src, dst FROM ({_REFS}) WHERE dst NOT IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'nation:' || n_nationkey FROM nation)")
def missing_objects(t: Tables) -> DataFrame:
    name = lambda table, key: F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("node")
    nodes = t.customer.where("c_custkey % 10 <> 0").select(name("customer", "c_custkey")).unionByName(t.nation.select(name("nation", "n_nationkey")))
    return flow.dangling(_references(t), nodes)


# --- mutation ---


def _suppliers(t: Tables) -> Collection:
    return Collection(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey").with_keys(K.TextKey("name", "s_name"), K.NumberKey("balance", "s_acctbal"))


@case("""SELECT s_suppkey, s_name FROM supplier UNION ALL
SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name FROM customer WHERE c_custkey <= 20""")
def mut_add(t: Tables) -> DataFrame:
    new = t.customer.where("c_custkey <= 20").select("c_custkey", F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal"))
    return _suppliers(t).add(new, ["c_custkey"]).df.select("s_suppkey", "s_name")


@case("SELECT s_suppkey, CASE WHEN s_suppkey IN (2, 3) THEN 'new ' || s_suppkey ELSE s_name END AS s_name FROM supplier WHERE s_suppkey <> 4")
def mut_set(t: Tables) -> DataFrame:
    c = _suppliers(t)
    new = c.df.where("s_suppkey in (2, 3)").withColumn("s_name", F.concat(F.lit("new "), F.col("s_suppkey").cast("string")))
    return c.remove([3, 4]).set(new).df.select("s_suppkey", "s_name")


@case("SELECT s_suppkey, round(CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END, 2) AS s_acctbal FROM supplier")
def mut_update(t: Tables) -> DataFrame:
    c = _suppliers(t)
    return c.update(c.key("balance").less_than(0.0), {"s_acctbal": F.lit(0.0)}).df.select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))


@case("SELECT s_suppkey FROM supplier WHERE s_acctbal >= 1000")
def mut_remove(t: Tables) -> DataFrame:
    c = _suppliers(t)
    return c.remove(c.query(c.key("balance").less_than(1000.0)).ids()).df.select("s_suppkey")


@case("SELECT c_nationkey AS key, count(*) AS count FROM customer GROUP BY 1 HAVING count(*) > 1")
def constraint_unique(t: Tables) -> DataFrame:
    return Unique(K.Key("nation", "c_nationkey")).violations(t.customer)


@case("SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal >= 0 AND starts_with(s_name, 'Supplier'))")
def constraint_custom(t: Tables) -> DataFrame:
    c = _suppliers(t)
    return Custom("sound", c.key("balance").greater_than_equal(0.0) & c.key("name").starts_with("Supplier")).violations(c.df).select("s_suppkey")


# --- caches and versions ---

_USE = "SELECT user_id, max(ts) AS seen, count(*) AS hits, min(ts) AS made FROM events GROUP BY 1"


def _use(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("ts").alias("seen"), F.count(F.lit(1)).alias("hits"), F.min("ts").alias("made"))


@case(f"SELECT user_id FROM ({_USE}) ORDER BY seen DESC, user_id LIMIT 50")
def evict_lru(t: Tables) -> DataFrame:
    return retention.evict(_use(t), retention.LRU, 50, "user_id", accessed="seen").select("user_id")


@case(f"SELECT user_id FROM ({_USE}) ORDER BY hits DESC, user_id LIMIT 50")
def evict_lfu(t: Tables) -> DataFrame:
    return retention.evict(_use(t), retention.LFU, 50, "user_id", hits="hits").select("user_id")


@case(f"SELECT user_id FROM ({_USE}) ORDER BY made DESC, user_id LIMIT 50")
def evict_fifo(t: Tables) -> DataFrame:
    return retention.evict(_use(t), retention.FIFO, 50, "user_id", created="made").select("user_id")


@case("SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT 50")
def evict_biggest(t: Tables) -> DataFrame:
    return retention.evict(t.documents, retention.BIGGEST, 50, "doc_id", size="n_chars").select("doc_id")


@case("SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > (SELECT ts FROM events ORDER BY event_id LIMIT 1 OFFSET 800)")
def cache_expiry(t: Tables) -> DataFrame:
    now = t.events.orderBy("event_id").offset(800).head()["ts"]
    return retention.expired(t.events, F.expr("ts + interval 1 day"), now).select("event_id")


@case("""SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey <= 100 AND c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey <= 120 AND c_custkey % 2 = 0""")
def cache_put(t: Tables) -> DataFrame:
    old = t.customer.where("c_custkey <= 100").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = t.customer.where("c_custkey <= 120 and c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))
    return retention.put(old, new, "k")


_NEW = "SELECT c_custkey AS k, 'new' AS v FROM customer WHERE c_custkey % 3 = 0"
_OLD = "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0"


def _cache(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return old, t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v"))


@case(f"SELECT o.k, coalesce(n.v, o.v) AS v FROM ({_OLD}) o LEFT JOIN ({_NEW}) n USING (k)")
def cache_replace(t: Tables) -> DataFrame:
    return retention.replace_existing(*_cache(t), "k")


@case(f"SELECT * FROM ({_OLD}) UNION ALL SELECT * FROM ({_NEW}) WHERE k % 2 <> 0")
def cache_put_if_absent(t: Tables) -> DataFrame:
    return retention.put(*_cache(t), "k", only_absent=True)


@case(f"SELECT * FROM ({_OLD}) WHERE k IN (2, 3, 4, 88)")
def cache_get_all(t: Tables) -> DataFrame:
    return retention.get_all(_cache(t)[0], "k", [2, 3, 4, 88])


@case(f"SELECT * FROM ({_OLD}) WHERE k NOT IN (2, 3, 4, 88)")
def cache_remove(t: Tables) -> DataFrame:
    return retention.remove(_cache(t)[0], "k", [2, 3, 4, 88])


@case(f"SELECT k, CASE WHEN k IN (4, 6, 7) THEN upper(v) || '!' ELSE v END AS v FROM ({_OLD})")
def cache_invoke(t: Tables) -> DataFrame:
    return retention.invoke(_cache(t)[0], "k", [4, 6, 7], {"v": F.concat(F.upper("v"), F.lit("!"))})


@case("SELECT event_type, count(*) AS n, count(value) AS value_count, round(sum(value), 4) AS total, min(ts) AS first, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def rollup_incremental(t: Tables) -> DataFrame:
    """Aggregates of one part of the events, with the rest merged in as two deltas."""
    r = rollup.Rollup(("event_type",), sums=("value",), least=("ts",), most=("value",))
    parts = [t.events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in range(3)]
    state = r.merge(r.merge(r.build(parts[0]), r.build(parts[1])), r.build(parts[2]))
    return r.read(state).select("event_type", "n", "value_count", F.round("value_sum", 4).alias("total"), F.col("ts_min").alias("first"), F.col("value_max").alias("most"), F.round("value_avg", 6).alias("mean"))


@case("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS version FROM orders WHERE o_orderkey <= 5000 GROUP BY 1")
def version_asof(t: Tables) -> DataFrame:
    return retention.as_of(t.orders, ["o_custkey"], "o_orderkey", 5000).select("o_custkey", F.col("o_orderkey").alias("version"))


@case("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def bitmap_count(t: Tables) -> DataFrame:
    """Counts by bitmaps of ids: one bit an id, a bucket of 32,768 ids a bitmap."""
    rows = t.orders.where("o_orderkey % 2 = 0").groupBy("o_orderstatus", F.expr("bitmap_bucket_number(o_orderkey)").alias("b"))
    bitmaps = rows.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(o_orderkey))").alias("m"))
    return bitmaps.groupBy("o_orderstatus").agg(F.sum(F.expr("bitmap_count(m)")).alias("n"))


@case("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def extension_tumbling(t: Tables) -> DataFrame:
    found = windows.tumbling(t.events, "ts", "1 hour", ["event_type"], F.count(F.lit(1)).alias("n"))
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
