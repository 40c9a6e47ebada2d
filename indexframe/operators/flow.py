"""What follows a filter: grouping, ranking, matching, joining by reference and traversal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat_map(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """A row an item of an array; rows with an empty or null array give none."""
    return rows.withColumn(name, F.explode(items))


def top_n_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; ``order`` should be total."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def partitioning_by(rows: DataFrame, test: Column, *aggregates: Column) -> DataFrame:
    """Aggregates of the rows that satisfy a test and of those that don't; both groups are always there."""
    both = rows.sparkSession.createDataFrame([(True,), (False,)], "partition boolean")
    found = rows.groupBy(F.coalesce(test, F.lit(False)).alias("__p")).agg(*aggregates)
    joined = both.join(found, F.col("partition") == F.col("__p"), "left").drop("__p")
    counts = [c for c in found.columns if c.startswith("count")]
    return joined.fillna(0, counts) if counts else joined


def summary(rows: DataFrame, value: Column, group: Sequence[str] = ()) -> DataFrame:
    """Count, sum, minimum, average and maximum."""
    made = [F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.avg(value).alias("average"), F.max(value).alias("max")]
    return rows.groupBy(*group).agg(*made)


def any_match(rows: DataFrame, test: Column) -> DataFrame:
    """One boolean; false for no rows."""
    return rows.agg(F.coalesce(F.bool_or(F.coalesce(test, F.lit(False))), F.lit(False)).alias("any_match"))


def all_match(rows: DataFrame, test: Column) -> DataFrame:
    """One boolean; true for no rows."""
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(True)).alias("all_match"))


def none_match(rows: DataFrame, test: Column) -> DataFrame:
    return any_match(rows, test).select((~F.col("any_match")).alias("none_match"))


def exists_in(rows: DataFrame, others: DataFrame, on: Column) -> DataFrame:
    """Rows that some other row belongs to."""
    return rows.join(others, on, "left_semi")


def none_in(rows: DataFrame, others: DataFrame, on: Column) -> DataFrame:
    return rows.join(others, on, "left_anti")


def joining(value: Column, order: Column, separator: str = ",") -> Column:
    """Aggregate: strings joined in order; nulls are left out."""
    pairs = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("k"), value.cast("string").alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), separator)


def reduce(value: Column, order: Column, start: Column, merge) -> Column:
    """Aggregate: a fold in order.  Holds a group's values in one row; prefer a built-in aggregate where there is one."""
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("k"), value.alias("v"))))
    return F.aggregate(pairs, start, lambda acc, p: merge(acc, p["v"]))


def to_map(key: Column, value: Column) -> Column:
    """Aggregate: a map; a repeated key is an error."""
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def first_by(value: Column, order: Sequence[Column], *, last: bool = False) -> Column:
    """Aggregate: the value of the least (or, ``last``, greatest) row by a total order."""
    return (F.max_by if last else F.min_by)(value, F.struct(*order))


def concat(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def floor_entry(rows: DataFrame, key: Column, point) -> DataFrame:
    """The row of the greatest key at or before a point."""
    return rows.where(key <= point).orderBy(key.desc()).limit(1)


def floor_join(left: DataFrame, right: DataFrame, by: str, at: str, key: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the right row of equal ``by`` whose ``key`` is greatest at or before ``at``.

    Both sides are laid on one timeline, which is dealt out in ranges of ``by`` and time, so one ``by`` may have any share of the rows;
    in a range the last right row seen is carried on, and what a range begins with comes from the ranges before it: one row a
    range.  No pair of rows is made.  Null where there is none; null ``by`` are equal.  Writes a checkpoint, which fixes the ranges.
    """
    from ..sources.shared import checkpoint

    carried = F.struct(F.col(key), *values)
    events = right.select(F.col(by).alias("__by"), F.col(key).alias("__at"), F.lit(0).alias("__side"), carried.alias("__row"), F.lit(None).cast(left.schema).alias("__left"))
    asks = left.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(events.schema["__row"].dataType).alias("__row"), F.struct(*left.columns).alias("__left"))
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(events.unionByName(asks).repartitionByRange(width, "__by", "__at", "__side").withColumn("__part", F.spark_partition_id()))
    latest = F.max_by(F.when(F.col("__side") == 0, F.struct("__by", "__row")), F.when(F.col("__side") == 0, F.struct("__by", "__at")))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = dealt.groupBy(F.col("__part").alias("__p")).agg(latest.alias("__top")).withColumn("__part", F.col("__p"))
    starts = starts.select(F.col("__p"), F.last("__top", ignorenulls=True).over(before).alias("__begin"))
    timeline = Window.partitionBy("__part", "__by").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("__own", F.last("__row", ignorenulls=True).over(timeline)).where("__side = 1")
    seen = seen.join(F.broadcast(starts), F.col("__part") == F.col("__p"), "left")
    last = F.coalesce("__own", F.when(F.col("__begin.__by").eqNullSafe(F.col("__by")), F.col("__begin.__row")))
    return seen.withColumn("__last", last).select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def numbered(rows: DataFrame, name: str, order: Sequence[Column | str], start: int = 0) -> DataFrame:
    """Adds gapless numbers from ``start`` in a total order.

    Rows are dealt into ranges of the order and numbered in each, from the sum of the sizes before it: no task gets all
    rows.  Writes a checkpoint, which fixes the ranges.
    """
    from ..sources.shared import checkpoint

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(rows.repartitionByRange(width, *order).withColumn("__part", F.spark_partition_id()))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = dealt.groupBy(F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    bases = sizes.select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = dealt.withColumn("__at", inside).join(F.broadcast(bases), F.col("__part") == F.col("__p"))
    return placed.withColumn(name, (F.col("__base") + F.col("__at") + F.lit(start - 1)).cast("long")).drop("__part", "__p", "__base", "__at")


def reachable(edges: DataFrame, roots: DataFrame, source: str = "src", target: str = "dst", most: int = 100) -> DataFrame:
    """Nodes reached from the roots (one column) along edges, with the least number of steps; roots have 0.

    Breadth first: a join a step, nodes seen before are left out, so cycles end.  Lineage is cut by checkpoints.
    """
    from ..sources.shared import checkpoint

    edges = edges.select(F.col(source).alias("__s"), F.col(target).alias("__t"))
    front = checkpoint(roots.select(F.col(roots.columns[0]).alias("node")).distinct().withColumn("steps", F.lit(0)))
    seen = front
    for step in range(1, most + 1):
        reached = front.join(edges, F.col("node") == F.col("__s")).select(F.col("__t").alias("node")).distinct()
        front = checkpoint(reached.join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(step)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)  # every front is a table of its own
    raise RecursionError(f"more than {most} steps")


def dangling(edges: DataFrame, nodes: DataFrame, target: str = "dst") -> DataFrame:
    """Edges whose target is no node (one column)."""
    known = nodes.select(F.col(nodes.columns[0]).alias("__n"))
    return edges.join(known, F.col(target) == F.col("__n"), "left_anti")


def orphans(edges: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that no root reaches."""
    return nodes.join(reachable(edges, roots).select(F.col("node").alias("__n")), F.col(nodes.columns[0]) == F.col("__n"), "left_anti")
