"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())


def _hang_on_least(neighbours: DataFrame, keep: str) -> DataFrame:
    """Each neighbour v of u (those that ``keep`` holds for) hangs on the least of u and its neighbours."""
    least = neighbours.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("c", "m"))
    return neighbours.where(keep).join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def connected(links: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """``links`` (u, v) long -> (node, root): every linked node but the roots with the least node that it reaches.

    Works in about log(longest path) rounds, each cut off by a checkpoint; links of one node may be
    any share of all (joins on it are split, sums are combined before they move).  With ``rows_a_task`` small tables
    are read by fewer tasks than they have partitions.
    """

    def read(table: DataFrame, most: int) -> DataFrame:
        return table if rows_a_task is None else table.coalesce(1 + most // rows_a_task)

    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    edges = read(edges, before[0])
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = read(checkpoint(_hang_on_least(both, "v > u").distinct()), before[0])
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        moved = large.join(least, F.col("u") == F.col("c"))
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        edges = read(checkpoint(small.distinct()), 2 * before[0])
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
