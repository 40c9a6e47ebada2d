"""Aggregates that are kept up to date: a table of partial results to which those of new rows are merged.

A merge reads the kept table and the new rows, never the old rows.  Counts, sums, least and greatest values merge; averages are
read off them.  Removed rows can be taken off counts and sums, not off extremes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rollup:
    """``keys``: what to group by (null is a key).  Kept: n, and ``x_count`` and ``x_sum``, ``x_min``, ``x_max`` of the columns named."""

    keys: tuple[str, ...]
    sums: tuple[str, ...] = ()
    least: tuple[str, ...] = ()
    most: tuple[str, ...] = ()

    def build(self, rows: DataFrame) -> DataFrame:
        made = [F.count(F.lit(1)).alias("n")]
        made += [x for c in self.sums for x in (F.count(c).alias(f"{c}_count"), F.sum(c).alias(f"{c}_sum"))]
        made += [F.min(c).alias(f"{c}_min") for c in self.least] + [F.max(c).alias(f"{c}_max") for c in self.most]
        return rows.groupBy(*self.keys).agg(*made)

    def _merged(self) -> list:
        made = [F.sum("n").alias("n")]
        made += [F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in self.sums for k in ("count", "sum")]
        return made + [F.min(f"{c}_min").alias(f"{c}_min") for c in self.least] + [F.max(f"{c}_max").alias(f"{c}_max") for c in self.most]

    def merge(self, kept: DataFrame, delta: DataFrame) -> DataFrame:
        """Both are tables as ``build`` makes them; one row a key moves, whatever the rows behind it."""
        return kept.unionByName(delta).groupBy(*self.keys).agg(*self._merged())

    def without(self, kept: DataFrame, removed: DataFrame) -> DataFrame:
        """Takes rows off; keys without rows go."""
        if self.least or self.most:
            raise ValueError("extremes can't be taken back")
        minus = removed.select(*self.keys, *[(-F.col(c)).alias(c) for c in removed.columns if c not in self.keys])
        return self.merge(kept, minus).where("n > 0")

    def read(self, kept: DataFrame) -> DataFrame:
        """With the averages of the sums."""
        return kept.select("*", *[(F.col(f"{c}_sum") / F.when(F.col(f"{c}_count") > 0, F.col(f"{c}_count"))).alias(f"{c}_avg") for c in self.sums])
