"""Caches and versions as tables: upserts, expiry, eviction and as-of reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LRU, LFU, FIFO, BIGGEST = "LRU", "LFU", "FIFO", "BIGGEST"


def put(entries: DataFrame, new: DataFrame, key: str, *, only_absent: bool = False) -> DataFrame:
    """Entries after putting new ones (of the same columns); ``only_absent`` keeps those that exist."""
    keep, add = (entries, new.join(entries.select(key), key, "left_anti")) if only_absent else (entries.join(new.select(key), key, "left_anti"), new)
    return keep.select(*entries.columns).unionByName(add.select(*entries.columns))


def get_all(entries: DataFrame, key: str, keys: Sequence) -> DataFrame:
    return entries.where(F.col(key).isin(list(keys)))


def replace_existing(entries: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries with new values where the key exists already."""
    return put(entries, new.join(entries.select(key), key, "left_semi"), key)


def remove(entries: DataFrame, key: str, keys: Sequence) -> DataFrame:
    return entries.where(~F.col(key).isin(list(keys)))


def invoke(entries: DataFrame, key: str, keys: Sequence, changes: Mapping[str, Column]) -> DataFrame:
    """An entry processor: new column values for some keys."""
    hit = F.col(key).isin(list(keys))
    return entries.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in entries.columns])


def expired(entries: DataFrame, expires: Column, now) -> DataFrame:
    """Entries without those that have expired; a null expiry never comes."""
    return entries.where(expires.isNull() | (expires > F.lit(now)))


def evict(entries: DataFrame, policy: str, keep: int, key: str, *, accessed: str = "", hits: str = "", created: str = "", size: str = "") -> DataFrame:
    """The ``keep`` entries that a policy keeps: lately used, often used, young, or small ones; ties by key."""
    first = {LRU: lambda: F.col(accessed).desc(), LFU: lambda: F.col(hits).desc(), FIFO: lambda: F.col(created).desc(), BIGGEST: lambda: F.col(size).asc()}
    if policy not in first:
        raise ValueError(f"unknown policy {policy}")
    return entries.orderBy(first[policy](), key).limit(keep)


def as_of(versions: DataFrame, key: Sequence[str], version: str, at) -> DataFrame:
    """Of each key the row of the greatest version at or before ``at``."""
    window = Window.partitionBy(*key).orderBy(F.col(version).desc())
    return versions.where(F.col(version) <= F.lit(at)).withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
