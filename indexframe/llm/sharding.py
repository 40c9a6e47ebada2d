"""Contiguous shards of nearly equal bytes, from a distributed prefix sum.

Rows are range-partitioned by their order key, each partition is summed, the few partition totals
are prefix-summed, and every row then knows how many bytes stand before it.  Shard ``k`` takes the
rows whose middle byte lies in the ``k``-th of the equal slices of all bytes, so that a shard is off
its target by half a row at each end.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, no_null_text, shuffle_width, table


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def byte_shards(rows: DataFrame, order: str, size: str, shards: int, *, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` (0 to ``shards - 1``, contiguous in ``order``) and ``slot`` (gapless from 0 in it).

    ``size`` holds positive integers.  Rows of equal order key stand side by side in any order (their
    numbers are then interchangeable); null order keys come first.  Fewer rows than shards leave
    shards empty; an empty table stays empty.  Other columns pass through.  The rows given are
    written to the checkpoint folder, so hand over narrow ones.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    width = shuffle_width(rows.sparkSession)
    part, before, first, at, start = (f"__{x}" for x in ("part", "before", "first", "at", "start"))
    # The written copy fixes which row is in which range: totals and rows can't disagree later.
    dealt = checkpoint(rows.repartitionByRange(width, order).withColumn(part, F.spark_partition_id()))
    totals = dealt.groupBy(part).agg(F.sum(size).alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        part,
        F.coalesce(F.sum("__bytes").over(ahead), F.lit(0)).alias(before),
        F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias(first),
        F.sum("__bytes").over(every).alias("__all"),
    )
    inside = Window.partitionBy(part).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        dealt.join(F.broadcast(bases), part)  # as many rows as there are partitions
        .withColumn(start, F.col(before) + F.sum(size).over(inside) - F.col(size))
        .withColumn(at, F.col(first) + F.count(F.lit(1)).over(inside) - 1)
        .withColumn(shard, F.expr(f"cast((2 * cast({start} as decimal(38,0)) + `{size}`) * {shards} div (2 * __all) as int)"))
    )
    heads = placed.groupBy(shard).agg(F.min(at).alias("__head"))
    return (
        placed.join(F.broadcast(heads), shard)  # as many rows as there are shards
        .withColumn(slot, F.col(at) - F.col("__head"))
        .drop(part, before, first, at, start, "__all", "__head")
    )


SHARDS = 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 contiguous shards of nearly equal bytes (law ``bytes``).

    Null texts have size 1 and the checksum of the empty text; equal texts count each for themselves.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id"), utf8_size(F.col("text")).alias("size"), F.crc32(no_null_text().cast("binary")).alias("text_crc32")
    )
    return byte_shards(docs, "doc_id", "size", SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The same rows in DuckDB: sums over all documents, and CRC-32 by its table of 256 remainders.
SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
), sized AS (
  SELECT doc_id, coalesce(text, '') AS body, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents
), placed AS (
  SELECT doc_id, body, size, CAST((2 * (sum(size) OVER (ORDER BY doc_id) - size) + size) * 8 // (2 * sum(size) OVER ()) AS INTEGER) AS shard FROM sized
)
SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, crc
"""
