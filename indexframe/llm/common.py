"""Session helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="ship")
    archive = os.path.join(folder, f"{package.name}_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset on a local master (tests), a new one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = f"file://{tempfile.mkdtemp(prefix='checkpoint')}"
            context.setCheckpointDir(found)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by_hash(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``written``, but dealt into hash buckets of a key, so that a join on it that has as many partitions doesn't move the table."""
    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{unique}").bucketBy(min(buckets, 100_000), key).sortBy(key).saveAsTable(unique)
    found = spark.table(unique)
    found.schema  # resolved, so the catalog needn't know the table any longer; its files stay
    spark.sql(f"DROP TABLE {unique}")
    return found


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over Arrow batches that gives the memory it freed back to the system at its end.

    Python workers are used again and share an executor's memory with its JVM; allocators keep what was freed for themselves.
    """

    @wraps(run)
    def tidied(*args, **named) -> Iterator:
        try:
            yield from run(*args, **named)
        finally:
            trim()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def no_null_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
