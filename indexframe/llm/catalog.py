"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bytebpe, chat, fingerprint, mixing, quality, sharding, simhash, tokenfile, toxicity
from .common import ship


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [toxicity.op1_toxicity, fingerprint.op2_fingerprint, simhash.op3_simhash, quality.op4_quality, sharding.op5_sharding, tokenfile.op6_token_file, ann.op7_ann, chat.op8_chat, mixing.op9_mixing, bytebpe.op10_bpe]
    return {q.__name__: _shipping(q) for q in own}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express."""
    return {"op5_sharding": sharding.SQL, "op8_chat": chat.sql()}
