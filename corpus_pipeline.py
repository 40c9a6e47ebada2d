"""From raw documents to token ids, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last return the columns of
``documents``.  Texts that are null count as empty in every stage; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from indexframe.llm import bytebpe, mixing, quality, simhash, toxicity
from indexframe.llm.common import ship, table, written


def _stage(function):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", _stage(quality.stage_quality)),
    ("toxicity", _stage(toxicity.stage_toxicity)),
    ("near_duplicates", _stage(simhash.stage_simhash)),
    ("mixing", _stage(mixing.stage_mixing)),
    ("byte_bpe", _stage(bytebpe.stage_bpe)),
]

#: Trained models, hashes and merges can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = written(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
