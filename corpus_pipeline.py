"""The training-data pipeline over ``documents``: each stage's rows are written as
Parquet and read again as the next stage's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.base import cut, table
from graphloom.llm.decontaminate import decontamination_stage
from graphloom.llm.mixing import mixing_stage
from graphloom.llm.quality import quality_stage
from graphloom.llm.sharding import shard_stage
from graphloom.llm.simhash import near_dedup_stage

STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", shard_stage),
]

#: Fingerprints, knapsack and permutation are beyond SQL; tests/llm compares the
#: stages with brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
