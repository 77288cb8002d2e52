"""The corpus pipeline: five stages over ``documents``, each written and read again.

quality rules -> near duplicates -> benchmark decontamination -> mixing -> token ids.
"""
from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqloom.llm import op1_decontam, op3_mixing, op4_quality, op5_neardup, op10_tokenids  # noqa: E402
from seqloom.llm.common import scratch_dir  # noqa: E402

STAGES = [
    ("quality", op4_quality.stage),
    ("near_duplicates", op5_neardup.stage),
    ("decontamination", op1_decontam.stage),
    ("mixing", op3_mixing.stage),
    ("token_ids", op10_tokenids.stage),
]

#: BagMinHash, CGK and byte-pair encoding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
