"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import decontam, langid, mixing, simhash, suffixdedup
from quarrystone.llm.common import checkpoint_dir, delete, temporary

STAGES = [
    ("language ID", langid.stage),
    ("SimHash near-dedup", simhash.stage),
    ("suffix-array dedup", suffixdedup.stage),
    ("benchmark decontamination", decontam.stage),
    ("mixing", mixing.stage),
]

#: SQL cannot express the trained and iterative stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared folder and is deleted when the next stage is written.

    The last stage's rows stay there, as the result reads them.
    """
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return docs
