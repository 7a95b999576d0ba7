"""A corpus from raw documents, in stages: each reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import stages
from inkveil.llm.common import shared_dir, table

STAGES = [
    ("quality_classifier", stages.select_quality),
    ("ngram_join", stages.drop_near_copies),
    ("pii", stages.mask_personal_data),
    ("mixing", stages.mix_sources),
    ("pieces", stages.encode_pieces),
]

#: The classifier's hashes, the links and the masks have no SQL form that ends in time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
