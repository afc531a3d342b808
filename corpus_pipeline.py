"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; what it
returns is written as Parquet and read again as the next one's docs.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubespark.llm import stages
from cubespark.llm.blocks import shared_folder

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("simhash_near_dedup", stages.drop_similar),
    ("substring_dedup", stages.cut_passages),
    ("best_fit_packing", stages.pack_sequences),
]

#: SQL has no quality model, no components of links and no packing: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder and read again."""
    docs = stages.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
