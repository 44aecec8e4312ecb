"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Every stage's result is written to the shared folder and read back, so
a lost executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailweave.llm import exact_dedup, mixing, near_dedup, packing, quality
from trailweave.llm.common import materialise, table

STAGES = [
    ("quality", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The trained scores and the verified near duplicates aren't for SQL; tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
