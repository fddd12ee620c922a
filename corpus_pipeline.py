"""The corpus pipeline: quality, near duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlake.llm.common import materialize
from marketlake.llm.mixing import stage_mix
from marketlake.llm.near_dedup import stage_near_dedup
from marketlake.llm.packing import stage_pack
from marketlake.llm.quality import stage_quality
from marketlake.llm.secret_scan import stage_redact

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("secrets", stage_redact),
    ("mixing", stage_mix),
    ("packing", stage_pack),
]

#: Hashing, boosted rules and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
