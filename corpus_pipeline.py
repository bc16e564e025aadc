"""A corpus pipeline of training-data operators; each stage gets what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.common import staged
from skein.llm.exact_dedup import dedup_exact_stage
from skein.llm.mixing import mixing_stage
from skein.llm.near_dedup import near_dedup_stage
from skein.llm.packing import packing_stage
from skein.llm.quality import quality_stage

STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", dedup_exact_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier cannot be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
