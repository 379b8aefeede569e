"""The corpus pipeline: documents that are toxic, equal or nearly equal go, sources are mixed, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and reads its predecessor's written result. All but the last return the columns
of ``documents``, so a stage can be left out or run alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldhush.llm import stages
from fieldhush.sources.scratch import materialize

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("exact_dedup", stages.drop_copies),
    ("near_dedup", stages.drop_near_copies),
    ("source_mix", stages.mix_sources),
    ("packing", stages.pack),
]

#: A learned score and random copies decide rows, which SQL cannot state; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
