"""The stages of the corpus pipeline, each by one of the operators.

A stage reads its predecessor's written result, so what earlier stages wrote on the way is dropped when it starts: the
pipeline needs the disk of its largest stage, not of all. Tables that ``docs`` itself is read from stay, and so do those that
operators wrote outside the stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fieldhush.sources.scratch import drop_scratch, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = drop_scratch(_left, docs)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        _left.extend(paths)
        return out

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject. Labels come from the ``labels`` table."""
    from fieldhush.llm.toxicity import without_toxic

    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    from fieldhush.llm.exact_dedup import exact_dedup

    return exact_dedup(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    from fieldhush.llm.jaccard import near_dedup

    return near_dedup(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a row per copy."""
    from fieldhush.llm.mixing import mixed_documents

    return mixed_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents placed in sequences of at most 2048 tokens. The last stage: a row per piece."""
    from fieldhush.llm.packing import packed_documents

    return packed_documents(docs, slice_bytes=1 << 20)  # executors still have the memory of the stages before
