"""A corpus pipeline out of the text operators. Each stage is (name, function of (spark, docs, sf_dir))."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import pipeline

STAGES = pipeline.STAGES
#: The toxicity score and the token ids are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents, each result written as Parquet in the shared folder and read again."""
    return pipeline.run(spark, sf_dir, STAGES)
