"""Refinement of records as they arrive: the work of a record needs no other one, so that it runs on a stream as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kinfold.jobs.calling import Options, refine_vcf

VCF = "chrom string, pos int, id string, ref string, alt string, qual double, filter string, info string, format string, samples array<string>"


def refine_stream(records: DataFrame, sample_names: list[str], people: list[tuple], o: Options = Options()) -> DataFrame:
    """A streaming DataFrame of records becomes one of refined records; no state, no watermark."""
    return refine_vcf(records, sample_names, people, o)


def refine_folder(spark: SparkSession, source: str, target: str, checkpoint: str, sample_names: list[str], people: list[tuple], o: Options = Options()) -> StreamingQuery:
    """Refines the Parquet files that arrive in a folder, until no more are there."""
    records = spark.readStream.schema(VCF).parquet(source)
    return refine_stream(records, sample_names, people, o).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
