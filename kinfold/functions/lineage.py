"""Tables in the shared folder that cut the lineage of jobs in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; where it is unset, one of our own on a single machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")
        sc.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/round-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table written once and read back: a lost executor costs its own tasks, not the rounds before."""
    out = new_folder(df.sparkSession)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """Written once and bucketed by keys, so that later joins and sums by them move the other side alone."""
    spark = df.sparkSession
    name, n = f"kinfold_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.format("parquet").option("path", new_folder(spark)).bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)
