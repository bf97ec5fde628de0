"""The stages of the corpus pipeline and their runner."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, lines, simhash, toxicity
from .common import cuts, held_out, shared_folder, table

RANKS = "byte_bpe_50k.tiktoken"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels come from the labels table, less the rows held out for tests."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    kept = toxicity.keep(docs, toxicity.fit(docs, labels))
    return kept.select(*docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document, or an earlier line of the document, holds already go. A document without any
    line left goes with them; n_chars follows the text."""
    out = lines.parted(docs).where("_n = 0 or _text <> ''")
    changed = {"text": F.col("_text"), "n_chars": F.when(F.col("_n") > 0, F.char_length("_text").cast("long")).otherwise(F.col("_row")["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id. Groups are connected by op5's relation or
    by four fifths of equal five-word shingles. Of rows that repeat an id and its text one stays; rows without an id
    all stay."""
    keep = simhash.near_copies(docs.where("doc_id is not null")).where("head").select(F.col("doc_id").alias("_doc"), F.col("own").alias("_own")).distinct()
    own = F.xxhash64(F.coalesce(F.col("_row")["text"], F.lit("")))
    held = docs.select(F.struct(*docs.columns).alias("_row")).select("_row", F.col("_row")["doc_id"].cast("long").alias("_doc"), own.alias("_own"))
    kept = held.join(keep, ["_doc", "_own"], "left_semi").dropDuplicates(["_doc", "_own"])
    return kept.unionByName(held.where("_doc is null")).select("_row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether decoding gives the text back."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.encode_checked(docs, path, pattern)


#: Texts reach Python in batches of so many rows, unless the session asks for fewer: the stages share executors and workers.
BATCH_ROWS, _BATCH = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(stage: Stage) -> Stage:
    """Sets the session's batch size, which holds while the caller writes the result; run() puts it back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", lines_stage),
    ("near_duplicates", simhash_stage),
    ("decontamination", decontamination_stage),
    ("tokens", bpe_stage),
]
STAGES = [(name, _small_batches(stage)) for name, stage in STAGES]


def run(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Stage]]) -> DataFrame:
    """Each stage's result is written to the shared folder and read again as the next one's input; what a stage has written on
    its way is deleted then, and the session's batch size is as before."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(_BATCH)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (name, stage) in enumerate(stages):
            out = f"{folder}/{k}-{name}"
            with cuts(spark):
                stage(spark, docs, sf_dir).write.parquet(out)
            docs = spark.read.parquet(out)
    finally:
        spark.conf.set(_BATCH, before)
    return docs
