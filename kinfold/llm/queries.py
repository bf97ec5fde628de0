"""The registered queries of this subpackage, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, centroids, chat, decontaminate, html_text, licenses, lines, maxent, rules, secrets, simhash, toxicity
from .common import held_out, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "margin", "n_toxic")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.fit(html_text.known_text(pages, table(spark, sf_dir, "documents"))))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.apply_rules(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 7, 2)
    scored = maxent.fit_and_score(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_dropped and the hash and length of what is left of each text."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_dropped", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "contaminated", "n_items", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in by two arrivals, one source before all others; what the first one scanned is not scanned again."""
    return secrets.digests(secrets.scan_arrivals(table(spark, sf_dir, "documents"), "source"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), *paths)[0]


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digests(table(spark, sf_dir, "embeddings")).drop("computed")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_main_text, op3_quality_rules, op4_maxent, op5_simhash, op6_bpe, op7_line_dedup, op8_decontamination, op9_secrets, op10_licenses, op11_alignment, op12_centroids, op13_chat_format)}
ORACLE_SQL: dict[str, str] = {"op7_line_dedup": lines.oracle_sql(), "op8_decontamination": decontaminate.oracle_sql(), "op9_secrets": secrets.oracle_sql(), "op10_licenses": licenses.oracle_sql(), "op12_centroids": centroids.oracle_sql(), "op13_chat_format": chat.oracle_sql()}
