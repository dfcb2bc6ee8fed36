"""Queries of the training-data operators, for the registry, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import token_digests
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .license_scan import license_scan
from .line_dedup import dedup_lines
from .pii import find_pii
from .simhash_dedup import near_duplicates
from .token_shards import materialise
from .toxicity import score_toxicity, train_toxicity
from .warc import round_trip


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file: in $XYLEM_TOKENIZERS, or where the public_tokenizers package has it."""
    if folder := os.environ.get("XYLEM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = round_trip(table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return chunks.filter("is_last").select(
        number("record_id").alias("page_id"), F.col("running_bytes").alias("payload_bytes"), F.col("running_sha1").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"), "error"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), model).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_warc, op3_decontamination, op4_line_dedup, op5_pii, op6_simhash_dedup, op7_bpe, op8_license_scan, op9_token_shards, op10_toxicity, pipeline)
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS r FROM p)
        SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN r <> page_id THEN r END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM d""",
}
