"""The corpus pipeline: STAGES, each (name, function of spark, docs and sf_dir), in order; run() applies them to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from xylem.llm._common import fresh_path
from xylem.llm.bpe import token_digests
from xylem.llm.decontaminate import contamination
from xylem.llm.exact_dedup import exact_dedup
from xylem.llm.queries import tokenizer_file
from xylem.llm.simhash_dedup import near_duplicates
from xylem.llm.toxicity import score_toxicity, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain doesn't find toxic. It is trained on those of them that ``labels`` covers."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter("not is_toxic").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest doc_id. Of rows equal in both, one."""
    kept = exact_dedup(docs, digest_all=True).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    return _of_kept(docs, kept)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the largest doc_id. Of rows equal in id and text, one."""
    kept = near_duplicates(_keyed(docs), "_key").filter("kept").select(F.col("_key.doc_id").alias("_id"), F.lower(F.hex("_key.sha")).alias("_sha"))
    return _of_kept(docs, kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of ``benchmark``."""
    found = contamination(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_key").select("_key").distinct()
    return _keyed(docs).join(found.hint("shuffle_hash"), "_key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to."""
    return token_digests(docs, tokenizer_file("byte_bpe_50k.json"))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key: doc_id, which may be null or repeat, and the text's digest. It is never null."""
    return docs.withColumn("_key", F.struct("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha")))


def _of_kept(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, digest) is in kept (_id, _sha); of rows equal in these, one."""
    signed = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    met = signed.join(kept.distinct(), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha")), "left_semi")
    one = W.partitionBy("doc_id", "_digest").orderBy("doc_id", "_digest")
    return met.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*docs.columns)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near duplicates", near), ("decontamination", decontaminate), ("bpe", encode)]

#: SQL can't express the classifier, the near-duplicate search or the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read again, so the next begins from files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            where = fresh_path(spark, f"stage{k}")
            docs.write.parquet(where)
            docs = spark.read.parquet(where)
    return docs
