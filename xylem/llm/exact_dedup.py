"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bit_filter, cut, keep_one, may_hold, text_of

#: Characters that the prefix hash reads.
PREFIX_CHARS = 256
#: Bits of the survivors' filter: 512 KiB at any input size, so it can always go to every executor.
FILTER_BITS = 1 << 22


def surviving_filter(sig: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """One row, one array<long> of ``bits`` bits: the bits of every (length, prefix hash) that more than one row has.

    Its size is fixed. Two keys may share a bit; that only sends a row on to the full hash that didn't need it.
    """
    twice = sig.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return bit_filter(twice.select(F.struct("_len", "_prefix").alias("_key")), "_key", bits)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest_all: bool = False, prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Groups equal texts and keeps the row with the largest id of each group.

    A first scan reads of each text its length and a hash of its prefix, and aggregates them. A second scan computes the
    full hash, for rows whose (length, prefix hash) another row shares; ``digest_all`` computes it for the others, too,
    for reporting. Only (id, length, digest) of the survivors are shuffled, never a text, and groups of any size are
    counted in salted parts.

    Returns a row per row of df: id_col, keep_id, group_size (long), kept (boolean), text_sha256 (lower-case hex; null
    for rows that no other resembled, unless digest_all). A null text counts as empty. Null ids come before all others.
    Of rows equal in id and text exactly one is kept. An empty table gives no rows; other columns are not read.
    """
    text = text_of(df, text_col)
    base = df.select(df[id_col].alias("_id"), text.alias("_text"))
    signed = base.select("_id", "_text", F.length("_text").alias("_len"), F.xxhash64(F.substring("_text", 1, prefix_chars)).alias("_prefix"))
    bits = surviving_filter(signed.select("_len", "_prefix"), filter_bits)
    refined = (
        signed.withColumn("_survives", may_hold(bits, F.struct("_len", "_prefix"), filter_bits))
        .select("_id", "_len", "_survives", F.when(F.col("_survives") | F.lit(digest_all), F.unhex(F.sha2("_text", 256))).alias("_sha"))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    rows = cut(refined)
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    alone = rows.filter("not _survives").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    grouped = keep_one(rows.filter("_survives").select("_id", "_len", "_sha", "_row"), ["_len", "_sha"], ["_id", "_row"])
    together = grouped.select(F.col("_id").alias(id_col), F.col("_keep._id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_keep._row") == F.col("_row")).alias("kept"), sha)
    return alone.unionByName(together)
