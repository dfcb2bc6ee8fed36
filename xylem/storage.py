"""Folders that all executors share, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset, as in tests, a temporary folder."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else "file://" + tempfile.mkdtemp(prefix="xylem-"))
    if not own.isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/xml-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df computed once, its rows kept in the shared folder: a table that many steps read isn't scanned again for each."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
