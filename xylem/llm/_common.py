"""Shared plumbing of the training-data operators: the shared folder, lineage cuts, salted groups."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; with whole web documents the default of 10,000 makes batches of hundreds of MB.
ARROW_ROWS = 1000
#: Salts of a group that may be hot: a group holding a third of all rows is spread over so many reducers.
SALTS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset, as in tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    own = sc._jsc.sc().getCheckpointDir()
    if where is None:
        where = own.get() if own.isDefined() else "file://" + tempfile.mkdtemp(prefix="xylem-")
    if not own.isDefined():
        sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/xylem-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so lost executors don't bring its lineage back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over: it does when the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of an Arrow batch for whole texts; a smaller setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def text_of(df: DataFrame, col: str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def open_fs(path: str):
    """(pyarrow file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to at most ``most``, or of one item beyond it."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one, of about ``most`` bytes at least but for the last."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield t.to_batches()[0]


def lookup(rows: DataFrame, key: str, table: DataFrame, value: str, salts: int = SALTS) -> DataFrame:
    """rows with ``value`` of the table's row of the same key (unique there; null where there is none).

    A key may be that of any share of the rows: the distinct (key, salt) of the rows look the value up, and each row finds
    it by (key, salt).
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    found = salted.select(key, "_salt").distinct().join(table.select(key, value), key)
    return salted.join(found, [key, "_salt"], "left").drop("_salt")


def bit_filter(keys: DataFrame, key: str, bits: int, hashed: bool = False) -> DataFrame:
    """One row, one array<long> of ``bits`` bits, with those set that the keys (any column type; longs that are their own hashes, if ``hashed``) hash to.

    Its size doesn't depend on the keys' number.
    """
    words = (
        keys.select(F.pmod(F.col(key) if hashed else F.xxhash64(key), F.lit(bits)).alias("_bit"))
        .groupBy(F.shiftright("_bit", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_set"))
    )
    every = keys.sparkSession.range(bits >> 6).withColumnRenamed("id", "_word")
    dense = every.join(words, "_word", "left").agg(F.array_sort(F.collect_list(F.struct("_word", F.coalesce("_set", F.lit(0)).alias("_set")))).alias("_all"))
    return dense.select(F.transform("_all", lambda x: x["_set"]).alias("_filter"))


def may_hold(filter_: DataFrame, key: Column, bits: int) -> Column:
    """Whether the key's bit is set in a bit_filter: true for each of its keys, and for few others while it isn't crowded."""
    bit = F.pmod(F.xxhash64(key), F.lit(bits))
    word = F.get(filter_.scalar(), F.shiftright(bit, 6).cast("int"))
    return F.getbit(word, bit.bitwiseAND(F.lit(63)).cast("int")) == 1


def keep_one(rows: DataFrame, keys: list[str], order: list[str], salts: int = SALTS, weight: str | None = None) -> DataFrame:
    """Adds ``_keep`` (struct of ``order``, the group's largest) and ``_size`` (long: rows, or the sum of weight) to every row.

    Keys must not be null. A plain window or join on the key would bring a hot group into one task; here each group is
    counted by (key, salt) first, the few partial rows of a key meet in a second aggregation, and rows find their group
    again by (key, salt), so that at most 1/salts of a group meets in one place.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"), F.max(F.struct(*order)).alias("_m"))
    total = part.groupBy(*keys).agg(F.sum("_n").alias("_size"), F.max("_m").alias("_keep"))
    back = part.select(*keys, "_salt").join(total, keys)
    return salted.join(back, [*keys, "_salt"]).drop("_salt")
