"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.session import checkpoint_dir, materialize, ship_package

__all__ = ["prepare", "read_table", "materialize", "fold_of", "count_words", "small_or_none"]

ARROW_ROWS = 1_000

#: words of a text: maximal runs without the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """A checkpoint folder, the package on the executors, and Arrow batches small
    enough for whole texts in Python workers; other settings are left alone."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    checkpoint_dir(spark)
    ship_package(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def count_words(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small_or_none(df: DataFrame, max_rows: int) -> DataFrame:
    """The side of a join as a broadcast if its measured row count is within
    ``max_rows``, else unchanged (Spark then shuffles both sides)."""
    return F.broadcast(df) if df.count() <= max_rows else df


def release_memory() -> None:
    """Gives freed memory of a Python worker back; workers stay alive between
    stages and would otherwise hold the peak of every stage before."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass        # another C library: nothing to trim


def released(run):
    """The batch function ``run``, giving its memory back at the end of a task."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return wrapped
