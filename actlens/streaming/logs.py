"""Streaming over run logs (STR1, STR2) and the stream driver used by all
streaming operators (STR6).

Every stream here is a file source read with ``Trigger.AvailableNow``; a run
resumes from its checkpoint location, so a restarted query continues where
the previous one stopped and reprocesses nothing (exactly-once with
idempotent sinks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.sources.logs import LOG_SCHEMA


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 max_files_per_trigger: int | None = 1) -> DataFrame:
    """STR1/STR6: a file-source stream in file order, at most n files per micro-batch."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def stream_logs(spark: SparkSession, path: str, schema: T.StructType = LOG_SCHEMA) -> DataFrame:
    """STR1: log lines appended by running jobs, read as they arrive."""
    return stream_files(spark, path, schema, fmt="json", max_files_per_trigger=None)


def run_available(stream: DataFrame, checkpoint: str, *, sink: Callable[[DataFrame, int], None] | None = None,
                  path: str | None = None, fmt: str = "parquet", output_mode: str = "append",
                  name: str | None = None) -> None:
    """STR6: process everything available now, then stop; rerun to continue."""
    spark = stream.sparkSession
    if name and any(q.name == name for q in spark.streams.active):
        raise RuntimeError(f"stream {name!r} is already being consumed")
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(output_mode) \
              .trigger(availableNow=True)
    if name:
        w = w.queryName(name)
    if sink is not None:
        q = w.foreachBatch(sink).start()
    else:
        q = w.format(fmt).option("path", path).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def usage_windows(stream: DataFrame, ts_col: str, value_cols: list[str], *, width: str = "30 seconds",
                  watermark: str = "1 minute") -> DataFrame:
    """STR2: tumbling-window mean / max of sampled usage; the watermark bounds
    the state (late samples beyond it are dropped)."""
    s = stream.withWatermark(ts_col, watermark)
    aggs = []
    for c in value_cols:
        aggs += [F.avg(c).alias(f"avg_{c}"), F.max(c).alias(f"max_{c}")]
    return s.groupBy(F.window(ts_col, width)).agg(*aggs, F.count(F.lit(1)).alias("n"))
