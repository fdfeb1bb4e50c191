"""Readers for the input tables (one Parquet dataset per table name)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


def _row_groups(path: str) -> int | None:
    """Number of Parquet row groups under a local path (footers only); None if unknown."""
    try:
        import pyarrow.parquet as pq
        files = [path] if os.path.isfile(path) else [
            os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")]
        return sum(pq.ParquetFile(f).metadata.num_row_groups for f in files)
    except Exception:  # noqa: BLE001 - remote or unreadable: leave the layout alone
        return None


_LAYOUT: dict[str, int | None] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; callers select columns so pruning reaches the reader.

    Parquet splits by row group. A table stored in fewer row groups than the
    cluster has cores is small by construction (row groups are <= a block),
    and would otherwise be processed by that many tasks only: it is spread
    round-robin over the cores. Large tables (many row groups) are untouched.
    """
    path = table_path(sf_dir, name)
    df = spark.read.parquet(path)
    if path not in _LAYOUT:
        _LAYOUT[path] = _row_groups(path)
    groups, cores = _LAYOUT[path], spark.sparkContext.defaultParallelism
    if groups is not None and groups < cores and name in _SPREAD:
        df = df.repartition(cores)
    return df


# tables whose rows are expensive to process per row (long texts, vectors)
_SPREAD = {"documents", "pages", "conversations", "embeddings"}
