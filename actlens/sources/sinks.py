"""Sinks (SNK1-SNK13): writers of activations, blocks, metadata, logs, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.operators import scoring


def extract_features(df: DataFrame, d: scoring.Dictionary, arch: str, *, k: int | None = None,
                     key_cols: Sequence[str] = ("sample_id", "path"), out_path: str | None = None,
                     part_col: str | None = None) -> DataFrame:
    """MOD12: vectors -> sparse latents with their source paths; optionally
    written as a partitioned Parquet table (every part kept)."""
    lat = scoring.encode(df, d, arch, k=k, key_cols=key_cols)
    if out_path:
        w = lat.write.mode("overwrite")
        if part_col:
            w = w.partitionBy(part_col)
        w.parquet(out_path)
        return df.sparkSession.read.parquet(out_path)
    return lat


def write_activations(df: DataFrame, path: str, *, partition_cols: Sequence[str] = ("run", "layer", "module"),
                      expected_locations: DataFrame | None = None) -> DataFrame:
    """SNK1: one Parquet dataset partitioned by location; returns the per-location
    metadata rows. A location expected but without rows raises."""
    parts = list(partition_cols)
    df.write.mode("append").partitionBy(*parts).parquet(path)
    meta = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vec")).alias("d_in"))
    if expected_locations is not None:
        missing = expected_locations.join(meta, on=parts, how="left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"no activations for location {missing[0].asDict()}")
    return meta


def save_sequence_activations(df: DataFrame, path: str, from_pos: int, pos_col: str = "pos") -> None:
    """SNK11: store a text set's activations from position ``from_pos`` on."""
    df.where(F.col(pos_col) >= from_pos).write.mode("overwrite").parquet(path)


def discard(df: DataFrame) -> None:
    """SNK12: consume everything, store nothing (times the upstream plan)."""
    df.write.format("noop").mode("overwrite").save()


def skip_existing(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """SNK13: append only the key groups that the target does not hold yet;
    returns what was appended."""
    from actlens.session import materialize
    from actlens.sources.files import exists, qualified
    spark = df.sparkSession

    def same(a: DataFrame, b: DataFrame):
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])

    wanted = df.select(*keys).distinct()
    if exists(qualified(spark, path)):
        have = spark.read.parquet(path).select(*keys).distinct()
        wanted = wanted.join(have, on=same(wanted, have), how="left_anti")
    # written: the returned frame must not change once the target holds these groups
    wanted = materialize(wanted, "missing-groups")
    df.join(wanted, on=same(df, wanted), how="left_semi").write.mode("append").partitionBy(*keys).parquet(path)
    if not exists(qualified(spark, path)):
        return df.limit(0)
    held = spark.read.parquet(path)
    return held.join(wanted, on=same(held, wanted), how="left_semi")
