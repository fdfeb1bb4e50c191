"""Moments of vectors by group, kept as vectors (AGG1, AGG5, AGG7, AGG8).

A task merges the rows of its Arrow batches into one accumulator per group: count,
mean, sum of squared deviations, least and greatest value of every dimension.
Accumulators are what is shuffled; one ordered pass per group merges them, so a
group with a third of all rows sends a few accumulators per task, and no row per
value is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_BYTES = 64 << 20       # accumulators that a task holds before it hands them on

_PARTS = ("mean", "m2", "lo", "hi")


def _merge(a: tuple, b: tuple) -> tuple:
    """(n, mean, m2, lo, hi) of both sides together."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return (n, a[1] + step * (b[0] / n), a[2] + b[2] + step * step * (a[0] * b[0] / n), np.minimum(a[3], b[3]),
            np.maximum(a[4], b[4]))


def _of_rows(x: np.ndarray) -> tuple:
    mean = x.mean(axis=0)
    return len(x), mean, ((x - mean) ** 2).sum(axis=0), x.min(axis=0), x.max(axis=0)


def _rows(names: list[str], keys: list[tuple], accs: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in keys], schema.field(n).type) for i, n in enumerate(names)]
    columns.append(pa.array([a[0] for a in accs], pa.int64()))
    columns += [pa.array([a[i] for a in accs], pa.list_(pa.float64())) for i in range(1, 5)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def group_moments(df: DataFrame, group_cols: Sequence[str], *, vec_col: str = "vec", held_bytes: int = HELD_BYTES) -> DataFrame:
    """(groups, n, mean, m2, lo, hi): one accumulator per group. Vectors of a group
    have one length; null vectors are left out."""
    names = list(group_cols)
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField("n", T.LongType())] + [
        T.StructField(c, T.ArrayType(T.DoubleType(), False)) for c in _PARTS])
    src = df.where(F.col(vec_col).isNotNull()).select(*names, F.col(vec_col).cast("array<double>").alias("__x"))

    def arrow(batch: pa.RecordBatch) -> pa.Schema:
        return pa.schema([pa.field(c, batch.schema.field(c).type) for c in names] + [pa.field("n", pa.int64())] + [
            pa.field(c, pa.list_(pa.float64())) for c in _PARTS])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        out = None
        for b in batches:
            if not b.num_rows:
                continue
            out = out or arrow(b)
            width = b.column("__x").value_lengths().to_numpy(zero_copy_only=False)
            code: dict[tuple, int] = {}
            keys = zip(*(b.column(c).to_pylist() for c in names)) if names else [()] * b.num_rows
            at = np.array([code.setdefault((*k, int(w)), len(code)) for k, w in zip(keys, width)])
            flat, edge = b.column("__x").values.to_numpy(zero_copy_only=False), b.column("__x").offsets.to_numpy()
            order = np.argsort(at, kind="stable")
            for key, rows in zip(code, np.split(order, np.cumsum(np.bincount(at))[:-1])):
                now = _of_rows(flat[edge[rows][:, None] + np.arange(key[-1])])
                held[key] = _merge(held[key], now) if key in held else now
            if sum(a[1].nbytes for a in held.values()) * 4 > held_bytes:
                yield _rows(names, [k[:-1] for k in held], list(held.values()), out)
                held = {}
        if held:
            yield _rows(names, [k[:-1] for k in held], list(held.values()), out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, acc, out = None, None, None
        for b in batches:
            out = out or b.schema
            done_keys, done = [], []
            keys = list(zip(*(b.column(c).to_pylist() for c in names))) if names else [()] * b.num_rows
            vectors = [b.column(c).to_pylist() for c in _PARTS]
            for i, n in enumerate(b.column("n").to_pylist()):
                now = (n, *(np.array(v[i]) for v in vectors))
                if acc is not None and keys[i] == held:
                    acc = _merge(acc, now)
                    continue
                if acc is not None:
                    done_keys.append(held)
                    done.append(acc)
                held, acc = keys[i], now
            yield _rows(names, done_keys, done, out)
        if acc is not None:
            yield _rows(names, [held], [acc], out)

    partials = src.mapInArrow(collect, schema)
    ordered = partials.repartition(*names).sortWithinPartitions(*names) if names else partials.coalesce(1)
    return ordered.mapInArrow(merge, schema)


def std(m2: Column, n: Column) -> Column:
    """Sample deviations of an accumulator (null for a single row)."""
    return F.when(n > 1, F.transform(m2, lambda s: F.sqrt(s / (n - 1))))


def _sum(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def batch_norm_vectors(df: DataFrame, *, group_cols: Sequence[str] = ("batch_id",), vec_col: str = "vec",
                       eps: float = 1e-6) -> DataFrame:
    """AGG5: ``df`` and ``normed``, every vector as (x - mean) / (std_{n-1} + eps) of
    its group. The accumulators join the vectors by group."""
    names = list(group_cols)
    acc = group_moments(df, names, vec_col=vec_col).select(
        *[F.col(c).alias(f"__{c}") for c in names], F.col("mean").alias("__mean"), std(F.col("m2"), F.col("n")).alias("__std"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    x = F.transform(vec_col, lambda v: v.cast("double"))
    z = F.zip_with(F.zip_with(x, "__mean", lambda a, m: a - m), "__std", lambda a, s: a / (s + F.lit(eps)))
    return df.join(acc, same).withColumn("normed", z).drop("__mean", "__std", *[f"__{c}" for c in names])


def batch_value_stats(df: DataFrame, *, group_cols: Sequence[str] = ("batch_id",), vec_col: str = "vec") -> DataFrame:
    """AGG1: mean, min, max, std (n-1) of all values of each group, and their number."""
    acc = group_moments(df, group_cols, vec_col=vec_col)
    n, d = F.col("n"), F.size("mean")
    mean = _sum("mean") / d
    between = F.aggregate("mean", F.lit(0.0), lambda a, m: a + (m - F.col("__mean")) * (m - F.col("__mean")))
    return acc.withColumn("__mean", mean).select(
        *group_cols, F.col("__mean").alias("mean"), F.array_min("lo").alias("min"), F.array_max("hi").alias("max"),
        F.when(n * d > 1, F.sqrt((_sum("m2") + n * between) / (n * d - 1))).alias("std"), (n * d).cast("bigint").alias("n_values"))


def mean_std_vectors(df: DataFrame, *, batch_col: str = "batch_id", vec_col: str = "vec") -> DataFrame:
    """AGG7: (dim, mean, std): the mean and std vectors of the batches, averaged."""
    acc = group_moments(df, [batch_col], vec_col=vec_col)
    per = acc.withColumn("s", std(F.col("m2"), F.col("n")))
    long = per.select(F.posexplode(F.arrays_zip("mean", F.coalesce("s", F.array()).alias("s"))).alias("dim", "v"))
    return long.groupBy(F.col("dim").cast("int").alias("dim")).agg(F.avg("v.mean").alias("mean"), F.avg("v.s").alias("std"))


def spread_vectors(df: DataFrame, *, pos_col: str = "pos", vec_col: str = "vec", skip_first: bool = False) -> DataFrame:
    """AGG8: per position (a) std over dims averaged over samples, (b) std over samples
    averaged over dims, (c) mean over samples and dims. (a) is one number a row."""
    x = df.where(F.col(pos_col) > 0) if skip_first else df
    v = F.transform(vec_col, lambda c: c.cast("double"))
    rows = x.select(pos_col, v.alias("vec")).withColumn("__mu", _sum("vec") / F.size("vec"))
    own = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + (c - F.col("__mu")) * (c - F.col("__mu"))) / (F.size("vec") - 1))
    a = rows.groupBy(pos_col).agg(F.avg(own).alias("std_over_dims"))
    acc = group_moments(rows, [pos_col])
    b = acc.select(pos_col, (_sum(std(F.col("m2"), F.col("n"))) / F.size("m2")).alias("std_over_samples"),
                   (_sum("mean") / F.size("mean")).alias("mean"))
    return a.join(b, pos_col)
