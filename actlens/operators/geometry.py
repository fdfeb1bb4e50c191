"""Geometric median by Weiszfeld iterations (AGG9).

Each iteration is one distributed pass: every Arrow batch reduces its
vectors to partial sums (d + 3 numbers) against the broadcast current
median, Spark sums the partials per dimension, and the driver only sees
d + 3 numbers per step. The points are persisted for the loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SUM_W, _OBJ, _W0 = -1, -2, -3


def _partials(points: DataFrame, vec_col: str, weight_col: str | None, median: np.ndarray | None,
              eps: float) -> tuple[np.ndarray, float, float, float]:
    spark = points.sparkSession
    bc = spark.sparkContext.broadcast(median)
    cols = [vec_col] + ([weight_col] if weight_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        for b in batches:
            if b.num_rows == 0:
                continue
            arr = b.column(vec_col)
            d = arr.value_lengths()[0].as_py()
            x = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            w = (b.column(weight_col).to_numpy(zero_copy_only=False).astype(np.float64)
                 if weight_col else np.ones(len(x)))
            if m is None:  # first pass: weighted mean
                s = (w[:, None] * x).sum(axis=0)
                sw, obj = w.sum(), 0.0
            else:
                dist = np.linalg.norm(x - m, axis=1)
                nw = w / np.maximum(dist, eps)
                s = (nw[:, None] * x).sum(axis=0)
                sw, obj = nw.sum(), float((w * dist).sum())
            dims = np.concatenate([np.arange(d), [_SUM_W, _OBJ, _W0]]).astype(np.int32)
            vals = np.concatenate([s, [sw, obj, w.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(vals)], names=["dim", "v"])

    part = points.select(*cols).mapInArrow(run, "dim INT, v DOUBLE")
    rows = part.groupBy("dim").agg(F.sum("v").alias("v")).collect()
    bc.unpersist()
    got = {r["dim"]: r["v"] for r in rows}
    d = max(k for k in got) + 1
    s = np.array([got[i] for i in range(d)])
    return s, got[_SUM_W], got[_OBJ], got[_W0]


def geometric_median(df: DataFrame, vec_col: str = "vec", weight_col: str | None = None, *,
                     eps: float = 1e-6, maxiter: int = 100, ftol: float = 1e-20) -> np.ndarray:
    """Weiszfeld: start at the weighted mean; weights w / max(|x - m|, eps);
    stop when |obj_prev - obj| <= ftol * obj or after maxiter steps.
    objective = weighted mean distance to the median."""
    pts = df.select(vec_col, *([weight_col] if weight_col else [])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        s, sw, _, _ = _partials(pts, vec_col, weight_col, None, eps)
        if sw == 0:
            raise ValueError("no points")
        m0 = s / sw
        s, sw, obj_num, w0 = _partials(pts, vec_col, weight_col, m0, eps)
        obj_prev = obj_num / w0
        m = s / sw
        for i in range(maxiter):
            s, sw, obj_num, w0 = _partials(pts, vec_col, weight_col, m, eps)
            obj = obj_num / w0
            if abs(obj_prev - obj) <= ftol * obj or i == maxiter - 1:
                return m
            obj_prev = obj
            m = s / sw
        return m
    finally:
        pts.unpersist()
