"""Reading vector columns inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def vectors_of(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Usable vectors of a list column, grouped by dimension.

    Returns (dimension, row numbers, vectors as float64). A vector that is
    null, empty, zero or holds a null or non-finite component is left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.values
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False) if values.null_count == 0 else \
        np.array([np.nan if v is None else v for v in values.to_pylist()], np.float64)
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    valid = ~column.is_null().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(size[valid & (size > 0)]):
        rows = np.flatnonzero(valid & (size == d))
        x = flat[offsets[rows][:, None] + np.arange(int(d))]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        out.append((int(d), rows[good], x[good]))
    return out


def sample_vectors(column_batches: list[list[float]]) -> np.ndarray:
    """Driver-side matrix of a bounded sample: the most frequent dimension."""
    arrays = [np.array([np.nan if c is None else c for c in v], np.float64) for v in column_batches if v]
    arrays = [a for a in arrays if np.isfinite(a).all() and a.any()]
    if not arrays:
        return np.zeros((0, 0))
    sizes = [len(a) for a in arrays]
    most = max(set(sizes), key=lambda d: (sizes.count(d), d))
    return np.stack([a for a in arrays if len(a) == most])
