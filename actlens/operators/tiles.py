"""Products of sparse and dense matrices in tiles (JOI7, JOI8, JOI9).

Both sides are cut along the index they share and along the rows of the result.
A task gets one tile of dense rows and the sparse entries that meet it; it returns
one partial vector per result row, and one ordered pass adds the partials of a
row. A hot index meets the result's rows tile by tile, so its entries are spread
over as many tasks as there are tiles of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSE_TILE = 1024        # dense rows in a tile
RESULT_TILE = 4096       # rows of the result in a tile
PAIR_TILE = 256          # vectors on either side of a tile of sampled products


def _tile(col: str, size: int) -> Column:
    return F.floor(F.col(col) / F.lit(size)).cast("bigint")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _product_tile(sparse: pa.Table, dense: pa.Table) -> pa.Table:
    """Partial result rows of the entries that meet one dense tile."""
    schema = pa.schema([("row", pa.int64()), ("part", pa.list_(pa.float64()))])
    if not sparse.num_rows or not dense.num_rows:
        return schema.empty_table()
    ids = dense.column("index").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], _matrix(dense.column("vec"))[order]
    row, index, value = (sparse.column(c).to_numpy() for c in ("row", "index", "value"))
    at = np.minimum(np.searchsorted(ids, index), len(ids) - 1)
    hit = ids[at] == index
    row, at, value = row[hit], at[hit], value[hit]
    names, code = np.unique(row, return_inverse=True)
    out = np.zeros((len(names), x.shape[1]))
    by_row = np.argsort(code, kind="stable")
    step = max(1, (1 << 22) // x.shape[1])          # products held at once: 32 MB
    for lo in range(0, len(by_row), step):
        some = by_row[lo:lo + step]
        first = np.flatnonzero(np.diff(code[some], prepend=-1))
        out[code[some][first]] += np.add.reduceat(value[some, None] * x[at[some]], first, axis=0)
    edge = pa.array(np.arange(len(names) + 1, dtype=np.int32) * x.shape[1])
    return pa.table({"row": names, "part": pa.ListArray.from_arrays(edge, pa.array(out.ravel()))}, schema=schema)


def _added(partials: DataFrame) -> DataFrame:
    """(row, out): partial vectors of a row added in one ordered pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None

        def flush(names: list, sums: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["row", "out"])
        for b in batches:
            if not b.num_rows:
                continue
            row, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            first = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
            names, sums = row[first].tolist(), list(np.add.reduceat(x, first, axis=0))
            if held is not None:
                if names[0] == held:
                    sums[0] = sums[0] + total
                else:
                    names, sums = [held, *names], [total, *sums]
            held, total = names.pop(), sums.pop()
            yield flush(names, sums)
        if held is not None:
            yield flush([held], [total])

    return partials.repartition("row").sortWithinPartitions("row").mapInArrow(run, "row bigint, out array<double>")


def sparse_dense_product(sparse: DataFrame, dense: DataFrame, *, row_col: str = "a", index_col: str = "index",
                         value_col: str = "value", dense_row: str = "row", vec_col: str = "vec") -> DataFrame:
    """JOI7: (row, out) with out = sum of value * dense[index]; rows without an entry
    other than zero, or whose indexes the dense side lacks, are absent."""
    s = sparse.where(F.col(value_col) != 0).select(F.col(row_col).cast("bigint").alias("row"), F.col(index_col).cast("bigint").alias("index"),
                                                   F.col(value_col).cast("double").alias("value"))
    s = s.withColumns({"dt": _tile("index", DENSE_TILE), "rt": _tile("row", RESULT_TILE)})
    d = dense.select(F.col(dense_row).cast("bigint").alias("index"), F.col(vec_col).cast("array<double>").alias("vec")) \
             .withColumn("dt", _tile("index", DENSE_TILE))
    met = s.select("dt", F.col("rt").alias("met")).distinct()
    tiles = d.join(met, "dt").select(F.col("dt").alias("tile"), "met", "index", "vec")
    found = s.groupBy("dt", "rt").cogroup(tiles.groupBy("tile", "met")) \
             .applyInArrow(_product_tile, "row bigint, part array<double>")
    return _added(found)


def sparse_t_dense_product(sparse: DataFrame, dense: DataFrame, n_rows: int, *, row_col: str = "a", index_col: str = "index",
                           value_col: str = "value", dense_row: str = "row", vec_col: str = "vec") -> DataFrame:
    """JOI8: (row, out) of sparse.T @ dense with ``n_rows`` rows; absent ones are zero."""
    found = sparse_dense_product(sparse, dense, row_col=index_col, index_col=row_col, value_col=value_col,
                                 dense_row=dense_row, vec_col=vec_col)
    width = dense.select(F.size(vec_col).alias("d")).first()
    zero = F.array_repeat(F.lit(0.0), width["d"] if width else 0)
    every = sparse.sparkSession.range(n_rows).withColumnRenamed("id", "row")
    return every.join(found, "row", "left").select("row", F.coalesce("out", zero).alias("out"))


def sampled_product(left: DataFrame, right: DataFrame, at: DataFrame, *, i_col: str = "i", j_col: str = "j",
                    vec_col: str = "vec") -> DataFrame:
    """JOI9: (i, j, value) of left @ right.T at the given pairs only. A vector that
    many pairs name travels once per tile of the other side, not once per pair."""
    def packed(df: DataFrame, col: str, side: str) -> DataFrame:
        rows = df.select(F.col(col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return rows.groupBy(_tile("id", PAIR_TILE).alias(f"{side}t")).agg(F.collect_list(F.struct("id", "vec")).alias(side))

    # a tile holds each pair once, with the number of its rows: at most PAIR_TILE squared of them
    pairs = at.groupBy(F.col(i_col).cast("bigint").alias("i"), F.col(j_col).cast("bigint").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    tiles = pairs.groupBy(_tile("i", PAIR_TILE).alias("lt"), _tile("j", PAIR_TILE).alias("rt")) \
                 .agg(F.collect_list(F.struct("i", "j", "n")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                p, x, y = (b.column(c).slice(r, 1).flatten() for c in ("pairs", "l", "r"))
                sides = []
                for who, which in ((x, "i"), (y, "j")):
                    ids = who.field("id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    vec = who.field("vec")
                    m = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)[order]
                    want = p.field(which).to_numpy()
                    place = np.minimum(np.searchsorted(ids[order], want), len(ids) - 1)
                    sides.append((m, place, ids[order][place] == want))
                ok = sides[0][2] & sides[1][2]
                i, j, n = (p.field(c).to_numpy()[ok] for c in ("i", "j", "n"))
                value = np.einsum("pd,pd->p", sides[0][0][sides[0][1][ok]], sides[1][0][sides[1][1][ok]])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, value, n)], names=["i", "j", "value", "n"])

    found = tiles.join(packed(left, i_col, "l"), "lt").join(packed(right, j_col, "r"), "rt").select("pairs", "l", "r")
    return found.mapInArrow(run, "i bigint, j bigint, value double, n bigint") \
                .select(F.col("i").alias(i_col), F.col("j").alias(j_col), "value", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")
