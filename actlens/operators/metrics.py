"""Reconstruction metrics and losses (MET1-MET11).

Row-level quantities are array expressions on (vec, recon) pairs produced by
``scoring.reconstruct`` (no shuffle); batch metrics are one ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def row_metrics(rows: DataFrame, vec_col: str = "vec", recon_col: str = "recon") -> DataFrame:
    """Per row: se = sum d^2, mse_row, norm, vp_row, var_row, sum / sum of squares of x.

    Rows from ``scoring.reconstruct`` already carry se, sx, sxx, var_row and
    n_dims (computed in the Arrow pass); other inputs fall back to array
    expressions."""
    if all(c in rows.columns for c in ("se", "sx", "sxx", "var_row", "n_dims")):
        out = rows.withColumn("_n", F.col("n_dims")).withColumn("mse_row", F.col("se") / F.col("n_dims")) \
                  .withColumn("norm", F.sqrt("sxx"))
        out = out.withColumn("vp_row", F.try_divide(F.col("se"), F.col("norm")) / F.col("_n") + F.lit(1e-9))
        return out.withColumn("ev_row", F.lit(1.0) - F.try_divide(F.col("se"), F.col("var_row")))
    x, r = F.col(vec_col), F.col(recon_col)
    d2 = F.zip_with(x, r, lambda a, b: (a - b) * (a - b))
    n = F.size(x)
    out = rows.withColumn("se", _sum(d2)).withColumn("_n", n) \
              .withColumn("sx", _sum(x)).withColumn("sxx", _sum(F.transform(x, lambda a: a * a)))
    out = out.withColumn("mse_row", F.col("se") / F.col("_n")) \
             .withColumn("norm", F.sqrt("sxx"))
    out = out.withColumn("vp_row", F.try_divide(F.col("se"), F.col("norm")) / F.col("_n") + F.lit(1e-9))
    mean_row = F.col("sx") / F.col("_n")
    out = out.withColumn("var_row", _sum(F.transform(x, lambda a: (a - mean_row) * (a - mean_row))))
    return out.withColumn("ev_row", F.lit(1.0) - F.try_divide(F.col("se"), F.col("var_row")))


def batch_metrics(rows: DataFrame, group_cols: Sequence[str] = ("batch_id",)) -> DataFrame:
    """MET1/MET2/MET3/MET5: mse, sum_mse, variance_prop_mse, explained_variance,
    L0, L1 and input mean / std (n-1) per batch."""
    m = row_metrics(rows)
    n_vals = F.sum("_n")
    mean = F.sum("sx") / n_vals
    var = (F.sum("sxx") - n_vals * mean * mean) / (n_vals - F.lit(1))
    return m.groupBy(*group_cols).agg(
        F.avg("mse_row").alias("mse"), F.avg("se").alias("sum_mse"),
        F.avg("vp_row").alias("variance_prop_mse"), F.avg("ev_row").alias("explained_variance"),
        F.avg(F.col("l0").cast("double")).alias("l0"), F.avg("l1").alias("l1"),
        mean.alias("input_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("input_std"),
        F.count(F.lit(1)).alias("n_rows"))


def position_mse(rows: DataFrame, seq_len: int, *, group_cols: Sequence[str] = ("batch_id",),
                 pos_col: str = "pos") -> DataFrame:
    """MET4: mean row-mse per position; an absent position reports 0."""
    m = row_metrics(rows).groupBy(*group_cols, pos_col).agg(F.avg("mse_row").alias("position_mse"))
    grid = rows.select(*group_cols).distinct().withColumn(
        pos_col, F.explode(F.sequence(F.lit(0), F.lit(seq_len - 1))))
    return grid.join(m, on=[*group_cols, pos_col], how="left") \
               .select(*group_cols, pos_col, F.coalesce("position_mse", F.lit(0.0)).alias("position_mse"))


def normalised_l2(rows: DataFrame, group_cols: Sequence[str] = ("batch_id",),
                  vec_col: str = "vec", recon_col: str = "recon", dim_col: str = "dim") -> DataFrame:
    """MET8: l2 / variance around the per-dimension batch mean (mean predictor).

    Each Arrow batch reduces its rows to per-(group, dim) partial sums of x,
    x^2 and (x - recon)^2; Spark adds the partials. No row is exploded into
    its dimensions."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    g = list(group_cols)
    schema = T.StructType([rows.schema[c] for c in g] + [
        T.StructField(dim_col, T.IntegerType(), False), T.StructField("_sx", T.DoubleType(), False),
        T.StructField("_sxx", T.DoubleType(), False), T.StructField("_se", T.DoubleType(), False),
        T.StructField("_n", T.LongType(), False)])

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            d = b.column(vec_col).value_lengths()[0].as_py()
            x = b.column(vec_col).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            r = b.column(recon_col).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in g]
            combo = np.stack(keys, axis=1) if keys else np.zeros((b.num_rows, 0))
            uniq, inv = np.unique(combo, axis=0, return_inverse=True) if keys else (np.zeros((1, 0)), np.zeros(b.num_rows, int))
            inv = inv.ravel()
            k = len(uniq)
            sx = np.zeros((k, d)); sxx = np.zeros((k, d)); se = np.zeros((k, d))
            np.add.at(sx, inv, x); np.add.at(sxx, inv, x * x); np.add.at(se, inv, (x - r) ** 2)
            cnt = np.bincount(inv, minlength=k)
            cols = [pa.array(np.repeat(uniq[:, i], d).astype(keys[i].dtype)) for i in range(len(g))]
            cols += [pa.array(np.tile(np.arange(d, dtype=np.int32), k)), pa.array(sx.ravel()),
                     pa.array(sxx.ravel()), pa.array(se.ravel()), pa.array(np.repeat(cnt, d).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    part = rows.select(*g, vec_col, recon_col).mapInArrow(run, schema)
    per_dim = part.groupBy(*g, dim_col).agg(
        F.sum("_se").alias("_se"), (F.sum("_sxx") - F.sum("_sx") * F.sum("_sx") / F.sum("_n")).alias("_sv"),
        F.sum("_n").alias("_n"))
    return per_dim.groupBy(*g).agg(
        (F.sum("_se") / F.sum("_n")).alias("l2"), (F.sum("_sv") / F.sum("_n")).alias("variance")) \
        .withColumn("l2_scaled", F.try_divide(F.col("l2"), F.col("variance")))


def expert_privilege(share: DataFrame, n_experts: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """MET6: n_experts * sum_e weighting_e * share_e."""
    return share.groupBy(*group_cols).agg(
        (F.lit(float(n_experts)) * F.sum(F.col("weighting") * F.col("share"))).alias("expert_privilege"))


def loss_combination(metrics: DataFrame, architecture: str, *, l1_coefficient: float = 0.0,
                     aux_col: str | None = None) -> DataFrame:
    """MET10: relu: vp_mse + c*L1; topk/switch: vp_mse; second family: l2 + c*L1 (+aux);
    jumprelu: l2 + c*L0."""
    c = F.lit(float(l1_coefficient))
    if architecture == "relu":
        loss = F.col("variance_prop_mse") + c * F.col("l1")
    elif architecture in ("topk", "switch", "switch_topk"):
        loss = F.col("variance_prop_mse")
    elif architecture in ("batch_topk", "topk_relu", "vanilla"):
        loss = F.col("mse") + c * F.col("l1")
        if aux_col:
            loss = loss + F.coalesce(F.col(aux_col), F.lit(0.0))
    elif architecture == "jumprelu":
        loss = F.col("mse") + c * F.col("l0")
    else:
        raise ValueError(f"unknown architecture {architecture!r}")
    return metrics.withColumn("loss", loss)


def dead_pct(dead: DataFrame, dead_col: str = "dead") -> DataFrame:
    """MET7: share of features past the threshold."""
    return dead.agg(F.avg(F.col(dead_col).cast("double")).alias("dead_feature_prop"))
