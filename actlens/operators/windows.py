"""Window operators (WIN1-WIN8).

Per-group top-k uses ``row_number() <= k`` which Spark plans as a
WindowGroupLimit on both sides of the shuffle: each map task forwards at
most k rows per group, so a feature holding a third of all rows still sends
only k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_feature(latents: DataFrame, k: int = 9, *, feature_cols: Sequence[str] = ("feature",),
                      sample_col: str = "sample_id", value_col: str = "value",
                      require_full: bool = True) -> DataFrame:
    """WIN1: per feature the k largest positive activations, ties by sample index.

    A feature is reported only when it owns k values > 0 (its k-th value > 0).
    """
    g = list(feature_cols)
    pos = latents.where(F.col(value_col) > 0)
    w = Window.partitionBy(*g).orderBy(F.col(value_col).desc(), F.col(sample_col))
    top = pos.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    if not require_full:
        return top
    n = F.count(F.lit(1)).over(Window.partitionBy(*g))
    return top.withColumn("_n", n).where(F.col("_n") == k).drop("_n")


def activated_samples(latents: DataFrame, *, feature_cols: Sequence[str] = ("feature",),
                      sample_col: str = "sample_id", value_col: str = "value") -> DataFrame:
    """WIN2: per feature every sample with value > 0, with its order number.

    Kept in long form (one row per activation): a frequent feature never
    becomes one unbounded list.
    """
    g = list(feature_cols)
    return latents.where(F.col(value_col) > 0).select(*g, sample_col)


def rank_within(df: DataFrame, group_cols: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """WIN3: ranks 1..n without ties inside each group."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint"))


def bucketed_lag(df: DataFrame, group_cols: Sequence[str], order_col: str, value_col: str,
                 bucket: Column, name: str) -> DataFrame:
    """Previous row's ``value_col`` inside each group, in ``order_col`` order.

    ``bucket`` (monotone in the order) splits a group into slices: the lag runs
    inside each (group, bucket) slice, and the first row of a slice takes the
    last value of the previous non-empty slice from a small per-slice table.
    A run holding a third of all rows is spread over its slices."""
    g = list(group_cols)
    x = df.withColumn("_lb", bucket)
    w = Window.partitionBy(*g, "_lb").orderBy(order_col)
    x = x.withColumn("_lag", F.lag(value_col).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = x.groupBy(*g, "_lb").agg(F.max_by(value_col, order_col).alias("_last"))
    carry = last.select(*g, "_lb", F.lag("_last").over(Window.partitionBy(*g).orderBy("_lb")).alias("_carry"))
    out = x.join(carry, on=[*g, "_lb"], how="inner")
    return out.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))) \
              .drop("_lb", "_lag", "_first", "_carry")


def rate_between_logs(logs: DataFrame, *, run_col: str = "run", ts_col: str = "timestamp",
                      tokens_per_log: float = 1.0, bucket_seconds: int = 3600) -> DataFrame:
    """WIN4: seconds since the previous log of the run and tokens/s over that gap."""
    prev = bucketed_lag(logs, [run_col], ts_col, ts_col, F.floor(F.col(ts_col) / F.lit(bucket_seconds)), "_prev_ts")
    return prev.withColumn("elapsed", F.col(ts_col) - F.col("_prev_ts")).drop("_prev_ts") \
               .withColumn("tokens_per_s", F.try_divide(F.lit(float(tokens_per_log)), F.col("elapsed")))


def moving_average(df: DataFrame, value_col: str, order_col: str, w: int, *,
                   group_cols: Sequence[str] = (), name: str | None = None,
                   index_col: str | None = None, slice_rows: int = 1 << 16) -> DataFrame:
    """WIN5: flat moving mean, 'valid' mode (only full windows are returned).

    With ``index_col`` (a dense 1-based position inside the group) the group
    is cut into slices of ``slice_rows`` rows and each slice also receives the
    w - 1 rows before it (a halo), so windows never span a whole group and the
    result is exact."""
    out_name = name or f"{value_col}_ma{w}"
    if index_col is None:
        spec = Window.partitionBy(*group_cols).orderBy(order_col)
        out = df.withColumn(out_name, F.avg(value_col).over(spec.rowsBetween(-(w - 1), 0))) \
                .withColumn("_rn", F.row_number().over(spec))
        return out.where(F.col("_rn") >= w).drop("_rn")
    if w - 1 > slice_rows:
        raise ValueError("window longer than a slice")
    i0 = F.col(index_col) - F.lit(1)
    own = df.withColumn("_slice", F.floor(i0 / F.lit(slice_rows))).withColumn("_halo", F.lit(False))
    halo = df.where((i0 % F.lit(slice_rows)) >= F.lit(slice_rows - (w - 1))) \
             .withColumn("_slice", F.floor(i0 / F.lit(slice_rows)) + F.lit(1)).withColumn("_halo", F.lit(True))
    both = own.unionByName(halo)
    spec = Window.partitionBy(*group_cols, "_slice").orderBy(index_col).rowsBetween(-(w - 1), 0)
    out = both.withColumn(out_name, F.avg(value_col).over(spec))
    return out.where(~F.col("_halo") & (F.col(index_col) >= F.lit(w))).drop("_slice", "_halo")


def dead_features(latents: DataFrame, n_features: int, current_batch: int, batch_size: int,
                  threshold: int, *, batch_col: str = "batch_id", feature_col: str = "feature",
                  value_col: str = "value", group_cols: Sequence[str] = ()) -> DataFrame:
    """WIN6: samples since last activity per feature; dead if >= threshold.

    Last active batch = max batch with value > 0; a never-active feature
    counts from batch 0. Samples since = (current - last + 1) * batch_size.
    """
    spark = latents.sparkSession
    g = list(group_cols)
    last = latents.where(F.col(value_col) > 0).groupBy(*g, feature_col) \
                  .agg(F.max(batch_col).alias("last_active"))
    seq = F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias(feature_col)
    feats = latents.select(*g).distinct().select(*g, seq) if g else spark.range(1).select(seq)
    out = feats.join(last, on=[*g, feature_col], how="left")
    since = (F.lit(current_batch) - F.coalesce(F.col("last_active"), F.lit(0)) + F.lit(1)) * F.lit(batch_size)
    return out.select(*g, feature_col, F.col("last_active"), since.cast("bigint").alias("samples_since"),
                      (since >= F.lit(threshold)).alias("dead"))


def inactive_batches(latents: DataFrame, n_features: int, current_batch: int, n: int, *,
                     batch_col: str = "batch_id", feature_col: str = "feature",
                     value_col: str = "value") -> DataFrame:
    """WIN7: batches since the feature's batch sum was > 0; dead if > n (count) / >= n (aux)."""
    spark = latents.sparkSession
    sums = latents.groupBy(batch_col, feature_col).agg(F.sum(value_col).alias("_s"))
    last = sums.where(F.col("_s") > 0).groupBy(feature_col).agg(F.max(batch_col).alias("last_active"))
    feats = spark.range(n_features).select(F.col("id").cast("int").alias(feature_col))
    out = feats.join(last, on=feature_col, how="left")
    since = F.lit(current_batch) - F.coalesce(F.col("last_active"), F.lit(-1))
    return out.select(feature_col, "last_active", since.cast("bigint").alias("batches_since"),
                      (since > F.lit(n)).alias("dead"), (since >= F.lit(n)).alias("dead_for_aux"))


def dead_history(latents: DataFrame, n_features: int, batch_size: int, threshold: int, *,
                 batch_col: str = "batch_id", feature_col: str = "feature",
                 value_col: str = "value", bucket_width: int = 1 << 16) -> DataFrame:
    """WIN6 per step: share of dead features after every batch.

    A feature is dead at batch b when (b - last + 1) * batch_size >= threshold,
    last = its latest active batch <= b (0 before any activity). Between two
    activations p < c it is dead on [p + w - 1, c - 1] with w = ceil(threshold /
    batch_size); after its last activation from last + w - 1 on. These
    intervals become +1 / -1 events, and a bucketed prefix sum over the batch
    axis counts the dead features at each batch: the work grows with the
    activity rows, never with features x batches.
    """
    from actlens.operators.ordering import prefix_sum
    w = -(-threshold // batch_size)
    act = latents.where(F.col(value_col) > 0).select(feature_col, batch_col).distinct()
    prev = bucketed_lag(act, [feature_col], batch_col, batch_col,
                        F.floor(F.col(batch_col) / F.lit(bucket_width)), "_prev")
    start = F.coalesce(F.col("_prev"), F.lit(0)) + F.lit(w - 1)
    gaps = prev.select(start.alias("_s"), (F.col(batch_col) - F.lit(1)).alias("_e")).where(F.col("_e") >= F.col("_s"))
    last = act.groupBy(feature_col).agg(F.max(batch_col).alias("_last"))
    n_active = last.agg(F.count(F.lit(1)).alias("n")).select(F.col("n"))
    opens = last.select((F.col("_last") + F.lit(w - 1)).alias("_at"), F.lit(1).alias("_d"))
    never = n_active.select(F.lit(w - 1).cast("bigint").alias("_at"),
                            (F.lit(n_features) - F.col("n")).alias("_d"))
    events = gaps.select(F.col("_s").alias("_at"), F.lit(1).alias("_d")) \
        .unionByName(gaps.select((F.col("_e") + F.lit(1)).alias("_at"), F.lit(-1).alias("_d"))) \
        .unionByName(opens).unionByName(never.select(F.col("_at").cast("bigint"), F.col("_d").cast("int")))
    batches = latents.select(F.col(batch_col).alias("_at")).distinct().withColumn("_d", F.lit(0))
    delta = events.withColumn("_at", F.col("_at").cast("bigint")).unionByName(batches) \
                  .groupBy("_at").agg(F.sum("_d").alias("_d"))
    present = batches.select("_at").withColumn("_present", F.lit(True))
    counted = prefix_sum(delta, ["_at"], "_d", bucket=F.floor(F.col("_at") / F.lit(bucket_width)),
                         name="_dead", inclusive=True)
    out = counted.join(present, on="_at", how="inner")
    return out.select(F.col("_at").alias(batch_col), (F.col("_dead") / F.lit(float(n_features))).alias("dead_pct"))


def first_k_steps(df: DataFrame, *, step_col: str = "step", pos_col: str | None = "pos",
                  max_step: int = 200, every: int = 5, max_pos: int = 20) -> DataFrame:
    """WIN8: every ``every``-th of the first ``max_step`` steps, first positions."""
    cond = (F.col(step_col) < max_step) & (F.col(step_col) % every == 0)
    if pos_col:
        cond = cond & (F.col(pos_col) < max_pos)
    return df.where(cond)
