"""Aggregations and statistics (AGG1-AGG25, TOP1); those of vectors by group are in ``moments``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.session import materialize


def topk_dims(df: DataFrame, k: int, *, largest: bool = True, key_cols: Sequence[str] = ("vec_id",),
              vec_col: str = "vec", dim_col: str = "dim", value_col: str = "x") -> DataFrame:
    """TOP1: k largest / smallest dimensions of each vector with their positions
    (equal values by position). Sorted inside the row: no shuffle."""
    sign = -1.0 if largest else 1.0
    pairs = F.transform(vec_col, lambda x, i: F.struct((F.lit(sign) * x.cast("double")).alias("v"), i.alias("i")))
    best = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s, r: F.struct(
        (r + 1).cast("bigint").alias("rank"), s["i"].alias(dim_col), (F.lit(sign) * s["v"]).alias(value_col)))
    return df.select(*key_cols, F.inline(best))


def batch_stats(long: DataFrame, group_cols: Sequence[str] = ("batch_id",), value_col: str = "x") -> DataFrame:
    """AGG1: mean, min, max, std (n-1) of all values of each batch, and its count."""
    v = F.col(value_col).cast("double")
    return long.groupBy(*group_cols).agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"), F.count(F.lit(1)).alias("n_values"))


def sample_dim_stats(long: DataFrame, n_dims: int = 64, *, sample_col: str = "sample_id",
                     dim_col: str = "dim", value_col: str = "x") -> DataFrame:
    """AGG2: per sample and dimension mean / max / min over positions, first n dims."""
    v = F.col(value_col)
    return long.where(F.col(dim_col) < n_dims).groupBy(sample_col, dim_col).agg(
        F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"))


def histogram(df: DataFrame, value_col: str, bins: int, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG3/AGG4: equal-width counts between min and max (last edge closed).

    Bin b (1-based) covers [lo + (b-1)w, lo + b w); empty bins report 0.
    With lo = hi every value falls in the middle bin of [lo-0.5, hi+0.5]
    (the convention of numpy.histogram). The bounds, one row per group, are
    written first: while their files are below the session's broadcast threshold
    the values join them in place, beyond it by a shuffle that AQE splits.
    """
    g = list(group_cols)
    spark = df.sparkSession
    v = F.col(value_col).cast("double")
    bounds = df.groupBy(*g).agg(F.min(v).alias("_lo0"), F.max(v).alias("_hi0"))
    bounds = bounds.select(*g,
                           F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("lo"),
                           F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("hi"))
    # without groups the bounds are two scalars (one small job, then literals);
    # with groups they are a written table of known size, joined by key
    keys = g if g else ["_one"]
    if not g:
        b = bounds.first()
        bounds = spark.createDataFrame([(0, b["lo"], b["hi"])], "_one INT, lo DOUBLE, hi DOUBLE")
        x = df.select(v.alias("_v")).select(F.lit(0).alias("_one"), "_v", F.lit(b["lo"]).alias("lo"),
                                            F.lit(b["hi"]).alias("hi"))
    else:
        bounds = materialize(bounds, "histogram-bounds")
        vals = df.select(*g, v.alias("_v"))
        x = vals.join(bounds, on=keys, how="inner")
    raw = F.floor((F.col("_v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo"))))
    x = x.withColumn("bin", (F.least(raw, F.lit(bins - 1)) + 1).cast("int"))
    grid = bounds.select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    counts = x.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    out = grid.join(counts, on=[*keys, "bin"], how="left")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return out.select(*g, "bin", F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                      (F.col("lo") + (F.col("bin") - 1) * width).alias("edge_lo"),
                      (F.col("lo") + F.col("bin") * width).alias("edge_hi"))


def histogram_event(hist: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """FN14: nested ``{counts, edges}`` struct per group (edges = bins + 1 values)."""
    g = list(group_cols)
    agg = hist.groupBy(*g).agg(
        F.array_sort(F.collect_list(F.struct("bin", "count", "edge_lo", "edge_hi"))).alias("_h"))
    counts = F.transform("_h", lambda s: s["count"].cast("double"))
    edges = F.concat(F.transform("_h", lambda s: s["edge_lo"]), F.array(F.element_at("_h", -1)["edge_hi"]))
    return agg.select(*g, F.struct(counts.alias("counts"), edges.alias("edges")).alias("hist"))


def unit_norm(df: DataFrame, vec_col: str = "vec", eps: float = 1e-5) -> DataFrame:
    """AGG6: per row centre and divide by std_{n-1} + eps; carries mu and sd."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    n = F.size(v)
    mu = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    out = df.withColumn("_v", v).withColumn("mu", mu)
    sd = F.sqrt(F.aggregate(F.col("_v"), F.lit(0.0), lambda a, x: a + (x - F.col("mu")) * (x - F.col("mu")))
                / (F.size("_v") - 1))
    out = out.withColumn("sd", sd)
    return out.withColumn("normed", F.transform("_v", lambda x: (x - F.col("mu")) / (F.col("sd") + F.lit(eps)))) \
              .drop("_v")


def unit_norm_undo(df: DataFrame, normed_col: str = "normed") -> DataFrame:
    """AGG6 inverse: y * sd + mu (without the eps)."""
    return df.withColumn("restored", F.transform(normed_col, lambda y: y * F.col("sd") + F.col("mu")))


def weighted_average(long: DataFrame, weight_col: str, *, dim_col: str = "dim", value_col: str = "x",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """AGG10: sum(w x) / sum(w) per dimension."""
    return long.groupBy(*group_cols, dim_col).agg(
        F.try_divide(F.sum(F.col(weight_col) * F.col(value_col)), F.sum(weight_col)).alias("wavg"))


def cohen_kappa(pairs: DataFrame, l1: str = "r1", l2: str = "r2") -> DataFrame:
    """AGG14: kappa = (p_o - p_e) / (1 - p_e) over rows where both labels exist.

    Works on the contingency table (labels x labels rows), never on rows.
    """
    valid = pairs.where(F.col(l1).isNotNull() & F.col(l2).isNotNull())
    ct = valid.groupBy(l1, l2).agg(F.count(F.lit(1)).alias("c"))
    # marginals without a join: each cell counts once for its row label and once
    # for its column label; one more aggregation gives n, agreement and sum m1*m2
    rows_ = ct.select(F.col(l1).alias("label"), F.col("c").alias("m1"), F.lit(0).cast("bigint").alias("m2"),
                      F.col("c").alias("n"), F.when(F.col(l1) == F.col(l2), F.col("c")).otherwise(0).alias("agree"))
    cols_ = ct.select(F.col(l2).alias("label"), F.lit(0).cast("bigint").alias("m1"), F.col("c").alias("m2"),
                      F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("agree"))
    per_label = rows_.unionByName(cols_).groupBy("label").agg(
        F.sum("m1").alias("m1"), F.sum("m2").alias("m2"), F.sum("n").alias("n"), F.sum("agree").alias("agree"))
    j = per_label.agg(F.sum("n").alias("n"), F.sum("agree").alias("agree"),
                      F.sum(F.col("m1") * F.col("m2")).alias("mm"))
    p_o = F.try_divide(F.coalesce(F.col("agree"), F.lit(0)).cast("double"), F.col("n"))
    p_e = F.try_divide(F.coalesce(F.col("mm"), F.lit(0)).cast("double"), F.col("n") * F.col("n"))
    return j.select(F.col("n").cast("bigint").alias("n"), p_o.alias("p_o"), p_e.alias("p_e"),
                    F.try_divide(p_o - p_e, F.lit(1.0) - p_e).alias("kappa"))


def rater_accuracy(df: DataFrame, rater_cols: Sequence[str], truth_col: str) -> DataFrame:
    """AGG15: share of correct choices per rater over its valid rows; empty -> 0."""
    parts = []
    for r in rater_cols:
        ok = F.when(F.col(r).isNotNull(), (F.col(r) == F.col(truth_col)).cast("double"))
        parts.append(df.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("accuracy"),
                            F.count(F.col(r)).alias("n")).withColumn("rater", F.lit(r)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def condition_stats(df: DataFrame, condition_cols: Sequence[str], value_col: str) -> DataFrame:
    """AGG16: mean and population std of an outcome per condition across seeds."""
    return df.groupBy(*condition_cols).agg(F.avg(value_col).alias("mean"),
                                           F.stddev_pop(value_col).alias("std"),
                                           F.count(F.lit(1)).alias("n"))


def mean_correctness(df: DataFrame, correct_col: str = "correct") -> DataFrame:
    """AGG17: correct / evaluated; 0 when nothing was evaluated."""
    return df.agg(F.coalesce(F.avg(F.col(correct_col).cast("double")), F.lit(0.0)).alias("mean_correctness"),
                  F.count(F.lit(1)).alias("n_evaluated"))


def settings_average(df: DataFrame, hash_col: str, value_col: str, repeats: int = 4,
                     true_mean: bool = False) -> DataFrame:
    """AGG18: sum per setting hash divided by a fixed repeat count (or a true mean)."""
    agg = F.avg(value_col) if true_mean else F.sum(value_col) / F.lit(float(repeats))
    return df.groupBy(hash_col).agg(agg.alias("average"))


def run_summary(logs: DataFrame, *, run_col: str = "run", ts_col: str = "timestamp", step_col: str = "step",
                value_col: str = "value", first_n: int = 40) -> DataFrame:
    """AGG19: elapsed = last - first time, mean value, last step, and mean / population
    std of the first n rows of each run."""
    main = logs.groupBy(run_col).agg(
        (F.max(ts_col) - F.min(ts_col)).alias("elapsed"), F.avg(value_col).alias("mean_value"),
        F.max_by(step_col, ts_col).alias("last_step"))
    head = logs.where(F.col(step_col) <= first_n).groupBy(run_col).agg(
        F.avg(value_col).alias(f"mean_first{first_n}"), F.stddev_pop(value_col).alias(f"std_first{first_n}"))
    return main.join(head, on=run_col, how="left")


def position_range_mean(df: DataFrame, group_cols: Sequence[str], pos_col: str, value_col: str,
                        lo: int = 128, hi: int = 512) -> DataFrame:
    """AGG23: mean over positions < lo versus positions >= hi."""
    return df.groupBy(*group_cols).agg(
        F.avg(F.when(F.col(pos_col) < lo, F.col(value_col))).alias(f"mean_below_{lo}"),
        F.avg(F.when(F.col(pos_col) >= hi, F.col(value_col))).alias(f"mean_from_{hi}"))


def trial_stats(df: DataFrame, setting_cols: Sequence[str], value_col: str, *, bytes_col: str,
                start_col: str, end_col: str) -> DataFrame:
    """AGG24: mean / population std per setting (7 places), total MiB, MiB/s, mean time."""
    dur = F.col(end_col) - F.col(start_col)
    return df.groupBy(*setting_cols).agg(
        F.round(F.avg(value_col), 7).alias("mean"), F.round(F.stddev_pop(value_col), 7).alias("std"),
        (F.sum(bytes_col) / F.lit(1048576.0)).alias("total_mib"),
        F.try_divide(F.sum(bytes_col) / F.lit(1048576.0), F.max(end_col) - F.min(start_col)).alias("mib_per_s"),
        F.avg(dur).alias("mean_time"))


def pivot_settings(df: DataFrame, row_col: str, col_col: str, value_col: str, values: Sequence) -> DataFrame:
    """AGG25: rows -> (row key x column key) matrix; 0 where absent.

    Pivot values are passed explicitly (no extra distinct job)."""
    p = df.groupBy(row_col).pivot(col_col, list(values)).agg(F.first(value_col))
    return p.fillna(0, subset=[str(v) for v in values])


def pivot_metrics(logs: DataFrame, id_cols: Sequence[str], step_col: str, metric_cols: Sequence[str], *,
                  bucket_steps: int = 1 << 16) -> DataFrame:
    """AGG22: every metric of every run as an ordered series (run, metric, idx, step, value).

    The series stays in long form with its position ``idx`` (a bucketed running
    index over steps), so a long run is never gathered into one list."""
    from actlens.operators.ordering import running_index
    long = unpivot_metrics(logs, [*id_cols, step_col], metric_cols)
    return running_index(long, [step_col], group_cols=[*id_cols, "metric"],
                         bucket=F.floor(F.col(step_col) / F.lit(bucket_steps)), name="idx")


def unpivot_metrics(df: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """SNK7/AGG22: numeric metric columns -> (ids, metric, value) rows; nulls dropped."""
    cols = [F.col(c).cast("double").alias(c) for c in metric_cols]
    x = df.select(*id_cols, *cols)
    return x.unpivot(list(id_cols), list(metric_cols), "metric", "value").where(F.col("value").isNotNull())
