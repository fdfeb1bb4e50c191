"""Projections, filters and reshaping (PRJ1-PRJ15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_sequences(df: DataFrame, sample_col: str = "sample_id", pos_col: str = "pos",
                 vec_col: str = "vec") -> DataFrame:
    """Group (sample, pos, vec) rows into one sequence per sample (bounded by seq len)."""
    return df.groupBy(sample_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(vec_col).alias("v")))),
                    lambda s: s["v"]).alias("seq"))


def flatten_positions(df: DataFrame, d_in: int | None = None, *, seq_col: str = "seq",
                      vec_col: str = "vec", sample_col: str = "sample_id") -> DataFrame:
    """PRJ1: (n, seq, d) -> (n*seq, d); position restarts per sample; first d_in dims.

    A flat input (``vec_col`` present, no ``seq_col``) gets position 0.
    """
    if seq_col in df.columns:
        out = df.select(sample_col, F.posexplode(seq_col).alias("pos", "vec"))
    elif vec_col in df.columns:
        out = df.select(sample_col, F.lit(0).alias("pos"), F.col(vec_col).alias("vec"))
    else:
        raise ValueError("input needs a sequence or a vector column")
    if d_in is not None:
        out = out.withColumn("vec", F.slice("vec", 1, d_in))
    return out


def skip_first(df: DataFrame, n: int, pos_col: str = "pos") -> DataFrame:
    """PRJ2: drop the first n positions and renumber from 0."""
    return df.where(F.col(pos_col) >= n).withColumn(pos_col, (F.col(pos_col) - F.lit(n)).cast("int"))


def split_token_id(df: DataFrame, vec_col: str = "vec") -> DataFrame:
    """PRJ3: the last vector element carries the token id; strip it."""
    return df.withColumn("token_id", F.element_at(vec_col, -1).cast("bigint")) \
             .withColumn(vec_col, F.slice(vec_col, 1, F.size(vec_col) - 1))


def cls_only(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """PRJ4: keep position 0 (class token)."""
    return df.where(F.col(pos_col) == 0)


def first_features(df: DataFrame, n: int, feature_col: str = "feature") -> DataFrame:
    """PRJ5: keep the first n features (a pushed filter on long latents)."""
    return df.where(F.col(feature_col) < n)


def to_long(df: DataFrame, key_cols: Sequence[str], vec_col: str = "vec",
            index_name: str = "feature", value_name: str = "value") -> DataFrame:
    """PRJ6: sample-major vectors -> (keys, index, value) rows."""
    return df.select(*key_cols, F.posexplode(vec_col).alias(index_name, value_name)) \
             .withColumn(value_name, F.col(value_name).cast("double"))


def long_texts(df: DataFrame, min_chars: int, n: int, *, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """PRJ7: first n texts longer than min_chars in id order; fewer -> error."""
    out = df.where(F.length(text_col) > min_chars).orderBy(id_col).limit(n)
    got = out.count()
    if got < n:
        raise ValueError(f"only {got} texts longer than {min_chars} characters, {n} wanted")
    return out


def mask_rows(df: DataFrame, mask: Column | None = None) -> DataFrame:
    """PRJ8/UDF3: overridable row mask (identity by default)."""
    return df if mask is None else df.where(mask)


def select_events(logs: DataFrame, name: str, value_col: str, event_col: str = "event") -> DataFrame:
    """PRJ9: events of one type with the value present."""
    return logs.where((F.col(event_col) == name) & F.col(value_col).isNotNull())


def text_contains(df: DataFrame, s: str, text_col: str = "text") -> DataFrame:
    """PRJ10: rows whose text holds a substring."""
    return df.where(F.contains(F.col(text_col), F.lit(s)))


MIB = 1024 * 1024  # fixed value: bytes per MiB


def threshold_report(df: DataFrame, rate_col: str, threshold: float,
                     size_cols: Sequence[str]) -> DataFrame:
    """PRJ11: rows with rate > threshold; sizes in MiB to 2 places, rate to 0 (half-even)."""
    out = df.where(F.col(rate_col) > threshold)
    for c in size_cols:
        out = out.withColumn(f"{c}_mib", F.bround(F.col(c) / F.lit(MIB), 2))
    return out.withColumn(rate_col, F.bround(rate_col, 0))


def range_filter(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """PRJ12: strict two-sided filter lo < x < hi."""
    return df.where((F.col(col) > lo) & (F.col(col) < hi))


def not_in_nullsafe(col: str, values: Sequence) -> Column:
    """PRJ12: null-safe ``x not in [None, *values]``."""
    return F.col(col).isNotNull() & ~F.col(col).isin(*values)


def pad_or_cut(df: DataFrame, max_len: int, tokens_col: str = "tokens") -> DataFrame:
    """PRJ13: truncate to max_len and require every row reached it (no padding)."""
    out = df.withColumn(tokens_col, F.slice(tokens_col, 1, max_len))
    return out.withColumn("_ok", F.assert_true(F.size(tokens_col) == max_len,
                                               F.lit(f"sequence shorter than {max_len}"))).drop("_ok")


def sample_slice(df: DataFrame, n_rows: int, n_dims: int, order_cols: Sequence[str],
                 vec_col: str = "vec") -> DataFrame:
    """PRJ14: first n rows in order and first n dims, for diagnostics. The vectors are
    cut first and every task keeps its n first rows: no index over the table."""
    return df.withColumn(vec_col, F.slice(vec_col, 1, n_dims)).orderBy(*order_cols).limit(n_rows)


def position_profile(df: DataFrame, group_cols: Sequence[str], pos_col: str, value_col: str,
                     max_pos: int = 20) -> DataFrame:
    """PRJ15: mean over texts for the first positions per group."""
    return df.where(F.col(pos_col) < max_pos).groupBy(*group_cols, pos_col) \
             .agg(F.avg(value_col).alias(f"mean_{value_col}"))
