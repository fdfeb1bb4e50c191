"""Ordering, indexing, batching, shuffling and limits (PRE1, BAT*, SHF*,
SRT1, TOP*, TAIL1, SRC12).

Running indexes are computed with a two-level prefix sum so that no window
ever spans a whole table or a whole hot group:

1. slices of about equal row counts along all order columns (or a given
   monotone *bucket* of the order key) split every group into bounded parts;
2. per (group, bucket) row counts are aggregated map-side (small table);
3. the counts are cumulated per group over buckets (window over the small
   table only) and joined back (AQE turns the join into a broadcast when the
   runtime size is small);
4. a row number inside each (group, bucket) slice finishes the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.session import materialize

ColLike = str | Column


def _c(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


ROWS_PER_SLICE = 1 << 20


def slice_rows(df: DataFrame, order: Sequence[Column], n_slices: int, name: str) -> DataFrame:
    """Cuts a table into ``n_slices`` slices of about equal row counts along all
    order columns (so neither an outlier nor a heavy leading value makes a large
    slice) and numbers them in order. The result is written once: counting and
    numbering must see the same cut."""
    return materialize(df.repartitionByRange(n_slices, *order)
                       .withColumn(name, F.spark_partition_id().cast("bigint")), "ordering-slices")


def running_index(df: DataFrame, order_cols: Sequence[ColLike], *,
                  group_cols: Sequence[str] = (), bucket: Column | None = None,
                  name: str = "idx", base: int = 0, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """0-based (or ``base``-based) position of each row inside its group.

    Without a ``bucket`` the rows are cut into slices of about
    ``rows_per_slice`` rows; one that fits into a single slice is numbered
    directly. A given ``bucket`` must be non-decreasing along ``order_cols``
    inside a group.
    """
    order = [_c(c) for c in order_cols]
    g = list(group_cols)
    b = "__bucket"
    if bucket is None:
        n_slices = -(-df.count() // rows_per_slice)
        if n_slices <= 1:
            w = Window.partitionBy(*g).orderBy(*order)
            return df.withColumn(name, (F.row_number().over(w) - F.lit(1 - base)).cast("bigint"))
        x = slice_rows(df, order, n_slices, b)
    else:
        x = df.withColumn(b, bucket)
    counts = x.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__n"))
    # (the counts and the window read the same ``x``: AQE reuses its shuffle stage)
    w_off = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, b, F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    w_in = Window.partitionBy(*g, b).orderBy(*order)
    x = x.withColumn("__rn", F.row_number().over(w_in))
    out = x.join(offsets, on=[*g, b], how="inner")
    out = out.withColumn(name, (F.col("__off") + F.col("__rn") - F.lit(1 - base)).cast("bigint"))
    return out.drop(b, "__off", "__rn")


def global_index(df: DataFrame, order_cols: Sequence[ColLike], *,
                 bucket: Column | None = None, name: str = "global_index") -> DataFrame:
    """PRE1: 0-based running index over the whole table in ``order_cols`` order."""
    return running_index(df, order_cols, bucket=bucket, name=name)


def rebatch(df: DataFrame, n: int, order_cols: Sequence[ColLike], *,
            keep_tail: bool = True, bucket: Column | None = None) -> DataFrame:
    """BAT1: cut rows into batches of ``n`` across block borders."""
    if n < 1:
        raise ValueError("batch size must be positive")
    total = None if keep_tail else df.count()
    return _cut(global_index(df, order_cols, bucket=bucket, name="_gi"), n, total)


def _cut(x: DataFrame, n: int, total: int | None) -> DataFrame:
    """Batches of ``n`` along the index ``_gi``; with a ``total`` only the full ones."""
    x = x.withColumn("batch_id", F.floor(F.col("_gi") / F.lit(n)).cast("bigint")) \
         .withColumn("row_in_batch", (F.col("_gi") % F.lit(n)).cast("bigint"))
    if total is not None:
        x = x.where(F.col("batch_id") < F.lit(total // n))
    return x.drop("_gi")


def rebatch_per_file(df: DataFrame, n: int, file_col: str, row_col: str) -> DataFrame:
    """BAT2: inside each file keep floor(rows/n) full batches, drop the rest."""
    per_file = Window.partitionBy(file_col)
    x = df.withColumn("_rows", F.count(F.lit(1)).over(per_file))
    x = x.withColumn("batch_in_file", F.floor(F.col(row_col) / F.lit(n)).cast("bigint"))
    return x.where(F.col("batch_in_file") < F.floor(F.col("_rows") / F.lit(n))).drop("_rows")


def stop_after(df: DataFrame, n_tokens: int, batch_size: int, batch_col: str = "batch_id") -> DataFrame:
    """BAT3: consume whole batches until at least n_tokens were seen."""
    return df.where(F.col(batch_col) < F.lit(-(-n_tokens // batch_size)))


def sample_cap(df: DataFrame, n_samples: int, batch_size: int, batch_col: str = "batch_id") -> DataFrame:
    """BAT4: generation stops after the first batch i with i*batch >= n."""
    return df.where(F.col(batch_col) <= F.lit(-(-n_samples // batch_size)))


def row_cap(df: DataFrame, n: int, batch_col: str = "batch_id", *, bucket_width: int = 1 << 16) -> DataFrame:
    """BAT5: keep whole batches while the rows before them are <= n.

    The rows-before count is a bucketed prefix sum over the per-batch table
    (one row per batch), so no window holds all batches."""
    counts = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("_bn"))
    before = prefix_sum(counts, [batch_col], "_bn", bucket=F.floor(F.col(batch_col) / F.lit(bucket_width)),
                        name="_before")
    keep = before.where(F.col("_before") <= F.lit(n)).select(batch_col)
    return df.join(keep, on=batch_col, how="left_semi")


def seeded_key(cols: Sequence[ColLike], seed: int) -> Column:
    """SHF3: stable pseudo-random key; never ``rand()`` (not stable on retry).

    Hex MD5 of ``seed:key...``: the same text on any engine, uniform prefixes.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))


def shuffle_rows(df: DataFrame, key_cols: Sequence[ColLike], seed: int, *,
                 buffer: int | None = None) -> DataFrame:
    """SHF1: deterministic full shuffle order column ``shuffle_key``."""
    if buffer is not None and buffer < 2:
        raise ValueError("buffer must hold at least 2 batches")
    return df.withColumn("shuffle_key", seeded_key(key_cols, seed))


def shuffle_batches(df: DataFrame, key_cols: Sequence[ColLike], seed: int, batch_rows: int,
                    *, keep_tail: bool = False, buffer_rows: int | None = None,
                    index_cols: Sequence[str] | None = None) -> DataFrame:
    """SHF1/SHF2: shuffle then cut exact batches; short tail dropped unless asked.

    With ``buffer_rows`` the permutation stays inside consecutive windows of
    ``buffer_rows`` rows of the source order (bounded variant). All windows but the
    last are full, so a row's place is its window's first place plus its rank inside
    the window: the source order is the only index over the table.
    """
    if buffer_rows is not None:
        if buffer_rows < 2 * batch_rows:
            raise ValueError("buffer must hold at least 2 batches")
        src = global_index(df, index_cols or list(key_cols), name="_src")
        keyed = src.withColumn("_win", F.floor(F.col("_src") / F.lit(buffer_rows)).cast("bigint")) \
                   .withColumn("shuffle_key", seeded_key(key_cols, seed)).drop("_src")
        inside = Window.partitionBy("_win").orderBy("shuffle_key", *[_c(c) for c in key_cols])
        placed = keyed.withColumn("_gi", F.col("_win") * F.lit(buffer_rows) + F.row_number().over(inside) - F.lit(1))
        return _cut(placed.drop("_win"), batch_rows, None if keep_tail else df.count())
    keyed = df.withColumn("shuffle_key", seeded_key(key_cols, seed))
    # the hash is uniform: its 4-hex-digit prefix gives 65,536 balanced buckets
    bucket = F.substring("shuffle_key", 1, 4)
    return rebatch(keyed, batch_rows, ["shuffle_key", *key_cols], keep_tail=keep_tail, bucket=bucket)


def hash_shard(path: Column, n: int) -> Column:
    """SHF4: int(sha1(path), 16) % n, computed by folding the 40 hex digits."""
    digits = F.transform(F.split(F.sha1(path), ""), lambda d: F.conv(d, 16, 10).cast("bigint"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    return F.aggregate(digits, F.lit(0).cast("bigint"),
                       lambda acc, d: (acc * F.lit(16) + d) % F.lit(n)).cast("int")


def take_first(df: DataFrame, n: int, order_cols: Sequence[ColLike]) -> DataFrame:
    """SRC12: first n records in source order (TakeOrderedAndProject)."""
    return df.orderBy(*[_c(c) for c in order_cols]).limit(n)


def top_n(df: DataFrame, n: int, order_cols: Sequence[Column]) -> DataFrame:
    """TOP2: best n rows by a sort key (a top-k report)."""
    return df.orderBy(*order_cols).limit(n)


def last_n_mean(df: DataFrame, group_cols: Sequence[str], step_col: str,
                value_cols: Sequence[str], n: int) -> DataFrame:
    """TAIL1: mean of the last n logged values per group.

    ``row_number() <= n`` over a descending order is planned as a
    WindowGroupLimit, so each map task keeps only n rows per group before the
    shuffle: a hot group never reaches one task whole.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col(step_col).desc())
    tail = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return tail.groupBy(*group_cols).agg(*[F.avg(c).alias(f"{c}_last{n}") for c in value_cols])


def prefix_sum(df: DataFrame, order_cols: Sequence[ColLike], value_col: str, *,
               group_cols: Sequence[str] = (), bucket: Column, name: str = "prefix",
               inclusive: bool = False) -> DataFrame:
    """Running sum of ``value_col`` inside each group in order (exclusive by default).

    Same two-level scheme as ``running_index``: bucket totals are summed map-side
    and cumulated over the small (group, bucket) table, then a window inside
    each bucket finishes the sum.
    """
    order = [_c(c) for c in order_cols]
    g = list(group_cols)
    b = "__bucket"
    x = df.withColumn(b, bucket)
    tot = x.groupBy(*g, b).agg(F.sum(value_col).alias("__t"))
    w_off = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*g, b, F.coalesce(F.sum("__t").over(w_off), F.lit(0)).alias("__off"))
    end = 0 if inclusive else -1
    w_in = Window.partitionBy(*g, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    x = x.withColumn("__in", F.coalesce(F.sum(value_col).over(w_in), F.lit(0)))
    out = x.join(offs, on=[*g, b], how="inner")
    return out.withColumn(name, F.col("__off") + F.col("__in")).drop(b, "__off", "__in")
