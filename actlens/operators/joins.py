"""Joins (JOI1-JOI10).

Lookup tables (token vectors, dictionaries) are joined by key; Spark's AQE
turns a join into a broadcast when the runtime size of a side is below
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and splits skewed
partitions otherwise, so no side is broadcast on faith.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(seq: DataFrame, table: DataFrame, key: str = "token_id", *, check_missing: bool = True) -> DataFrame:
    """JOI1: replace each id by its vector; a missing id is an error, raised by the
    same join that looks the ids up."""
    if not check_missing:
        return seq.join(table, on=key, how="inner")
    found = seq.join(table.withColumn("__found", F.lit(True)), on=key, how="left")
    lost = F.raise_error(F.concat(F.lit("id "), F.coalesce(F.col(key).cast("string"), F.lit("null")),
                                  F.lit(" has no entry in the lookup table"))).cast("boolean")
    return found.where(F.coalesce(F.col("__found"), lost)).drop("__found")


def lookup_augment(recon: DataFrame, table: DataFrame, *, key: str = "token_id", recon_col: str = "recon",
                   vec_col: str = "vec", scale: float = 0.5) -> DataFrame:
    """JOI2: output + scale * token vector; rows without a token id are unchanged."""
    j = recon.join(table.select(key, F.col(vec_col).alias("_tok")), on=key, how="left")
    added = F.zip_with(recon_col, "_tok", lambda a, b: a + F.lit(scale) * b)
    return j.withColumn(recon_col, F.when(F.col("_tok").isNull(), F.col(recon_col)).otherwise(added)).drop("_tok")


def rater_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("idx1", "idx2")) -> DataFrame:
    """JOI3: pairs rated by both sides (inner join on the pair key)."""
    return a.join(b, on=list(keys), how="inner")


def exclude_join(candidates: DataFrame, *excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOI4: candidates minus every excluded set (left anti joins)."""
    out = candidates
    for e in excluded:
        out = out.join(e.select(*keys), on=list(keys), how="left_anti")
    return out


def feature_pairs(features: DataFrame, n: int, seed: int, col: str = "feature") -> DataFrame:
    """JOI5: n distinct unordered pairs (f1 < f2) of features, chosen by a seeded permutation.

    Features are ranked by md5(seed:feature) (a permutation perm of m features);
    round j = 1, 2, ... pairs perm[i] with perm[(i + j) mod m]. Rounds j < m/2
    give m new pairs each, round j = m/2 (m even) gives m/2; the first n pairs
    in (round, i) order are returned. Only ceil(n / m) rounds are generated:
    the m(m-1)/2 pairs are never formed. Fewer possible pairs than n -> ValueError.
    """
    from actlens.operators.ordering import running_index, seeded_key
    f = features.select(F.col(col).alias("_f")).distinct()
    m = f.count()
    if m * (m - 1) // 2 < n:
        raise ValueError(f"only {m * (m - 1) // 2} pairs possible, {n} wanted")
    perm = running_index(f.withColumn("_h", seeded_key(["_f"], seed)), ["_h", "_f"],
                         bucket=F.substring("_h", 1, 2), name="_i")
    rounds = -(-n // m) + 1
    a = perm.select(F.col("_f").alias("_a"), F.col("_i").alias("_ai")) \
            .withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    a = a.withColumn("_bi", (F.col("_ai") + F.col("_j")) % F.lit(m))
    b = perm.select(F.col("_f").alias("_b"), F.col("_i").alias("_bi"))
    pairs = a.join(b, on="_bi", how="inner") \
             .where(~((F.lit(2) * F.col("_j") == F.lit(m)) & (F.col("_ai") >= F.col("_j"))) &
                    (F.lit(2) * F.col("_j") <= F.lit(m)))
    out = pairs.select(F.least("_a", "_b").alias("f1"), F.greatest("_a", "_b").alias("f2"), "_j", "_ai")
    return out.orderBy("_j", "_ai").limit(n).select("f1", "f2")


def sweep_grid(base: DataFrame, axes: dict[str, Sequence]) -> DataFrame:
    """JOI6: product of option lists over a base configuration.

    Each axis is a short list of option values; every base row is expanded
    with ``explode(array(...))`` per axis (a projection, no join). The grid has
    rows(base) x prod(len(options)) rows."""
    out = base
    for name, options in axes.items():
        if not options:
            raise ValueError(f"axis {name!r} has no options")
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return out


def similarity_vs_loss(stats: DataFrame, losses: DataFrame, *, layer: int, key: str = "strategy") -> DataFrame:
    """JOI10: per-strategy mean similarity of one layer next to the minimum loss."""
    s = stats.where(F.col("layer") == layer).select(key, F.round("mean", 3).alias("mean_cos"))
    return s.join(losses, on=key, how="inner")
