"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

All stages but the last return the columns of their documents. Inside a stage a
document without an id is named by a hash of its values; rows that repeat an id
are documents of their own in the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm import language, mixing, ngram_join, pieces, quality
from actlens.llm.common import fold_of, materialize, prepare, read_table, small_or_none

LEAST_LANGUAGE_SCORE = 0.25
MAX_BROADCAST_IDS = 500_000


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", "lang", "source")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found: not ``und``, score 0.25 or more."""
    prepare(spark)
    model = language.fit_languages(docs, fold_of(F.col("doc_id"), 4) != 2)
    return language.predict_languages(docs, model, keep=(language.UNDETERMINED, LEAST_LANGUAGE_SCORE))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the rule ensemble predicts as good (score 0.3 or more)."""
    prepare(spark)
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    good = model.column(quality.free_prefix(docs.columns)) >= quality.THRESHOLD
    return quality.with_stats(docs).filter(good).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each n-gram join component (of rows
    that repeat this id, the one with the smallest text, then other columns)."""
    prepare(spark)
    rows = materialize(_named(docs).withColumn("_row", F.monotonically_increasing_id()), "stage-rows")
    groups = materialize(ngram_join.ngram_components(rows.select(F.col("_row").alias("doc_id"), "text"))
                         .select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
                         .join(rows.select("_row", "_id"), "_row"), "stage-groups")
    held = groups.groupBy("_group", "_id").agg(F.count("*").alias("n"), F.min("_row").alias("_row"))
    first = materialize(held.groupBy("_group").agg(F.min(F.struct("_id", "n", "_row")).alias("m"))
                        .select("_group", "m.*"), "stage-first")
    winners = first.filter("n = 1").select("_row")
    again = first.filter("n > 1").select("_group", "_id")
    if not again.isEmpty():
        tied = groups.join(small_or_none(again, MAX_BROADCAST_IDS), ["_group", "_id"]).select("_row", "_group")
        values = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")], "_row")
        winners = winners.union(tied.join(rows, "_row").groupBy("_group").agg(F.min(values).alias("m")).select("m._row"))
    gone = materialize(groups.select("_row").join(winners, "_row", "left_anti"), "stage-gone")
    return rows.join(small_or_none(gone, MAX_BROADCAST_IDS), "_row", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times): the share of its
    words that the source schedule takes, rounded; only the document at the end
    of a source's quota is ever taken in part. A document without words is taken
    0 times."""
    prepare(spark)
    named = _named(docs)
    mix = mixing.mix_sources(named.select(F.col("_id").alias("doc_id"), "source", "text"))
    times = (mix.groupBy(F.col("doc_id").alias("_id"))
             .agg(F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias("_times")).filter("_times > 0"))
    return (named.join(times, "_id").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*docs.columns))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, with the check that they decode to its text."""
    prepare(spark)
    return pieces.encode_documents(docs, pieces.load_pieces())


STAGES = [("language ID", language_stage), ("quality classifier", quality_stage),
          ("n-gram join", near_duplicate_stage), ("source mix", mixing_stage), ("pieces", piece_stage)]
