"""Feature reports, predictions, evaluations, side-car files, similarity tables
(SRC9, SRC10, SRC11, SRC15, SNK8, SNK10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_SCHEMA = T.StructType([
    T.StructField("feature", T.IntegerType()), T.StructField("indices", T.ArrayType(T.LongType())),
    T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("file_paths", T.ArrayType(T.StringType()))])


def write_feature_reports(top: DataFrame, path: str, *, activated: DataFrame | None = None,
                          sample_col: str = "sample_index", path_col: str = "path") -> None:
    """SNK8: one JSON record per feature: indices, values, file_paths of its top-k
    (k entries each). The activated samples (indices_gt_zero) are written next to
    it as a long table in ranges of (feature, sample): a reader of one feature skips
    files by their statistics, no feature has a folder of its own, and a frequent
    one fills several files."""
    rep = top.groupBy("feature").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.col(sample_col).alias("i"), F.col("value").alias("v"), F.col(path_col).alias("p")))).alias("_s"))
    rep = rep.select("feature", F.transform("_s", lambda s: s["i"]).alias("indices"),
                     F.transform("_s", lambda s: s["v"]).alias("values"),
                     F.transform("_s", lambda s: s["p"]).alias("file_paths"))
    rep.write.mode("overwrite").json(f"{path}/reports")
    if activated is not None:
        order = ["feature", *[c for c in activated.columns if c != "feature"]]
        activated.repartitionByRange(*order).sortWithinPartitions(*order) \
                 .write.mode("overwrite").parquet(f"{path}/indices_gt_zero")


def read_feature_reports(spark: SparkSession, path: str, *, k: int = 9, features: DataFrame | None = None,
                         strict: bool = False) -> DataFrame:
    """SRC10: reports as rows (feature, rank, index, value, path). A feature must own
    exactly k samples; ``features`` keeps only wanted ones (missing are skipped,
    or an error in strict mode)."""
    rep = spark.read.schema(REPORT_SCHEMA).json(f"{path}/reports")
    rep = rep.withColumn("_ok", F.assert_true((F.size("indices") == k) & (F.size("values") == k),
                                              F.lit(f"a feature report must hold {k} samples")))
    if features is not None:
        if strict:
            missing = features.join(rep, on="feature", how="left_anti").limit(1).collect()
            if missing:
                raise FileNotFoundError(f"no report for feature {missing[0]['feature']}")
        rep = rep.join(features, on="feature", how="left_semi")
    z = F.arrays_zip(F.col("indices").alias("index"), F.col("values").alias("value"), F.col("file_paths").alias("path"))
    out = rep.select("feature", "_ok", F.posexplode(z).alias("_r", "s"))
    return out.select("feature", (F.col("_r") + 1).cast("bigint").alias("rank"), "s.index", "s.value", "s.path")


PRED_SCHEMA = T.StructType([T.StructField("idx1", T.LongType()), T.StructField("idx2", T.LongType()),
                            T.StructField("prediction", T.LongType()), T.StructField("seq", T.LongType())])


def read_predictions(spark: SparkSession, path: str, *, multiline: bool = False) -> DataFrame:
    """SRC9: predictions keyed by (idx1, idx2); the last write (highest seq) wins."""
    df = spark.read.schema(PRED_SCHEMA).option("multiLine", multiline).json(path)
    w = Window.partitionBy("idx1", "idx2").orderBy(F.col("seq").desc_nulls_last())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


EVAL_VALUE = T.StructType([T.StructField("idx1", T.LongType()), T.StructField("idx2", T.LongType()),
                           T.StructField("correct", T.BooleanType()), T.StructField("selected_index", T.LongType()),
                           T.StructField("correct_index", T.LongType())])
EVAL_SCHEMA = T.StructType([T.StructField("evaluations", T.MapType(T.StringType(), EVAL_VALUE)),
                            T.StructField("seq", T.LongType())])


def write_evaluations(detail: DataFrame, path: str, *, total_time: float = 0.0) -> DataFrame:
    """SNK10: evaluations map (one record per pair key) plus a one-row summary
    (mean_correctness, total_time, all_pairs); returns the summary."""
    rec = detail.select(F.create_map(F.concat_ws("_", "idx1", "idx2"),
                                     F.struct("idx1", "idx2", "correct", "selected_index", "correct_index")).alias("evaluations"),
                        F.col("seq"))
    rec.write.mode("overwrite").json(f"{path}/evaluations")
    summary = detail.agg(F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("mean_correctness"),
                         F.count(F.lit(1)).alias("all_pairs")).withColumn("total_time", F.lit(float(total_time)))
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """SRC9: explode the pair-key map; a key written twice keeps its last write."""
    df = spark.read.schema(EVAL_SCHEMA).json(f"{path}/evaluations")
    e = df.select("seq", F.explode("evaluations").alias("pair_key", "v"))
    w = Window.partitionBy("pair_key").orderBy(F.col("seq").desc_nulls_last())
    e = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return e.select("pair_key", "v.*")


def zip_sidecars(values: DataFrame, names: DataFrame, *, file_col: str = "_file",
                 row_col: str = "row_in_file", key_pattern: str = r"_(\d+)\.") -> DataFrame:
    """SRC11: pair value files with name files by the batch number in their file
    names, then rows by position inside each file; no positional guess across files."""
    v = values.withColumn("batch_key", F.regexp_extract(F.col(file_col), key_pattern, 1).cast("bigint")).drop(file_col)
    n = names.withColumn("batch_key", F.regexp_extract(F.col(file_col), key_pattern, 1).cast("bigint")).drop(file_col)
    return v.join(n, on=["batch_key", row_col], how="inner")


COS_LINE_SCHEMA = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("text", T.LongType()),
                                T.StructField("cos", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])


def read_cosine_tables(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: similarity tables -> (layer, strategy, text, pos, cos).

    Line format: {layer, text, cos: {strategy: [per position]}}; absent layers
    simply have no lines."""
    df = spark.read.schema(COS_LINE_SCHEMA).json(path)
    e = df.select("layer", "text", F.explode("cos").alias("strategy", "series"))
    return e.select("layer", "strategy", "text", F.posexplode("series").alias("pos", "cos"))


def read_legacy_cosine_table(spark: SparkSession, path: str, layer: int) -> DataFrame:
    """SRC15 legacy: one JSON object per layer file, map<strategy, array<array<double>>>."""
    schema = T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.DoubleType())))
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.from_json("value", schema).alias("m"))
    e = m.select(F.explode("m").alias("strategy", "texts"))
    e = e.select("strategy", F.posexplode("texts").alias("text", "series"))
    return e.select(F.lit(layer).alias("layer"), "strategy", "text", F.posexplode("series").alias("pos", "cos"))
