"""Image folders and URL lists (SRC4, SRC5, SRC6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JPEG_MAGIC = bytes([0xFF, 0xD8, 0xFF])  # fixed value: start of every JPEG file


def read_image_folder(spark: SparkSession, root: str, *, with_path: bool = True,
                      pattern: str = "*/*.jpg") -> tuple[DataFrame, DataFrame]:
    """SRC4/SRC5: two-level ``root/*/*.jpg`` listing -> (images, rejects).

    A file that is not a JPEG is reported in ``rejects`` and skipped, never
    fatal. Pixel decoding is left to the user encoder."""
    df = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{pattern}")
    ok = F.startswith(F.col("content"), F.lit(JPEG_MAGIC))
    cols = (["path"] if with_path else []) + ["content", "length"]
    good = df.where(ok).select(*cols)
    bad = df.where(~ok).select("path", "length")
    return good, bad


def read_url_list(spark: SparkSession, path: str, *, url_col: str = "URL", caption_col: str = "TEXT",
                  min_size: int = 64) -> DataFrame:
    """SRC6: (url, caption) from a Parquet URL list; duplicate URLs once; rows whose
    WIDTH/HEIGHT columns exist and are below ``min_size`` are dropped."""
    df = spark.read.parquet(path)
    if "WIDTH" in df.columns and "HEIGHT" in df.columns:
        df = df.where((F.col("WIDTH") >= min_size) & (F.col("HEIGHT") >= min_size))
    df = df.where(F.col(url_col).isNotNull())
    return df.groupBy(F.col(url_col).alias("url")).agg(F.min(caption_col).alias("caption"))
