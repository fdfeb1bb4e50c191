"""Set operations (SET1-SET4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vocabulary(tokens: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """SET1: distinct tokens over all texts (from array or long form)."""
    if dict(tokens.dtypes).get(tokens_col, "").startswith("array"):
        return tokens.select(F.explode(tokens_col).alias("token")).distinct()
    return tokens.select(F.col(tokens_col).alias("token")).distinct()


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET2: intersection of key sets."""
    return a.select(*keys).intersect(b.select(*keys))


def except_ids(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET3: set difference of ids (left anti join keeps it a hash/sort join)."""
    return a.select(*keys).distinct().join(b.select(*keys), on=list(keys), how="left_anti")


def append_batches(*parts: DataFrame) -> DataFrame:
    """SET4: concatenate parts; all must have the same columns, else ValueError."""
    if not parts:
        raise ValueError("nothing to append")
    cols = parts[0].columns
    for p in parts[1:]:
        if sorted(p.columns) != sorted(cols):
            raise ValueError("the parts differ in their columns")
    return reduce(lambda x, y: x.unionByName(y), parts)
