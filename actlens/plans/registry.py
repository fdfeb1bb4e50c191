"""Registry of named queries: a Spark builder and its DuckDB oracle text.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole input tables. Oracles are written against the input views only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # timestamps are read and written as UTC; a reliable checkpoint folder exists
            from actlens.session import checkpoint_dir, ensure_utc, ship_package
            ensure_utc(spark)
            checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__ = getattr(fn, "__name__", name)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from actlens.plans import (  # noqa: F401
        q_interpret,
        q_relational,
        q_statistics,
        q_models,
        q_fit,
        q_text,
        q_io,
        q_stream,
    )
