"""The training-data pipeline: stages over ``documents``, each a dealt operator.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame that
``run`` writes as Parquet and reads again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm.common import materialize, prepare, read_table
from actlens.llm.stages import STAGES

__all__ = ["STAGES", "ORACLE_SQL", "run"]

#: trained classifiers and sampled segmentations are not SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``, in order."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
