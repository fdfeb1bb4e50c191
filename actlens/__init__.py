"""actlens: activation analytics as plain Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` built from
``pyspark.sql.functions`` expressions; Arrow batches (``mapInArrow``) are
used only where a matrix product or raw-byte decode is needed.
"""

from actlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
