"""Session construction and the few settings fixed in one place."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: AQE for runtime re-planning and skew splits,
# UTC for all timestamp text, ANSI kept on (zero division must be explicit).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "actlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``actlens`` importable in the executors' Python workers (the Arrow
    functions are pickled by module reference), like ``--py-files``: the
    package sources are zipped on the driver once per application and added
    with ``addPyFile``."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="actlens-pkg-"), "actlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only when it is unset *and* the master is local (tests, bench) a
    fresh folder under the local temp directory is taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared "
            "checkpoint folder")
    local = tempfile.mkdtemp(prefix="actlens-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


RUNTIME_CONF = ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.skewJoin.enabled")


def ensure_utc(spark: SparkSession) -> None:
    """Session settings the operators rely on (UTC text, AQE); broadcast thresholds stay the session's own."""
    for key in RUNTIME_CONF:
        if spark.conf.get(key, None) != BASE_CONF[key]:
            spark.conf.set(key, BASE_CONF[key])


def stored(df, name: str = "stage") -> str:
    """Writes an intermediate as Parquet into a fresh folder under the shared checkpoint folder."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/actlens-stage/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return path


def materialize(df, name: str = "stage"):
    """Compute an intermediate once and cut its lineage: it is written as Parquet
    into a fresh folder under the shared checkpoint folder and read back. Every
    later consumer scans the written files, and a lost executor re-reads them
    instead of recomputing the upstream plan. (``DataFrame.checkpoint`` would run
    the plan twice: once to count, once to write.)"""
    return df.sparkSession.read.parquet(stored(df, name))


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def default_parallelism(spark: SparkSession) -> int:
    return int(os.environ.get("ACTLENS_PARTS", spark.sparkContext.defaultParallelism))
