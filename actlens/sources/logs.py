"""Run logs: JSON lines per run (SRC7, SRC8, SRC18, SNK6, SNK7)."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.functions.columns import utc_string
from actlens.session import default_parallelism, materialize
from actlens.sources.files import filesystem, qualified

LARGE_FILE = 64 << 20           # bytes of a log from which on Spark's reader splits it
HELD_BYTES = 4 << 20            # bytes of lines that leave a task together
TASKS_PER_CORE = 4
NULL_RUN = "__HIVE_DEFAULT_PARTITION__"

# union schema of logged events (free keys are read by name; unknown keys are ignored)
LOG_SCHEMA = T.StructType([
    T.StructField("event", T.StringType()), T.StructField("timestamp", T.DoubleType()),
    T.StructField("hr_timestamp", T.StringType()), T.StructField("step", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("k", T.LongType()),
    T.StructField("mse", T.DoubleType()), T.StructField("sum_mse", T.DoubleType()),
    T.StructField("loss", T.DoubleType()), T.StructField("L0", T.DoubleType()),
    T.StructField("l1", T.DoubleType()), T.StructField("dead_feature_prop", T.DoubleType()),
    T.StructField("expert_privilege", T.DoubleType()), T.StructField("explained_variance", T.DoubleType()),
    T.StructField("variance_proportional_mse", T.DoubleType()), T.StructField("batch_learning_rate", T.DoubleType()),
    T.StructField("input_mean", T.DoubleType()), T.StructField("input_std", T.DoubleType()),
    T.StructField("position_mse", T.ArrayType(T.DoubleType())),
    T.StructField("_corrupt_record", T.StringType())])


def read_run_logs(spark: SparkSession, paths: str | Sequence[str], *, schema: T.StructType = LOG_SCHEMA,
                  run_pattern: str = r"run=([^/]+)/") -> tuple[DataFrame, DataFrame]:
    """SRC7: (events, rejects). The run id comes from the file path; lines that
    do not parse are kept in ``rejects`` with their text, never fatal."""
    # lines are parsed with from_json over the text source: the same PERMISSIVE
    # semantics as the JSON reader, and no restriction on queries that touch only
    # the corrupt-record column
    if "_corrupt_record" not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    txt = run_lines(spark, paths, run_pattern).where(F.trim("value") != "")
    parsed = txt.select("run", F.col("value").alias("_line"),
                        F.from_json("value", schema, {"mode": "PERMISSIVE",
                                                      "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    ok = F.col("j._corrupt_record").isNull()
    fields = [f.name for f in schema.fields if f.name != "_corrupt_record"]
    good = parsed.where(ok).select(*[F.col(f"j.{f}").alias(f) for f in fields], "run")
    bad = parsed.where(~ok).select("run", F.col("_line").alias("_corrupt_record"))
    return good, bad


def _hidden(name: str) -> bool:
    """Names that Spark's file sources leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _spelled(path: str) -> str:
    """A path as ``_metadata.file_path`` spells it."""
    return re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\u0080-\U0010ffff]", lambda m: f"%{ord(m[0]):02X}", path)


def _reached(uri: str) -> bool:
    """Whether tasks can open the place themselves."""
    try:
        fsys, path = filesystem(uri)
        return fsys.get_file_info(path).type in (pafs.FileType.Directory, pafs.FileType.File)
    except (OSError, ValueError, NotImplementedError):
        return False


def _listed(spark: SparkSession, uris: list[str], tasks: int) -> DataFrame:
    """(uri, spelled, size) of all log files: one task lists the given folders, many
    tasks the partition folders in them. As in Spark's reader, other folders are no part of a log."""
    schema = pa.schema([("uri", pa.string()), ("spelled", pa.string()), ("size", pa.int64())])

    def look(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = []
            for b in batches:
                for uri, spelled, size in zip(*(c.to_pylist() for c in b.columns)):
                    if size is not None:
                        rows.append((uri, spelled, size))
                        continue
                    fsys, path = filesystem(uri)
                    scheme, stack = uri[:len(uri) - len(path)], [path]
                    while stack:
                        folder = stack.pop()
                        for x in fsys.get_file_info(pafs.FileSelector(folder)):
                            if _hidden(x.base_name):
                                continue
                            if x.type != pafs.FileType.Directory:
                                rows.append((scheme + x.path, scheme + _spelled(x.path), x.size))
                            elif "=" in x.base_name and deep:
                                stack.append(x.path)
                            elif "=" in x.base_name:
                                rows.append((scheme + x.path, None, None))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)
        return run

    places = []
    for uri in uris:
        fsys, path = filesystem(uri)
        info = fsys.get_file_info(path)
        places.append((uri, None, None) if info.type == pafs.FileType.Directory else
                      (uri, uri[:len(uri) - len(path)] + _spelled(path), info.size))
    columns = "uri string, spelled string, size bigint"
    roots = spark.createDataFrame(places, columns).coalesce(1)
    return materialize(roots.mapInArrow(look(False), columns).repartition(tasks).mapInArrow(look(True), columns)
                       .where("size > 0"), "log-files")


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, run) -> (run, value): the lines of whole files; LF, CR or both end a line, as for Spark."""
    held, runs, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(held, pa.binary())], names=["run", "value"])

    for b in batches:
        for uri, run in zip(*(c.to_pylist() for c in b.columns)):
            fsys, path = filesystem(uri)
            with fsys.open_input_stream(path, compression=None) as f:
                text = f.read()
            lines = text.split(b"\n") if b"\r" not in text else re.split(b"\r\n|\r|\n", text)
            if not lines[-1]:
                lines.pop()
            for at in range(0, len(lines), 1 << 14):
                held += lines[at:at + (1 << 14)]
                runs += [run] * (len(held) - len(runs))
                size += len(text) * min(1 << 14, len(lines) - at) // len(lines)
                if size >= HELD_BYTES:
                    yield batch()
                    held, runs, size = [], [], 0
    if held:
        yield batch()


def run_lines(spark: SparkSession, paths: str | Sequence[str], run_pattern: str) -> DataFrame:
    """(run, value): the lines of all log files under ``paths``, the run from the file's
    path. Folders are listed and files read in tasks, many files a task, so the driver
    neither holds the status of each file nor plans a task for every few. Files that are
    large or compressed, patterns, and stores that only Spark opens go through Spark's reader."""
    def by_spark(some: str | Sequence[str]) -> DataFrame:
        return spark.read.text(some).select(F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1).alias("run"), "value")

    names = [paths] if isinstance(paths, str) else list(paths)
    uris = [qualified(spark, p) for p in names]
    if any(set(p) & set("*?[]{}\\") for p in names) or not all(map(_reached, uris)):
        return by_spark(paths)
    tasks = TASKS_PER_CORE * default_parallelism(spark)
    files = _listed(spark, uris, tasks)
    other = (F.col("size") > LARGE_FILE) | F.col("uri").rlike(r"\.(gz|bz2|zst|deflate|lz4|snappy|xz)$")
    aside = [r["uri"] for r in files.where(other).select("uri").collect()]
    small = files.where(~other).select("uri", F.regexp_extract("spelled", run_pattern, 1).alias("run"))
    lines = small.repartition(tasks).mapInArrow(_read_lines, "run string, value binary") \
        .select("run", F.col("value").cast("string").alias("value"))
    return lines.unionByName(by_spark([re.sub(r"([*?\[\]{}\\])", r"\\\1", u) for u in aside])) if aside else lines


def run_params(logs: DataFrame, param_cols: Sequence[str], *, run_col: str = "run",
               order_cols: Sequence[str] = ("timestamp", "step"), metric_cols: Sequence[str] = ()) -> DataFrame:
    """SRC8: the first line of each run holds its parameters; merge them into
    every row of that run. A parameter named like a metric raises."""
    clash = set(param_cols) & set(metric_cols)
    if clash:
        raise ValueError(f"parameter names clash with metrics: {sorted(clash)}")
    w = Window.partitionBy(run_col).orderBy(*order_cols)
    first = logs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1) \
                .select(run_col, *[F.col(c).alias(f"param_{c}") for c in param_cols])
    return logs.join(first, on=run_col, how="left")


def runs_by_prefix(logs: DataFrame, prefix: str, starts: Sequence[str], *, run_col: str = "run_name",
                   metric: str | None = None) -> DataFrame:
    """SRC18: runs whose name starts with prefix + one of ``starts``, keeping only
    runs where the metric was logged."""
    cond = None
    for s in starts:
        c = F.startswith(F.col(run_col), F.lit(prefix + s))
        cond = c if cond is None else (cond | c)
    sel = logs.where(cond)
    if metric:
        has = sel.where(F.col(metric).isNotNull()).select(run_col).distinct()
        sel = sel.join(has, on=run_col, how="left_semi")
    return sel


def fill_timestamps(df: DataFrame, now: float | None = None) -> DataFrame:
    """SNK6: fill ``timestamp`` (epoch seconds) and ``hr_timestamp`` (UTC text) only when missing."""
    t = float(time.time() if now is None else now)
    out = df.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.lit(t)))
    return out.withColumn("hr_timestamp", F.coalesce(F.col("hr_timestamp"), utc_string("timestamp")))


def _folder_of(run: str | None) -> str:
    """The folder value that Spark would give a partition."""
    if not run:
        return NULL_RUN
    return re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", run)


def append_lines(df: DataFrame, line: Column, path: str, *, partition_col: str = "run", suffix: str = "json") -> None:
    """Appends ``line`` to a folder per run. A run's rows meet in one task, which writes
    one file to it for this session; a task has many runs and holds one of them open, and
    its files take their names when whole, so that a repeated task replaces its own."""
    spark = df.sparkSession
    base, session = qualified(spark, path), uuid.uuid4().hex[:12]
    tasks = max(TASKS_PER_CORE * default_parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fsys, root = filesystem(base)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{session}.{suffix}"
        attempt = f".{name}-{context.taskAttemptId()}"
        folder, out, n = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                fsys.move(f"{folder}/{attempt}", f"{folder}/{name}")

        for b in batches:
            runs, lines = b.column(0), b.column(1)
            if not b.num_rows:
                continue
            ends = pc.run_end_encode(runs)
            _, edge, data = lines.buffers()
            edge = np.frombuffer(edge, np.int32)[lines.offset:]
            lo = 0
            for run, hi in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                place = f"{root}/{partition_col}={_folder_of(run)}"
                if place != folder:
                    close()
                    folder, n = place, n + 1
                    fsys.create_dir(folder, recursive=True)
                    out = fsys.open_output_stream(f"{folder}/{attempt}", compression=None)
                if edge[hi] > edge[lo]:
                    out.write(data[int(edge[lo]):int(edge[hi])])
                lo = hi
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["runs"])

    run = F.col(partition_col).cast("string")
    lines = df.select(F.when(run != "", run).alias("run"), F.concat(F.coalesce(line, F.lit("")), F.lit("\n")).cast("binary").alias("line"))
    lines.repartition(tasks, "run").sortWithinPartitions("run").mapInArrow(write, "runs bigint").agg(F.sum("runs")).collect()


def json_line(df: DataFrame, partition_col: str = "run") -> Column:
    """A row as a JSON line, without the column that its folder names."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns if c != partition_col]))


def append_log(df: DataFrame, path: str, now: float | None = None, partition_col: str | None = "run") -> None:
    """SNK6: append JSON lines; re-opening a run's log continues it (append mode)."""
    out = fill_timestamps(df, now)
    if partition_col:
        append_lines(out, json_line(out, partition_col), path, partition_col=partition_col)
    else:
        out.write.mode("append").json(path)
