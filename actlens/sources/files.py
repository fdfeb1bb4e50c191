"""File helpers shared by sources and sinks.

Folders for written tables live under the session's reliable checkpoint
folder (``spark.checkpoint.dir`` on a cluster). Raw files (blocks, images)
are written from tasks through ``pyarrow.fs``, which reaches local, HDFS
and object-store paths alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from actlens.session import checkpoint_dir


def io_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of a writer (never reused, never cleared)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/actlens-io/{name}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, uri: str) -> str:
    """``uri`` without a trailing slash and with the scheme that Spark would take:
    a path without one lies on the session's default file system, for Spark and
    for the tasks that write raw files alike."""
    uri = uri.rstrip("/")
    if "://" in uri or uri.startswith("file:"):
        return uri
    default = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").rstrip("/")
    return uri if default.startswith("file:") else f"{default}{uri}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        path = uri[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
        return pafs.LocalFileSystem(), path
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    if uri.startswith(("s3a://", "s3n://")):       # names of the same store in Hadoop
        uri = "s3://" + uri.split("://", 1)[1]
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data) -> None:
    fsys, path = filesystem(uri)
    parent = path.rsplit("/", 1)[0]
    fsys.create_dir(parent, recursive=True)
    tmp = f"{path}.tmp-{uuid.uuid4().hex[:8]}"
    with fsys.open_output_stream(tmp) as f:
        f.write(data)
    fsys.move(tmp, path)  # a retried task overwrites a whole file, never a partial one


def exists(uri: str) -> bool:
    fsys, path = filesystem(uri)
    return fsys.get_file_info(path).type != pafs.FileType.NotFound


def stored_batches(uri: str, columns: Sequence[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows of a Parquet folder, read by a task that needs a table beside its own rows."""
    fsys, path = filesystem(uri)
    for x in sorted(fsys.get_file_info(pafs.FileSelector(path)), key=lambda x: x.path):
        if x.path.endswith(".parquet") and not x.base_name.startswith((".", "_")):
            with fsys.open_input_file(x.path) as f:
                yield from pq.ParquetFile(f).iter_batches(batch_size=rows, columns=list(columns))


def remove_folder(spark: SparkSession, uri: str) -> None:
    """Removes a folder of intermediate files that a query wrote and has read."""
    fsys, path = filesystem(qualified(spark, uri))
    fsys.delete_dir(path)
