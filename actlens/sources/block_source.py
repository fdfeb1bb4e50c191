"""Raw blocks as a Spark data source, ``activation_blocks`` (SRC1, SRC3, SRC16, SNK2, STR3).

    register(spark)
    spark.read.format("activation_blocks").load(run).where("block_index = 7")
    spark.readStream.format("activation_blocks").load(run)
    numbered.write.format("activation_blocks").mode("append").option("metadata", json).save(run)

* Reading: the listing and ``metadata.json`` are read while planning; tasks read
  ranges of whole rows. Comparisons of ``block_index`` with whole numbers are taken
  over by the source: a block outside of them gets no task. Options: ``startAtToken``
  skips whole files, ``rangeBytes`` is read at once, ``taskBytes`` by one task.
* Streams: the offset is the last block's name and the number of blocks up to it.
  Blocks must arrive in order of their names, and read ones must stay; a block that
  turns up (or goes missing) before the offset stops the query instead of being lost.
* Writing: rows (``block_id``, ``vec``), the rows of a block adjacent in one partition
  (see ``write_run``). Each block goes straight to a file of the task's own folder;
  the commit moves the files in place, metadata last, and aborted attempts leave
  nothing in the run. ``append`` refuses blocks that exist, ``overwrite`` replaces all.

Paths without a scheme are local files here; ``files.qualified`` adds the session's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from actlens.operators import ordering as O
from actlens.sources.blocks import DTYPES, RANGE_BYTES, ROW_SCHEMA, TASK_BYTES, BlockLayout, decode_range
from actlens.sources.files import filesystem, qualified, write_bytes

FORMAT = "activation_blocks"
SUFFIX = ".saved.pt"
#: a larger run gets longer tasks instead of more of them
MAX_TASKS = 100_000


def register(spark: SparkSession) -> None:
    """Make the format known to the session; filters reach Python sources only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)


@dataclass(frozen=True)
class BlockFile:
    index: int
    name: str            # below the run's folder
    uri: str
    length: int


@dataclass(frozen=True)
class Ranges(InputPartition):
    """(uri, block index, first row, rows) of one task."""
    ranges: tuple[tuple[str, int, int, int], ...]


def list_run(run: str) -> list[BlockFile]:
    """The blocks of a run in order of their paths; hidden folders are no part of it."""
    fsys, root = filesystem(run)
    infos = fsys.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    names = sorted((i.path[len(root):].lstrip("/"), i.size) for i in infos
                   if i.type == pafs.FileType.File and i.path.endswith(SUFFIX))
    names = [(n, size) for n, size in names if not any(part[0] in "_." for part in n.split("/"))]
    return [BlockFile(k, n, f"{run}/{n}", size) for k, (n, size) in enumerate(names)]


def read_layout(run: str) -> BlockLayout:
    fsys, path = filesystem(f"{run}/metadata.json")
    with fsys.open_input_stream(path) as f:
        return BlockLayout.of(json.loads(f.read().decode()))


def deal(files: Iterable[BlockFile], layout: BlockLayout, range_bytes: int, task_bytes: int) -> list[Ranges]:
    """Ranges of whole rows, consecutive ones in one task up to ``task_bytes``."""
    files = list(files)
    step = max(1, range_bytes // layout.row_bytes)
    limit = max(task_bytes, -(-sum(f.length for f in files) // MAX_TASKS))
    tasks, held, size = [], [], 0
    for f in files:
        if f.length % layout.row_bytes:
            raise ValueError(f"{f.uri}: {f.length} bytes are no whole rows of {layout.row_bytes} bytes")
        rows = f.length // layout.row_bytes
        for first in range(0, rows, step):
            n = min(step, rows - first)
            if held and size + n * layout.row_bytes > limit:
                tasks.append(Ranges(tuple(held)))
                held, size = [], 0
            held.append((f.uri, f.index, first, n))
            size += n * layout.row_bytes
    if held:
        tasks.append(Ranges(tuple(held)))
    return tasks


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return ROW_SCHEMA

    def _run(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError(f"{FORMAT} needs the path of a run")
        return path.rstrip("/")

    def _number(self, option: str, default: int) -> int:
        value = int(self.options.get(option, default))
        if value < (0 if option == "startAtToken" else 1):
            raise ValueError(f"{option} must not be {value}")
        return value

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BlockReader(self._run(), self._number("startAtToken", 0), self._number("rangeBytes", RANGE_BYTES),
                           self._number("taskBytes", TASK_BYTES))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return BlockStreamReader(self._run(), self._number("rangeBytes", RANGE_BYTES),
                                 self._number("taskBytes", TASK_BYTES))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        missing = {"block_id", "vec"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"blocks need the columns {sorted(missing)}")
        return BlockWriter(self._run(), self.options.get("dtype", "float32"), self.options.get("metadata"), overwrite)


class BlockReader(DataSourceReader):
    def __init__(self, run: str, start_at_token: int, range_bytes: int, task_bytes: int):
        self.run, self.start = run, start_at_token
        self.range_bytes, self.task_bytes = range_bytes, task_bytes
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) \
                    and f.attribute == ("block_index",):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, index: int) -> bool:
        for f in self.wanted:
            if isinstance(f, EqualTo):
                ok = index == f.value
            elif isinstance(f, In):
                ok = index in f.value
            elif isinstance(f, GreaterThan):
                ok = index > f.value
            elif isinstance(f, GreaterThanOrEqual):
                ok = index >= f.value
            elif isinstance(f, LessThan):
                ok = index < f.value
            else:
                ok = index <= f.value
            if not ok:
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        self.layout = read_layout(self.run)
        skip = self.layout.files_before(self.start)
        files = [f for f in list_run(self.run) if f.index >= skip and self._keeps(f.index)]
        # a source without partitions would be asked for one: an empty one reads nothing
        return deal(files, self.layout, self.range_bytes, self.task_bytes) or [Ranges(())]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        layout = read_layout(self.run) if partition.ranges else None
        for uri, index, first, n in partition.ranges:
            yield decode_range(layout, uri, index, first, n)


class BlockStreamReader(DataSourceStreamReader):
    def __init__(self, run: str, range_bytes: int, task_bytes: int):
        self.run, self.range_bytes, self.task_bytes = run, range_bytes, task_bytes

    def initialOffset(self) -> dict:
        return {"after": "", "count": 0}

    def latestOffset(self) -> dict:
        files = list_run(self.run)
        return {"after": files[-1].name, "count": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files = [f for f in list_run(self.run) if f.name <= end["after"]]
        for offset in (start, end):
            seen = sum(f.name <= offset["after"] for f in files)
            if seen != offset["count"]:
                raise ValueError(f"{self.run}: {seen} blocks up to {offset['after']!r}, {offset['count']} when it was "
                                 "read; blocks must arrive in order and stay")
        fresh = [f for f in files if f.name > start["after"]]
        if not fresh:
            return []
        return deal(fresh, read_layout(self.run), self.range_bytes, self.task_bytes)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        layout = read_layout(self.run)
        for uri, index, first, n in partition.ranges:
            yield decode_range(layout, uri, index, first, n)


@dataclass
class Written(WriterCommitMessage):
    """(block_id, uri of the attempt's file) of one task."""
    blocks: list[tuple[int, str]]


class BlockWriter(DataSourceArrowWriter):
    def __init__(self, run: str, dtype: str, metadata: str | None, overwrite: bool):
        if dtype not in DTYPES:
            raise ValueError(f"unsupported dtype {dtype!r}")
        self.run, self.dtype, self.metadata, self.overwrite = run, dtype, metadata, overwrite
        self.attempts = f"{run}/_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        np_dtype, _ = DTYPES[self.dtype]
        folder = f"{self.attempts}/{uuid.uuid4().hex}"
        fsys, root = filesystem(folder)
        blocks: list[tuple[int, str]] = []
        done: set[int] = set()
        out, current, width = None, None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                ids, vecs = batch.column("block_id"), batch.column("vec")
                if ids.null_count or vecs.null_count or vecs.values.null_count:
                    raise ValueError("a block row needs its block and a whole vector")
                lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
                width = width or int(lengths[0])
                if not width or (lengths != width).any():
                    raise ValueError("vectors differ in length or are empty")
                rows = vecs.flatten().to_numpy(zero_copy_only=False).astype(np_dtype).reshape(-1, width)
                ids = ids.to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
                for a, b in zip(cuts, cuts[1:]):
                    block = int(ids[a])
                    if block != current:
                        if out is not None:
                            out.close()
                        if block in done or block < 0:
                            raise ValueError(f"block {block}: its rows are not adjacent, or its number is negative")
                        if not blocks:
                            fsys.create_dir(root, recursive=True)
                        done.add(block)
                        out, current = fsys.open_output_stream(f"{root}/{block:010d}{SUFFIX}"), block
                        blocks.append((block, f"{folder}/{block:010d}{SUFFIX}"))
                    out.write(pa.py_buffer(np.ascontiguousarray(rows[a:b])))
        finally:
            if out is not None:
                out.close()
        return Written(blocks)

    def commit(self, messages: list[Written | None]) -> None:
        blocks = sorted(b for m in messages if m is not None for b in m.blocks)
        ids = [b for b, _ in blocks]
        twice = {a for a, b in zip(ids, ids[1:]) if a == b}
        there = {f.name: f for f in list_run(self.run)}
        if not self.overwrite:
            twice |= {b for b in ids if f"{b:010d}{SUFFIX}" in there}
        if twice:
            self.abort(messages)
            raise ValueError(f"{len(twice)} blocks were written twice or exist, the first is {min(twice)}")
        fsys, root = filesystem(self.run)
        if self.overwrite:
            for name in there:
                fsys.delete_file(f"{root}/{name}")
        for block, uri in blocks:
            fsys.move(filesystem(uri)[1], f"{root}/{block:010d}{SUFFIX}")
        self.abort(messages)
        if self.metadata:
            write_bytes(f"{self.run}/metadata.json", self.metadata.encode())

    def abort(self, messages: list[Written | None]) -> None:
        fsys, path = filesystem(self.attempts)
        if fsys.get_file_info(path).type == pafs.FileType.Directory:
            fsys.delete_dir(path)


def write_run(df: DataFrame, run_path: str, rows_per_block: int, meta: dict, *, order_cols: Sequence[str],
              vec_col: str = "vec", mode: str = "append", first_block: int = 0) -> None:
    """SNK2 through the data source: rows in order, cut into blocks of ``rows_per_block``."""
    register(df.sparkSession)
    x = O.running_index(df.select(*order_cols, F.col(vec_col).alias("vec")), list(order_cols), name="_gi")
    x = x.withColumn("block_id", F.floor(F.col("_gi") / F.lit(rows_per_block)).cast("bigint") + F.lit(first_block))
    x = x.repartition("block_id").sortWithinPartitions("block_id", "_gi").select("block_id", "vec")
    x.write.format(FORMAT).mode(mode).option("dtype", meta["dtype"]).option("metadata", json.dumps(meta)) \
        .save(qualified(df.sparkSession, run_path))


def read_run(spark: SparkSession, run_path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(qualified(spark, run_path))


def stream_run(spark: SparkSession, run_path: str, **options) -> DataFrame:
    """STR3: blocks as they arrive, each once."""
    register(spark)
    return spark.readStream.format(FORMAT).options(**options).load(qualified(spark, run_path))
