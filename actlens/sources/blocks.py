"""Raw activation blocks and run metadata (SRC1-SRC3, SRC16, SRC17, SNK2-SNK5).

A block is the raw little-endian bytes of one C-ordered tensor, no header;
its shape is in the run's ``metadata.json``. The wanted files are chosen from
a listing (no content); tasks then read ranges of whole rows, so a block may
be of any size and nothing that is skipped is read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.operators import ordering as O
from actlens.session import default_parallelism, materialize
from actlens.sources.files import filesystem, qualified, write_bytes

BLOCK_GLOB = "*.saved.pt"
#: bytes of a block read at once, and read by one task
RANGE_BYTES = 32 << 20
TASK_BYTES = 128 << 20
# fixed values: dtype names accepted in metadata and their element sizes
DTYPES = {"float32": ("<f4", 4), "torch.float32": ("<f4", 4), "float64": ("<f8", 8),
          "torch.float64": ("<f8", 8), "float16": ("<f2", 2), "torch.float16": ("<f2", 2)}

META_SCHEMA = T.StructType([
    T.StructField("batch_size", T.LongType()), T.StructField("dtype", T.StringType()),
    T.StructField("bytes_per_file", T.LongType()), T.StructField("batches_per_file", T.LongType()),
    T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("sequence_length", T.LongType()),
    T.StructField("d_in", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("std", T.ArrayType(T.DoubleType()))])


# ------------------------------------------------------------------ metadata

def metadata_of(df: DataFrame, *, batch_col: str = "batch_id", sample_col: str = "sample_id",
                pos_col: str | None = "pos", vec_col: str = "vec", dtype: str = "float32",
                batches_per_file: int = 1) -> dict:
    """SNK3: shape metadata inferred from the first batch (3-D with positions, else 2-D)."""
    if dtype not in DTYPES:
        raise ValueError(f"unsupported dtype {dtype!r}")
    first = df.agg(F.min(batch_col)).first()[0]
    b = df.where(F.col(batch_col) == first)
    aggs = [F.countDistinct(sample_col).alias("n"), F.max(F.size(vec_col)).alias("d"),
            F.min(F.size(vec_col)).alias("d_min")]
    if pos_col:
        aggs.append((F.max(pos_col) + 1).alias("seq"))
    r = b.agg(*aggs).first()
    if r["d"] != r["d_min"]:
        raise ValueError("vectors of one batch differ in length")
    n, d = int(r["n"]), int(r["d"])
    shape = [n, int(r["seq"]), d] if pos_col else [n, d]
    if len(shape) not in (2, 3):
        raise ValueError(f"Activations must be 2D or 3D, got {len(shape)}D")
    meta = {"batch_size": n, "dtype": dtype, "batches_per_file": batches_per_file, "shape": shape,
            "d_in": d, "bytes_per_file": DTYPES[dtype][1] * math.prod(shape) * batches_per_file}
    if pos_col:
        meta["sequence_length"] = shape[1]
    return meta


def write_metadata(spark: SparkSession, run_path: str, meta: dict) -> str:
    uri = f"{qualified(spark, run_path)}/metadata.json"
    write_bytes(uri, json.dumps(meta).encode())
    return uri


def read_run_metadata(spark: SparkSession, run_path: str) -> DataFrame:
    """SRC2: one row; sequence_length defaults to 1 (2-D runs);
    samples_per_file = batches_per_file * batch_size."""
    m = spark.read.schema(META_SCHEMA).option("multiLine", True).json(f"{run_path.rstrip('/')}/metadata.json")
    return m.withColumn("sequence_length", F.coalesce("sequence_length", F.lit(1))) \
            .withColumn("samples_per_file", F.col("batches_per_file") * F.col("batch_size"))


def save_mean_std(meta: dict, stats: DataFrame, dim_col: str = "dim") -> dict:
    """SNK5: attach per-dimension mean / std (d_in values each) to the metadata."""
    rows = stats.select(dim_col, "mean", "std").orderBy(dim_col).collect()  # d_in rows: parameters
    out = dict(meta)
    out["mean"] = [float(r["mean"]) for r in rows]
    out["std"] = [float(r["std"]) for r in rows]
    return out


def shape_report(df: DataFrame, meta: dict, *, batch_col: str = "batch_id", sample_col: str = "sample_id",
                 pos_col: str | None = "pos", vec_col: str = "vec") -> DataFrame:
    """SNK4: (batch_id, field, expected, got) for every batch that deviates; never drops data.

    ``d_in`` holds for the shortest and the longest vector of a batch (the deviating
    length is reported); with a ``dtype`` in the metadata, ``element_bytes`` is compared
    with the element type of the vectors."""
    sizes = F.size(vec_col)
    wide = F.lit(int(meta["d_in"]))
    aggs = [F.countDistinct(sample_col).alias("batch_size"),
            F.when(F.min(sizes) != wide, F.min(sizes)).otherwise(F.max(sizes)).alias("d_in")]
    fields = ["batch_size", "d_in"]
    if pos_col:
        aggs.append((F.max(pos_col) + 1).alias("sequence_length"))
        fields.append("sequence_length")
    expected = {f: int(meta[f]) for f in fields}
    if "dtype" in meta:
        element = df.schema[vec_col].dataType.elementType
        aggs.append(F.lit({"float": 4, "double": 8}.get(element.simpleString(), 0)).alias("element_bytes"))
        fields.append("element_bytes")
        expected["element_bytes"] = DTYPES[meta["dtype"]][1]
    per = df.groupBy(batch_col).agg(*aggs)
    long = per.select(batch_col, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(expected[f]).cast("bigint").alias("expected"),
                 F.col(f).cast("bigint").alias("got")) for f in fields])).alias("r"))
    return long.select(batch_col, "r.field", "r.expected", "r.got").where(F.col("expected") != F.col("got"))


# ------------------------------------------------------------------ blocks

def write_blocks(df: DataFrame, run_path: str, rows_per_block: int, *, order_cols: Sequence[str],
                 vec_col: str = "vec", keep_partial: bool = True, dtype: str = "float32",
                 location_cols: Sequence[str] = ()) -> DataFrame:
    """SNK2: cut rows (in order) into blocks of exactly ``rows_per_block`` rows and
    write each as raw bytes ``{run}/{block:010d}.saved.pt``, with ``location_cols``
    under ``{run}/{column}={value}/...`` and numbered per location. An incomplete
    last block is written only with ``keep_partial``. The blocks are written once,
    when this is called; returns what was written: (block_id, path, n_rows, n_bytes).

    Each block is one group of bounded size (rows_per_block rows)."""
    np_dtype, _ = DTYPES[dtype]
    loc = list(location_cols)
    x = O.running_index(df.select(*loc, *[c for c in order_cols if c not in loc], vec_col), list(order_cols),
                        group_cols=loc, name="_gi")
    x = x.withColumn("block_id", F.floor(F.col("_gi") / F.lit(rows_per_block)).cast("bigint"))
    if not keep_partial:
        totals = df.groupBy(*loc).agg(F.count(F.lit(1)).alias("_n"))     # one row per location
        full = F.floor(F.col("_n") / F.lit(rows_per_block))
        if loc:
            x = x.join(totals, on=loc).where(F.col("block_id") < full).drop("_n")
        else:
            x = x.where(F.col("block_id") < F.lit(totals.first()["_n"] // rows_per_block))
    base = qualified(df.sparkSession, run_path)
    out_schema = T.StructType([T.StructField("block_id", T.LongType()), T.StructField("path", T.StringType()),
                               T.StructField("n_rows", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def write(tbl: pa.Table) -> pa.Table:
        order = np.argsort(tbl.column("_gi").to_numpy())
        vecs = tbl.column(vec_col).combine_chunks().take(pa.array(order))
        d = vecs.value_lengths()[0].as_py()
        arr = np.ascontiguousarray(vecs.flatten().to_numpy(zero_copy_only=False).astype(np_dtype).reshape(-1, d))
        bid = int(tbl.column("block_id")[0].as_py())
        folder = "".join(f"/{c}={tbl.column(c)[0].as_py()}" for c in loc)
        uri = f"{base}{folder}/{bid:010d}.saved.pt"
        write_bytes(uri, pa.py_buffer(arr))
        return pa.table({"block_id": [bid], "path": [uri], "n_rows": [len(arr)], "n_bytes": [arr.nbytes]})

    return materialize(x.groupBy(*loc, "block_id").applyInArrow(write, out_schema), "blocks-written")


def list_blocks(spark: SparkSession, run_path: str) -> DataFrame:
    """Block catalogue (path, length, block_index) in sorted path order; metadata excluded.

    Only file names are listed (no content read): ``binaryFile`` with the
    content column pruned.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", BLOCK_GLOB) \
                 .option("recursiveFileLookup", "true").load(run_path).select("path", "length")
    return O.running_index(files, ["path"], name="block_index")


class BlockLayout(NamedTuple):
    """How the bytes of a run's blocks are rows."""
    np_dtype: str
    row_bytes: int
    d: int
    seq: int
    samples_per_file: int

    @classmethod
    def of(cls, meta: dict) -> BlockLayout:
        if meta["dtype"] not in DTYPES:
            raise ValueError(f"unsupported dtype {meta['dtype']!r}")
        np_dtype, size = DTYPES[meta["dtype"]]
        shape = list(meta["shape"])
        seq = int(meta.get("sequence_length") or 1) if len(shape) == 3 else 1
        d = int(shape[-1])
        return cls(np_dtype, size * d, d, seq, int(meta["batches_per_file"]) * int(meta["batch_size"]))

    def files_before(self, token: int) -> int:
        """Files to skip when a reader starts at a token: ceil(token / tokens per file)."""
        return math.ceil(token / (self.samples_per_file * self.seq)) if token else 0


ROW_SCHEMA = T.StructType([T.StructField("block_index", T.LongType()), T.StructField("path", T.StringType()),
                           T.StructField("sample_id", T.LongType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("vec", T.ArrayType(T.FloatType(), False))])
_ARROW_SCHEMA = pa.schema([pa.field("block_index", pa.int64()), pa.field("path", pa.string()),
                           pa.field("sample_id", pa.int64()), pa.field("pos", pa.int32()),
                           pa.field("vec", pa.list_(pa.field("element", pa.float32(), False)))])


def decode_range(layout: BlockLayout, uri: str, block_index: int, first_row: int, n: int) -> pa.RecordBatch:
    """``n`` rows of a block, from ``first_row``; only their bytes are read."""
    fsys, path = filesystem(uri)
    with fsys.open_input_file(path) as f:
        data = f.read_at(n * layout.row_bytes, first_row * layout.row_bytes)
    arr = np.frombuffer(data, dtype=layout.np_dtype).astype(np.float32)
    row = first_row + np.arange(n)
    offsets = pa.array(np.arange(0, (n + 1) * layout.d, layout.d, dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block_index, dtype=np.int64)), pa.array([uri] * n, pa.string()),
         pa.array(block_index * layout.samples_per_file + row // layout.seq),
         pa.array((row % layout.seq).astype(np.int32)),
         pa.ListArray.from_arrays(offsets, pa.array(arr))], schema=_ARROW_SCHEMA)


def read_activation_blocks(spark: SparkSession, run_path: str, *, meta: dict | None = None,
                           start_at_token: int = 0, block_ids: Sequence[int] | None = None,
                           range_bytes: int = RANGE_BYTES) -> DataFrame:
    """SRC1/SRC3/SRC16: decode raw blocks into rows (block_index, path, sample_id, pos, vec).

    sample_id = block_index * samples_per_file + sample in block. With
    ``start_at_token`` the first ceil(start / tokens_per_file) files are
    skipped; ``block_ids`` keeps only those block indexes.

    Each wanted file becomes ranges of about ``range_bytes`` (whole rows); the
    ranges, short rows, are dealt to tasks, which read just those bytes.
    """
    if meta is None:
        meta = read_run_metadata(spark, run_path).first().asDict()
    layout = BlockLayout.of(meta)
    row_bytes = layout.row_bytes
    cat = list_blocks(spark, run_path)
    cat = cat.where(F.col("block_index") >= layout.files_before(start_at_token))
    if block_ids is not None:
        cat = cat.where(F.col("block_index").isin(list(block_ids)))
    step = max(1, range_bytes // row_bytes)
    ranges = cat.where(F.col("length") > 0).select(
        "path", "block_index", "length",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - F.lit(1)) / F.lit(row_bytes)).cast("bigint"),
                             F.lit(step).cast("bigint"))).alias("first_row"))
    total = cat.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-total // TASK_BYTES), min(default_parallelism(spark), -(-total // (1 << 20))), 1)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["length"] % row_bytes:
                    raise ValueError(f"{r['path']}: {r['length']} bytes are no whole rows of {row_bytes} bytes")
                n = min(step, r["length"] // row_bytes - r["first_row"])
                yield decode_range(layout, r["path"], r["block_index"], r["first_row"], n)

    return ranges.repartition(int(tasks)).mapInArrow(decode, ROW_SCHEMA)


def block_count(blocks: DataFrame, group_cols: Sequence[str] = ("run", "layer", "module"),
                block_col: str = "block_id") -> DataFrame:
    """SRC17: number of blocks per location."""
    return blocks.groupBy(*group_cols).agg(F.countDistinct(block_col).alias("n_blocks"))
