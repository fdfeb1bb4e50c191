"""User encoders that yield several locations in one pass (UDF2).

An encoder is the user's function over one Arrow batch: it gets the batch and the
wanted locations and returns, per location, one vector for every row (the model's
weights are whatever the function carries). ``encode_locations`` runs it once over
the rows and emits one row per input row and location; ``write_locations`` stores
each location under its own partition, with one commit for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (block layer, module name)
Location = tuple[int, str]
#: rows and wanted locations -> one matrix of vectors per location
Encoder = Callable[[pa.RecordBatch, Sequence[Location]], dict[Location, np.ndarray]]

MODULES = ("resid",)
SLICE_ROWS = 1024       # rows that an encoder sees at once


def check_locations(locations: Sequence[Location], modules: Sequence[str] = MODULES) -> list[Location]:
    wanted = [(int(layer), str(module)) for layer, module in locations]
    if not wanted:
        raise ValueError("an encoder needs at least one location")
    if len(set(wanted)) != len(wanted):
        raise ValueError("a location is asked twice")
    for layer, module in wanted:
        if module not in modules:
            raise ValueError(f"module {module!r} is not one of {list(modules)}")
        if layer < 0:
            raise ValueError(f"layer {layer} does not exist")
    return wanted


def encode_locations(rows: DataFrame, encoder: Encoder, locations: Sequence[Location], *, key_cols: Sequence[str],
                     modules: Sequence[str] = MODULES) -> DataFrame:
    """(keys, layer, module, vec) for every row and location, by one pass over ``rows``.

    An encoder that returns another set of locations than asked, or another number
    of vectors than rows, fails the job: a location is never silently empty."""
    wanted, keys = check_locations(locations, modules), list(key_cols)
    schema = T.StructType([rows.schema[c] for c in keys] + [
        T.StructField("layer", T.IntegerType(), False), T.StructField("module", T.StringType(), False),
        T.StructField("vec", T.ArrayType(T.DoubleType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                b = whole.slice(lo, SLICE_ROWS)
                found = encoder(b, wanted)
                if set(found) != set(wanted):
                    raise ValueError(f"the encoder returned {sorted(found)}, not {sorted(wanted)}")
                for layer, module in wanted:
                    x = np.ascontiguousarray(found[layer, module], np.float64)
                    if x.ndim != 2 or len(x) != b.num_rows:
                        raise ValueError(f"location {(layer, module)} has shape {x.shape} for {b.num_rows} rows")
                    edge = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(c) for c in keys), pa.array(np.full(len(x), layer, np.int32)), pa.array([module] * len(x)),
                         pa.ListArray.from_arrays(edge, pa.array(x.ravel()))], names=[*keys, "layer", "module", "vec"])

    return rows.mapInArrow(run, schema)


def write_locations(encoded: DataFrame, path: str, run: str, locations: Sequence[Location]) -> DataFrame:
    """Stores encoded rows under ``path/run=/layer=/module=`` with one commit (the
    encoder runs once) and returns a row of metadata per location, counted in what
    was written. A location without rows raises."""
    spark = encoded.sparkSession
    encoded.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "layer", "module").parquet(path)
    stored = spark.read.option("basePath", path).parquet(f"{path}/run={run}")
    meta = stored.groupBy("run", "layer", "module").agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vec")).alias("d_in"))
    have = {(int(r["layer"]), r["module"]) for r in meta.select("layer", "module").collect()}
    missing = sorted(set(check_locations(locations)) - have)
    if missing:
        raise ValueError(f"no activations for location {missing[0]}")
    return meta


def at_location(encoded: DataFrame, location: Location) -> DataFrame:
    """The rows of one location, without the columns that name it."""
    layer, module = location
    return encoded.where((F.col("layer") == layer) & (F.col("module") == module)).drop("layer", "module")
