"""Model checkpoints (SRC13, SRC14, SNK9).

A checkpoint is a folder ``{base}/{log_id}/{n_iter}.ckpt/`` holding the
parameter table (Parquet: param, expert, row, vec) and ``state.json``
(token_count, dead_latents, n_iter, log_id). Optimiser moments are rows of the
parameter table too, named ``moment1/...`` and ``moment2/...``.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.sources.files import exists, filesystem, write_bytes

PARAM_SCHEMA = T.StructType([T.StructField("param", T.StringType(), False), T.StructField("expert", T.IntegerType()),
                             T.StructField("row", T.IntegerType(), False),
                             T.StructField("vec", T.ArrayType(T.DoubleType(), False), False)])


def stem_count(path) -> F.Column:
    """Integer stem of a checkpoint file name (null if not an integer)."""
    stem = F.regexp_extract(path, r"([^/.]+)[.][^/]*$", 1)
    return stem.try_cast("bigint")


def checkpoint_catalogue(listing: DataFrame, *, path_col: str = "path", group_cols=()) -> DataFrame:
    """SRC13: among ``*.pt`` / checkpoint paths, the largest strictly positive
    integer stem wins; non-integer stems are skipped; none -> null."""
    x = listing.withColumn("n", stem_count(F.col(path_col))).where(F.col("n") > 0)
    return x.groupBy(*group_cols).agg(F.max_by(path_col, "n").alias("best_path"), F.max("n").alias("token_count"))


def list_checkpoints(spark: SparkSession, prefix: str, glob: str = "*.pt") -> DataFrame:
    """File listing below a prefix (names only; contents are not read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob) \
                .option("recursiveFileLookup", "true").load(prefix).select("path", "length")


def params_frame(spark: SparkSession, params: dict[str, np.ndarray]) -> DataFrame:
    """Model arrays -> param table rows (param, expert, row, vec); 3-D arrays are per expert."""
    rows = []
    for name, arr in params.items():
        a = np.asarray(arr, dtype=np.float64)
        if a.ndim == 1:  # a vector is stored as row -1
            rows.append((name, None, -1, a.tolist()))
        elif a.ndim == 2:
            rows += [(name, None, i, a[i].tolist()) for i in range(a.shape[0])]
        elif a.ndim == 3:
            rows += [(name, e, i, a[e, i].tolist()) for e in range(a.shape[0]) for i in range(a.shape[1])]
        else:
            raise ValueError(f"parameter {name} has rank {a.ndim}")
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def save_checkpoint(spark: SparkSession, base: str, log_id: str, n_iter: int, params: DataFrame,
                    state: dict) -> str:
    """SNK9: parameters to Parquet and state to JSON under ``{base}/{log_id}/{n_iter}.ckpt``."""
    path = f"{base.rstrip('/')}/{log_id}/{int(n_iter)}.ckpt"
    params.write.mode("overwrite").parquet(f"{path}/params")
    st = dict(state)
    st.update({"n_iter": int(n_iter), "log_id": log_id})
    write_bytes(f"{path}/state.json", json.dumps(st).encode())
    return path


def load_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """SRC14: (param table, state). Missing path -> FileNotFoundError; malformed -> ValueError."""
    if not exists(f"{path}/state.json"):
        raise FileNotFoundError(f"no checkpoint at {path}")
    fsys, p = filesystem(f"{path}/state.json")
    with fsys.open_input_stream(p) as f:
        raw = f.read()
    try:
        state = json.loads(raw.decode())
    except (UnicodeDecodeError, json.JSONDecodeError) as ex:
        raise ValueError(f"malformed checkpoint state at {path}") from ex
    for key in ("token_count", "n_iter", "log_id"):
        if key not in state:
            raise ValueError(f"checkpoint state lacks {key}")
    try:
        params = spark.read.schema(PARAM_SCHEMA).parquet(f"{path}/params")
    except Exception as ex:  # noqa: BLE001
        raise ValueError(f"malformed checkpoint parameters at {path}") from ex
    return params, state


def params_to_arrays(params: DataFrame) -> dict[str, np.ndarray]:
    """Collect a (model-sized) parameter table back to arrays."""
    out: dict[str, dict] = {}
    for r in params.collect():
        out.setdefault(r["param"], {})[(r["expert"], r["row"])] = r["vec"]
    arrays = {}
    for name, cells in out.items():
        experts = sorted({e for e, _ in cells if e is not None})
        rows = sorted({i for _, i in cells})
        if experts:
            arrays[name] = np.array([[cells[(e, i)] for i in rows] for e in experts])
        elif rows == [-1]:
            arrays[name] = np.array(cells[(None, -1)])
        else:
            arrays[name] = np.array([cells[(None, i)] for i in rows])
    return arrays


def save_fit(spark: SparkSession, base: str, log_id: str, result, dead_latents=()) -> str:
    """SNK9 for a fit: parameters, optimiser moments, activity counters and lookup
    table of a ``FitResult``."""
    arrays = {**result.params, **{f"moment1/{n}": a for n, a in result.state["m"].items()},
              **{f"moment2/{n}": a for n, a in result.state["v"].items()}, "count/idle": result.state["idle"]}
    params = params_frame(spark, arrays)
    if result.lookup is not None:       # one row per token and kind of value, straight from its table
        for name, column in (("lookup/vec", "vec"), ("lookup/m", "m"), ("lookup/v", "v")):
            params = params.unionByName(result.lookup.select(
                F.lit(name).alias("param"), F.lit(None).cast("int").alias("expert"),
                F.col("token_id").cast("int").alias("row"), F.col(column).alias("vec")))
    return save_checkpoint(spark, base, log_id, result.n_iter, params,
                           {"token_count": int(result.token_count), "dead_latents": [int(f) for f in dead_latents]})


def load_fit(spark: SparkSession, path: str) -> dict:
    """SRC14 for a fit: the ``init``, ``start_token`` and ``state`` arguments of
    ``DictionaryEstimator.fit`` that continue it."""
    params, state = load_checkpoint(spark, path)
    tokens = params.where(F.col("param").startswith("lookup/"))
    arrays = params_to_arrays(params.where(~F.col("param").startswith("lookup/")))

    def named(prefix: str) -> dict[str, np.ndarray]:
        return {n[len(prefix):]: a for n, a in arrays.items() if n.startswith(prefix)}
    out = {"init": {n: a for n, a in arrays.items() if "/" not in n}, "start_token": state["token_count"],
           "state": {"m": named("moment1/"), "v": named("moment2/"), "t": state["n_iter"], **named("count/")}}
    if not tokens.isEmpty():
        out["lookup"] = (tokens.groupBy(F.col("row").cast("bigint").alias("token_id"))
                         .pivot("param", ["lookup/vec", "lookup/m", "lookup/v"]).agg(F.first("vec"))
                         .toDF("token_id", "vec", "m", "v"))
    return out
