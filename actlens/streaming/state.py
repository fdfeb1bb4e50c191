"""Stateful streaming operators (STR3, STR4, STR5, STR7).

* Re-cutting (STR3 blocks, STR7 batches): ``foreachBatch`` with a carry-over
  table. Micro-batch b reads the carry left by b-1, cuts full units, writes
  them under ids derived from the running count, and stores its own carry -
  every write is keyed by the batch id, so a replayed micro-batch rewrites
  identical files (idempotent).
* Running top-k (STR4) and last activity (STR5): ``transformWithStateInPandas``
  keyed by feature; state is one small JSON value per feature.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from actlens.operators import ordering as O
from actlens.sources.files import exists, filesystem, write_bytes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# State processors are started by a driver-side Python runner that does not
# see files added with addPyFile: their classes travel by value (they only use
# json and pandas).
try:  # pragma: no cover - depends on the bundled cloudpickle
    import sys as _sys

    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass


def use_rocksdb(spark: SparkSession) -> None:
    """State processors need the RocksDB state store (set before a query starts)."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != ROCKSDB:
        spark.conf.set(key, ROCKSDB)


class Recutter:
    """foreachBatch function: re-cut arriving rows into units of exactly ``rows``.

    ``emit(units_df)`` receives rows with ``unit_id`` and ``row_in_unit``; the
    remainder (< rows) is carried to the next micro-batch. ``flush()`` emits the
    final short unit when the stream is closed (``keep_partial``).
    """

    def __init__(self, spark: SparkSession, state_path: str, rows: int, order_cols: Sequence[str],
                 emit: Callable[[DataFrame], None]):
        if rows < 1:
            raise ValueError("unit size must be positive")
        self.spark, self.state, self.rows = spark, state_path.rstrip("/"), rows
        self.order, self.emit = list(order_cols), emit

    def _read_state(self, batch_id: int) -> tuple[int, DataFrame | None]:
        if batch_id < 0 or not exists(f"{self.state}/count/{batch_id}.json"):
            return 0, None
        fsys, p = filesystem(f"{self.state}/count/{batch_id}.json")
        with fsys.open_input_stream(p) as f:
            emitted = json.loads(f.read().decode())["emitted"]
        carry = self.spark.read.parquet(f"{self.state}/carry/{batch_id}")
        return emitted, carry

    def _last_batch(self) -> int:
        fsys, p = filesystem(f"{self.state}/count")
        try:
            infos = fsys.get_file_info(__import__("pyarrow.fs", fromlist=["FileSelector"]).FileSelector(p))
        except FileNotFoundError:
            return -1
        ids = [int(i.base_name.split(".")[0]) for i in infos if i.base_name.endswith(".json")]
        return max(ids) if ids else -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        emitted, carry = self._read_state(batch_id - 1)
        x = batch.withColumn("_arrival", F.lit(batch_id).cast("bigint"))
        if carry is not None:
            x = carry.unionByName(x)
        n = x.count()
        x = O.running_index(x, ["_arrival", *self.order], name="_gi")
        full = (n // self.rows) * self.rows
        units = x.where(F.col("_gi") < full) \
                 .withColumn("unit_id", F.floor((F.col("_gi") + F.lit(emitted)) / F.lit(self.rows)).cast("bigint")) \
                 .withColumn("row_in_unit", ((F.col("_gi") + F.lit(emitted)) % F.lit(self.rows)).cast("bigint"))
        if full:
            self.emit(units.drop("_gi"))
        x.where(F.col("_gi") >= full).drop("_gi").write.mode("overwrite").parquet(f"{self.state}/carry/{batch_id}")
        write_bytes(f"{self.state}/count/{batch_id}.json", json.dumps({"emitted": emitted + full}).encode())

    def flush(self) -> None:
        last = self._last_batch()
        emitted, carry = self._read_state(last)
        if carry is None:
            return
        x = O.running_index(carry, ["_arrival", *self.order], name="_gi")
        units = x.withColumn("unit_id", F.floor((F.col("_gi") + F.lit(emitted)) / F.lit(self.rows)).cast("bigint")) \
                 .withColumn("row_in_unit", ((F.col("_gi") + F.lit(emitted)) % F.lit(self.rows)).cast("bigint"))
        if units.limit(1).count():
            self.emit(units.drop("_gi"))


# ------------------------------------------------------------------ STR4

TOPK_OUT = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("rank", T.LongType()),
                         T.StructField("sample_id", T.LongType()), T.StructField("value", T.DoubleType())])


class RunningTopK(StatefulProcessor):
    """Per feature the k largest positive values seen so far (ties: lower sample)."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "payload STRING")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cur = json.loads(self.best.get()[0]) if self.best.exists() else []
        for pdf in rows:
            pos = pdf[pdf["value"] > 0]
            cur += list(zip(pos["sample_id"].astype("int64").tolist(), pos["value"].astype(float).tolist()))
            cur = sorted(cur, key=lambda t: (-t[1], t[0]))[: self.k]
        self.best.update((json.dumps(cur),))
        f = int(key[0])
        yield pd.DataFrame({"feature": [f] * len(cur), "rank": list(range(1, len(cur) + 1)),
                            "sample_id": [s for s, _ in cur], "value": [v for _, v in cur]})

    def close(self) -> None:
        pass


def stream_topk(stream: DataFrame, k: int, *, feature_col: str = "feature") -> DataFrame:
    """STR4: running top-k per feature, merged batch by batch (update mode)."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(feature_col).transformWithStateInPandas(
        statefulProcessor=RunningTopK(k), outputStructType=TOPK_OUT, outputMode="Update", timeMode="None")


# ------------------------------------------------------------------ STR5

LAST_OUT = T.StructType([T.StructField("feature", T.IntegerType()), T.StructField("last_active", T.LongType())])


class LastActive(StatefulProcessor):
    """Per feature the latest batch (on the batch clock) where it was active."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "batch LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cur = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            act = pdf[pdf["value"] > 0]
            if len(act):
                m = int(act["batch_id"].max())
                cur = m if cur is None else max(cur, m)
        if cur is not None:
            self.last.update((cur,))
            yield pd.DataFrame({"feature": [int(key[0])], "last_active": [cur]})

    def close(self) -> None:
        pass


def stream_last_active(stream: DataFrame, *, feature_col: str = "feature") -> DataFrame:
    """STR5: counter state per feature, reset by activity (kept as last active batch)."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(feature_col).transformWithStateInPandas(
        statefulProcessor=LastActive(), outputStructType=LAST_OUT, outputMode="Update", timeMode="None")
