"""Fitting with the model as a table (FIT1, FIT2).

Parameters and both moments are rows (param, block, value, m, v) of a table in the
shared checkpoint folder; a block is a few megabytes of whole rows of one
parameter. A step brings the blocks to the slices of the batch by one shuffle
(``fit.Tabled``), adds the gradient blocks as the held fit does, joins them to the
state by block, and applies Adam block by block. Neither parameters nor gradients
pass the driver: it sees the scalars of the loss, one activity count per feature
and, for normalised batches, one mean and deviation per dimension.

Every step writes its state before the next one reads it, so a lost executor
re-reads blocks, and a stopped fit continues from the last table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators import fit
from actlens.operators.fit import (FIT1_ARCHS, FIT2_ARCHS, DictionaryEstimator, Tabled, _blob, _block_rows, _unblob, adam,
                                   lookup_step, lookup_table, prepared_step, step_gradients, unit_decoder, with_token_vectors)
from actlens.session import materialize

STATE = "param string, block bigint, value binary, m binary, v binary"


def state_row(name: str, block: int, value: np.ndarray) -> dict:
    zero = _blob(np.zeros_like(value))
    return {"param": name, "block": block, "value": _blob(value), "m": zero, "v": zero}


def state_table(spark: SparkSession, params: dict[str, np.ndarray]) -> DataFrame:
    """The state of parameters that the driver holds (tests, small models)."""
    rows = []
    for name, a in params.items():
        a = np.asarray(a, dtype=np.float64)
        size = _block_rows(a[0].size)
        rows += [state_row(name, i, a[lo:lo + size]) for i, lo in enumerate(range(0, len(a), size))]
    return materialize(spark.createDataFrame(rows, STATE), "fit-state")


def initial_state(spark: SparkSession, est: DictionaryEstimator, d_in: int) -> DataFrame:
    """A fresh state whose blocks are drawn in the tasks, each from its own seed."""
    n, arch = est.n_features, est.arch
    size, long = _block_rows(d_in), _block_rows(1)      # rows of a matrix block, values of a vector block
    wide = ["enc", "dec"]
    vectors = {"pre_b": d_in} if arch in FIT1_ARCHS else {"b_dec": d_in, "b_enc": n}
    if arch.endswith("switch_topk"):
        vectors["router_b"] = d_in
    if arch == "jumprelu":
        vectors["log_threshold"] = n
    blocks = [(name, b) for name in wide for b in range(-(-n // size))]
    blocks += [(name, b) for name, length in vectors.items() for b in range(-(-length // long))]
    if arch.endswith("switch_topk"):
        blocks += [("router", b) for b in range(-(-est.n_experts // size))]

    def draw(name: str, block: int) -> np.ndarray:
        # encoder and decoder start alike: they share the seed
        rng = np.random.default_rng([est.seed, zlib.crc32(b"enc" if name in wide else name.encode()), block])
        if name in vectors:
            length = min(long, vectors[name] - block * long)
            return (rng.standard_normal(length) * 0.01 if arch in FIT1_ARCHS else
                    np.full(length, np.log(est.init_threshold) if name == "log_threshold" else 0.0))
        rows = min(size, (n if name in wide else est.n_experts) - block * size)
        if name == "router":
            return rng.standard_normal((rows, d_in)) / np.sqrt(d_in)
        if arch in FIT1_ARCHS:
            x = rng.standard_normal((rows, d_in)) / np.sqrt(2) / np.sqrt(d_in)
            return x * (1 - est.lookup_scale) if arch == "lookup_switch_topk" and name == "dec" else x
        bound = np.sqrt(6.0 / d_in)
        x = rng.uniform(-bound, bound, (rows, d_in))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _states([state_row(r["param"], r["block"], draw(r["param"], r["block"]))])

    names = spark.createDataFrame(blocks, "param string, block bigint").repartition(max(1, min(len(blocks), 200)))
    return materialize(names.mapInArrow(run, STATE), "fit-state")


def _states(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("param", pa.string()), ("block", pa.int64()), ("value", pa.binary()),
                                                       ("m", pa.binary()), ("v", pa.binary())]))


def adam_blocks(state: DataFrame, grads: DataFrame, est: DictionaryEstimator, t: int) -> DataFrame:
    """The state after step ``t``: one Adam update per block."""
    family2, rate = est.arch in FIT2_ARCHS, (t, est.lr, est.betas, est.eps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, block = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                value, m, v, g = (_unblob(b.column(c)[i].as_py()) for c in range(2, 6))
                if family2 and name == "dec":
                    value, g = unit_decoder(value, g)
                value, m, v = adam(value, m, v, g, *rate)
                yield _states([{"param": name, "block": block, "value": _blob(value), "m": _blob(m), "v": _blob(v)}])

    joined = state.join(grads.select("param", "block", "g"), ["param", "block"])
    return joined.select("param", "block", "value", "m", "v", "g").mapInArrow(run, STATE)


def parameter_rows(state: DataFrame, column: str = "value") -> DataFrame:
    """(param, row, dim, value) of a state; a vector is row 0. ``column`` may be a moment."""
    block_bytes = fit.BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, block, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                a = _unblob(a.as_py())
                first = block * _block_rows(a[0].size, block_bytes)
                row, dim = ((np.zeros(len(a), np.int64), first + np.arange(len(a))) if a.ndim == 1 else
                            (first + np.repeat(np.arange(len(a)), a.shape[1]), np.tile(np.arange(a.shape[1]), len(a))))
                yield pa.RecordBatch.from_arrays([pa.array([name] * a.size), pa.array(row.astype(np.int32)),
                                                  pa.array(dim.astype(np.int32)), pa.array(a.ravel())],
                                                 names=["param", "row", "dim", "value"])

    return state.select("param", "block", column).mapInArrow(run, "param STRING, row INT, dim INT, value DOUBLE")


@dataclass
class TableFit:
    state: DataFrame                     # param, block, value, m, v
    history: list = field(default_factory=list)
    token_count: int = 0
    n_iter: int = 0
    idle: np.ndarray | None = None
    lookup: DataFrame | None = None

    def arrays(self, column: str = "value") -> dict[str, np.ndarray]:
        """The parameters on the driver, for models that fit there."""
        found: dict[str, dict] = {}
        for r in self.state.select("param", "block", column).collect():
            found.setdefault(r["param"], {})[r["block"]] = _unblob(bytes(r[column]))
        return {name: np.concatenate([b[i] for i in sorted(b)]) for name, b in found.items()}


class TableEstimator(DictionaryEstimator):
    """``DictionaryEstimator`` whose parameters stay a table. ``slices`` is the number
    of tasks that a batch is dealt over, and of copies of the model that a pass moves."""

    def __init__(self, architecture: str, n_features: int, *, slices: int = 8, **options):
        super().__init__(architecture, n_features, **options)
        self.slices = slices

    def fit(self, batches: DataFrame, *, vec_col: str = "vec", batch_col: str = "batch_id", init: DataFrame | None = None,
            start_token: int = 0, resume: TableFit | None = None, max_steps: int | None = None,
            lookup: DataFrame | None = None) -> TableFit:
        """Train on batches in order, from ``init`` (a state table), from an earlier
        fit (``resume``), or from fresh blocks."""
        spark = batches.sparkSession
        d_in = batches.select(F.size(vec_col).alias("n")).first()["n"]
        res = resume or TableFit(init if init is not None else initial_state(spark, self, d_in), lookup=lookup,
                                 idle=np.zeros(self.n_features))
        if self.arch == "lookup_switch_topk":
            if res.lookup is None:
                raise ValueError("the lookup model needs a token table")
            res.lookup = res.lookup if "m" in res.lookup.columns else lookup_table(res.lookup)
        out = TableFit(res.state, list(res.history), res.token_count, res.n_iter, res.idle, res.lookup)
        for row, seen in self._steps(batches, batch_col, start_token or res.token_count, max_steps):
            batch = batches.where(F.col(batch_col) == row[batch_col])
            if out.lookup is not None:
                batch = with_token_vectors(batch, out.lookup)
            source = Tabled(out.state, self.slices)
            step = prepared_step(batch, source, self.step(int(row["n"])), vec_col, out.idle, self.dead_after)
            blocks, tokens = step_gradients(batch, source, step, vec_col=vec_col)
            blocks = materialize(blocks, "fit-gradients")       # the update and the scalars read it
            out.n_iter += 1
            out.state = materialize(adam_blocks(out.state, blocks, self, out.n_iter), "fit-state")
            if tokens is not None:
                out.lookup = lookup_step(out.lookup, tokens, out.n_iter, self.lr, self.betas, self.eps)
            parts: dict[str, dict] = {}
            for r in blocks.where(F.col("param").startswith("__")).collect():    # scalars, and one count per feature
                parts.setdefault(r["param"][2:], {})[r["block"]] = _unblob(bytes(r["g"]))
            active = np.concatenate([parts["active"][i] for i in sorted(parts["active"])])
            stats = {name: float(b[0][0]) for name, b in parts.items() if name != "active"}
            out.idle = self._idle(out.idle, active, int(row["n"]))
            out.token_count = seen
            out.history.append(self._record(row, batch_col, len(out.history), stats, out.idle, seen, d_in))
        return out
