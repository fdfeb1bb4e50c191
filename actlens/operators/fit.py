"""Fitting dictionaries by distributed gradient sums (FIT1, FIT2).

One optimisation step works on one training batch:

1. the current parameters reach the tasks: broadcast (``Held``), or as a table of
   blocks joined to slices of the rows (``Tabled``, see ``fit_tables``);
2. the batch is normalised where asked: by the moments of the whole batch (a
   first pass that merges partial moments), or row by row;
3. every task scores its rows inside Arrow batches and accumulates the
   closed-form gradient sums of the loss (no autograd);
4. each task emits its partial sums cut into row blocks of a few megabytes,
   which are added by key in rounds of at most ``ADD_FAN_IN`` partials, so no
   group grows with the number of tasks (``gradient_blocks``);
5. Adam is applied to the summed gradients.

The cut of batch top-k is a property of the whole batch: its exact value comes
from four counting passes over the bits of the activations, so the batch may
have any number of rows and tasks. Features that no row of the last batches used
are dead; the auxiliary loss lets the best of them explain what the rest missed,
which needs one more pass for the features that the batch itself uses.

The lookup model adds a vector per token to the reconstruction. Its table is
joined with the batch, and its gradients are keyed by token: a step moves the
rows of the batch's tokens only, their moments included.

Training batches come from ``ordering.shuffle_batches`` written partitioned
by ``batch_id``, so each step reads only its own partition.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.operators.scoring import Dictionary, _softmax, _topk_rows, _vec_matrix
from actlens.session import materialize

FIT1_ARCHS = ("relu", "topk", "switch_topk", "lookup_switch_topk")
FIT2_ARCHS = ("batch_topk", "topk_relu", "vanilla", "jumprelu")
BLOCK_BYTES = 4 << 20        # one partial gradient block
ADD_FAN_IN = 32              # partial blocks added by one group
MAX_MODEL_BYTES = 4 << 30    # parameters held by the driver and each executor
TOKEN_BYTES = 64 << 20       # gradients of tokens that a task holds before it hands them on
ACTIVE_OVER = 1e-3           # a latent above this makes its feature active (first family)


@dataclass(frozen=True)
class Step:
    """What one step minimises, and over what."""

    arch: str
    n_total: int
    k: int | None = None
    l1: float = 0.0
    bandwidth: float = 1e-3
    lookup_scale: float = 0.5
    norm: str | None = None                 # None, "batch" or "unit"
    moments: tuple | None = None            # mean and deviation of the batch
    cut: float | None = None                # smallest activation that batch top-k keeps
    dead: np.ndarray | None = None          # features that the auxiliary loss may use
    top_k_aux: int = 0
    aux_penalty: float = 0.0

    def prepared(self, x: np.ndarray) -> np.ndarray:
        if self.norm == "unit":
            return unit_norm(x)[0]
        if self.norm == "batch":
            return (x - self.moments[0]) / (self.moments[1] + 1e-6)
        return x


def unit_norm(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without their mean, over their deviation; and both, to undo it."""
    mean = x.mean(axis=1, keepdims=True)
    x = x - mean
    std = x.std(axis=1, ddof=1, keepdims=True)
    return x / (std + 1e-5), mean, std


# ----------------------------------------------------------------- gradients

def grads_fit1(p: dict, x: np.ndarray, arch: str, k: int | None, l1_coefficient: float,
               n_total: int, added: np.ndarray | None = None) -> tuple[dict, dict]:
    """Sums over the rows of x of the gradients of the batch loss (rows of the
    whole batch = n_total): relu -> vp_mse + c * L1; topk / switch_topk -> vp_mse.

    ``added`` is what the lookup adds to each reconstruction; the gradient of
    every row's reconstruction is then in the statistics (``rows_grad``)."""
    n, d = x.shape
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    xc = x - p["pre_b"]
    g = {name: np.zeros_like(v) for name, v in p.items() if isinstance(v, np.ndarray)}
    if arch in ("relu", "topk"):
        z = xc @ p["enc"].T
        if arch == "relu":
            a = np.maximum(z, 0.0)
            mask = (z > 0).astype(float)
        else:
            idx, vals = _topk_rows(z, k)
            a = np.zeros_like(z)
            np.put_along_axis(a, idx, vals, axis=1)
            mask = np.zeros_like(z)
            np.put_along_axis(mask, idx, 1.0, axis=1)
        recon = a @ p["dec"] + p["pre_b"]
        delta = x - recon
        gr = -2.0 * delta / norm / (n_total * d)            # dL/d recon
        g["dec"] = a.T @ gr
        g["pre_b"] = gr.sum(axis=0)
        da = gr @ p["dec"].T
        if arch == "relu":
            da = da + l1_coefficient * np.sign(a) / n_total
        dz = da * mask
        g["enc"] = dz.T @ xc
        g["pre_b"] -= (dz @ p["enc"]).sum(axis=0)
        l1 = np.abs(a).sum()
        active = (a > ACTIVE_OVER).sum(axis=0)
    elif arch in ("switch_topk", "lookup_switch_topk"):
        n_exp = p["router"].shape[0]
        xr = x - p["router_b"]
        probs = _softmax(xr @ p["router"].T)
        e = probs.argmax(axis=1)
        pmax = probs[np.arange(n), e]
        e_dim = p["enc"].shape[0] // n_exp
        recon = np.tile(p["pre_b"], (n, 1))
        dec_out = np.zeros((n, d))
        parts = []
        active = np.zeros(p["enc"].shape[0])
        for ex in np.unique(e):
            sel = np.nonzero(e == ex)[0]
            sl = slice(ex * e_dim, (ex + 1) * e_dim)
            z = xc[sel] @ p["enc"][sl].T
            idx, vals = _topk_rows(z, k)
            a = np.zeros_like(z)
            np.put_along_axis(a, idx, vals, axis=1)
            mask = np.zeros_like(z)
            np.put_along_axis(mask, idx, 1.0, axis=1)
            dec_out[sel] = a @ p["dec"][sl]
            active[sl] = (a > ACTIVE_OVER).sum(axis=0)
            parts.append((sel, sl, a, mask))
        recon += pmax[:, None] * dec_out
        if added is not None:
            recon += added
        delta = x - recon
        gr = -2.0 * delta / norm / (n_total * d)
        g["pre_b"] = gr.sum(axis=0)
        for sel, sl, a, mask in parts:
            gs = gr[sel] * pmax[sel, None]
            g["dec"][sl] += a.T @ gs
            dz = (gs @ p["dec"][sl].T) * mask
            g["enc"][sl] += dz.T @ xc[sel]
            g["pre_b"] -= (dz @ p["enc"][sl]).sum(axis=0)
        dpmax = (gr * dec_out).sum(axis=1)
        dprob = np.zeros_like(probs)
        dprob[np.arange(n), e] = dpmax
        dlogit = probs * (dprob - (probs * dprob).sum(axis=1, keepdims=True))
        g["router"] = dlogit.T @ xr
        g["router_b"] = -(dlogit @ p["router"]).sum(axis=0)
        l1 = 0.0
    else:
        raise ValueError(f"unknown architecture {arch!r}")
    stats = {"loss_sum": float(((delta * delta) / norm + 1e-9).sum() / (n_total * d)),
             "se_sum": float((delta * delta).sum()), "l1_sum": float(l1), "rows": n}
    if arch == "relu":
        stats["loss_sum"] += l1_coefficient * float(l1) / n_total
    stats["active"] = active
    if added is not None:
        stats["rows_grad"] = gr
    return g, stats


def grads_fit2(p: dict, x: np.ndarray, arch: str, k: int | None, l1_coefficient: float, n_total: int,
               *, bandwidth: float = 1e-3, batch_keep: int | None = None, threshold: float | None = None,
               pre_enc_bias: bool = False, dead: np.ndarray | None = None, top_k_aux: int = 0,
               aux_penalty: float = 0.0) -> tuple[dict, dict]:
    """Second family: l2 = mean (recon - x)^2; batch_topk / topk_relu / vanilla add
    c * L1 and centre their input by ``b_dec``; jumprelu adds c * L0 with a rectangle
    pseudo-gradient for the log thresholds and centres only with ``pre_enc_bias``.

    ``threshold`` is the smallest activation that batch top-k keeps (values equal to
    it are all kept); without it the rows of x are taken as the whole batch.

    With ``dead`` features (a mask) the top-k models add aux_penalty * mean (r - e)^2,
    where e is what the reconstruction missed and r is decoded from the row's
    ``top_k_aux`` best activations among the dead features."""
    n, d = x.shape
    centred = arch != "jumprelu" or pre_enc_bias
    xc = x - p["b_dec"] if centred else x
    acts = np.maximum(xc @ p["enc"].T + p["b_enc"], 0.0)
    g = {name: np.zeros_like(v) for name, v in p.items() if isinstance(v, np.ndarray)}
    if arch == "jumprelu":
        theta = np.exp(p["log_threshold"])
        a = np.where(acts > theta, acts, 0.0)
    elif arch == "vanilla":
        a = acts
    elif arch == "topk_relu":
        idx, vals = _topk_rows(acts, k)
        a = np.zeros_like(acts)
        np.put_along_axis(a, idx, vals, axis=1)
    elif arch == "batch_topk":
        if threshold is None:
            keep = min(batch_keep if batch_keep is not None else k * n, acts.size)
            threshold = np.partition(acts.ravel(), acts.size - keep)[acts.size - keep]
        a = np.where(acts >= threshold, acts, 0.0)
    else:
        raise ValueError(f"unknown architecture {arch!r}")
    on = a > 0
    delta = a @ p["dec"] + p["b_dec"] - x
    gr = 2.0 * delta / (n_total * d)
    aux = 0.0
    spare = np.flatnonzero(dead) if dead is not None and arch in ("batch_topk", "topk_relu") else np.zeros(0, int)
    if len(spare):
        own = acts[:, spare]
        idx, vals = _topk_rows(own, min(top_k_aux, len(spare)))
        b = np.zeros_like(own)
        np.put_along_axis(b, idx, vals, axis=1)
        missed = b @ p["dec"][spare] + delta
        ga = 2.0 * aux_penalty * missed / (n_total * d)
        aux = aux_penalty * float((missed * missed).sum()) / (n_total * d)
        gr = gr + ga
    g["dec"] = a.T @ gr
    g["b_dec"] = gr.sum(axis=0)
    da = gr @ p["dec"].T
    if arch == "jumprelu":
        def window(v):
            return (np.abs((v - theta) / bandwidth) < 0.5) / bandwidth
        # both pseudo-gradients are taken with respect to the log threshold
        g["log_threshold"] = -(da * theta * window(acts)).sum(axis=0) - l1_coefficient * window(a).sum(axis=0) / n_total
        extra = float(on.sum())
    else:
        da = da + l1_coefficient * np.sign(a) / n_total
        extra = float(a.sum())
    dpre = da * on
    if len(spare):
        g["dec"][spare] += b.T @ ga
        dpre[:, spare] += (ga @ p["dec"][spare].T) * (b > 0)
    g["enc"] = dpre.T @ xc
    g["b_enc"] = dpre.sum(axis=0)
    if centred:
        g["b_dec"] -= (dpre @ p["enc"]).sum(axis=0)
    se = float((delta * delta).sum())
    stats = {"loss_sum": se / (n_total * d) + l1_coefficient * extra / n_total + aux, "se_sum": se,
             "l1_sum": extra, "rows": n, "aux_sum": aux, "active": on.sum(axis=0)}
    return g, stats


# ------------------------------------------------------- distributed sums

_BLOCKS = T.StructType([T.StructField("param", T.StringType()), T.StructField("block", T.LongType()),
                        T.StructField("part", T.IntegerType()), T.StructField("g", T.BinaryType())])
_BLOCKS_ARROW = pa.schema([pa.field("param", pa.string()), pa.field("block", pa.int64()),
                           pa.field("part", pa.int32()), pa.field("g", pa.binary())])
LOOKUP = "lookup"            # rows of this name are gradients of one token, ``block`` is its id

#: a task's work: its parameters, its batches, its number
RowWork = Callable[[dict, Iterator[pa.RecordBatch], int], Iterator[pa.RecordBatch]]


class Held:
    """Parameters held by the driver and broadcast once."""

    def __init__(self, spark, params: dict):
        if sum(v.nbytes for v in params.values()) > MAX_MODEL_BYTES:
            raise ValueError(f"the parameters take more than {MAX_MODEL_BYTES} bytes")
        self.bc = spark.sparkContext.broadcast(params)

    def map(self, rows: DataFrame, work: RowWork, schema) -> DataFrame:
        bc = self.bc
        return rows.mapInArrow(lambda batches: work(bc.value, batches, TaskContext.get().partitionId()), schema)

    def parts(self, rows: DataFrame) -> int:
        return rows.rdd.getNumPartitions()


class Tabled:
    """Parameters as a table (param, block, value): every slice of the rows gets all
    blocks through one shuffle and sees them before its rows. Nothing of the model
    passes the driver; the blocks travel ``slices`` times a pass."""

    def __init__(self, table: DataFrame, slices: int):
        self.table, self.slices = table.select("param", "block", "value"), slices

    def map(self, rows: DataFrame, work: RowWork, schema) -> DataFrame:
        own = [(f.name, f.dataType) for f in rows.schema.fields]
        model = self.table.select(F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("__slice"),
                                  F.lit(0).alias("__kind"), F.col("param").alias("__param"), F.col("block").alias("__block"),
                                  F.col("value").alias("__value"), *[F.lit(None).cast(t).alias(c) for c, t in own])
        data = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(self.slices)).cast("int").alias("__slice"),
                           F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("__param"),
                           F.lit(None).cast("bigint").alias("__block"), F.lit(None).cast("binary").alias("__value"),
                           *[c for c, _ in own])
        dealt = (model.unionByName(data).repartition(self.slices, "__slice")
                 .sortWithinPartitions("__slice", "__kind", "__param", "__block"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, pieces in itertools.groupby(_runs(batches, ("__slice", "__kind")), key=lambda piece: piece[0][0]):
                found: dict[str, list] = {}
                first = []
                for (_, kind), piece in pieces:
                    if kind:
                        first = [piece]
                        break
                    for name, value in zip(piece.column("__param").to_pylist(), piece.column("__value")):
                        found.setdefault(name, []).append(_unblob(value.as_py()))
                params = {name: np.concatenate(blocks) for name, blocks in found.items()}
                left = itertools.chain(first, (piece for _, piece in pieces))
                yield from work(params, (piece.select([c for c, _ in own]) for piece in left), part)

        return dealt.mapInArrow(run, schema)

    def parts(self, rows: DataFrame) -> int:
        return self.slices


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Cuts batches where a key changes: (key values, rows that share them)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero(np.any(np.diff(k, axis=1), axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(k[:, a].tolist()), batch.slice(a, b - a)


def _block_rows(width: int, block_bytes: int | None = None) -> int:
    return max(1, (block_bytes or BLOCK_BYTES) // (8 * max(1, width)))


def _block_row(name: str, block: int, part: int, a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"param": name, "block": block, "part": part, "g": _blob(a)}], schema=_BLOCKS_ARROW)


def _add_blocks(tbl: pa.Table) -> pa.Table:
    total = None
    for g in tbl.column("g"):
        a = _unblob(g.as_py())
        total = a if total is None else total + a
    first = tbl.slice(0, 1).to_pylist()[0]
    return pa.table({"param": [first["param"]], "block": [first["block"]], "part": [first["part"]],
                     "g": [_blob(total)]}, schema=_BLOCKS_ARROW)


def _matrices(batches: Iterator[pa.RecordBatch], p: dict, step: Step, vec_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their normalised vectors), as many rows as make 64 MB of activations."""
    rows = max(1, (1 << 23) // p["enc"].shape[0])
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            some = b.slice(lo, rows)
            yield some, step.prepared(_vec_matrix(some.column(vec_col), p["enc"].shape[1]))


class _TokenSums:
    """Gradient sums by token, at most about ``most`` bytes of them held."""

    def __init__(self, part: int, most: int):
        self.part, self.most, self.sums = part, most, {}

    def add(self, tokens: np.ndarray, grad: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(tokens, kind="stable")
        names, start = np.unique(tokens[order], return_index=True)
        for t, g in zip(names.tolist(), np.add.reduceat(grad[order], start, axis=0) if len(start) else []):
            self.sums[t] = self.sums[t] + g if t in self.sums else g
        if len(self.sums) * grad.shape[1] * 8 > self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = sorted(self.sums)
        for at in range(0, len(names), 1000):
            some = names[at:at + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([LOOKUP] * len(some)), pa.array(some, pa.int64()), pa.array([self.part] * len(some), pa.int32()),
                 pa.array([_blob(self.sums[t]) for t in some], pa.binary())], schema=_BLOCKS_ARROW)
        self.sums = {}


def _gradient_work(step: Step, vec_col: str) -> RowWork:
    block_bytes, token_bytes = BLOCK_BYTES, TOKEN_BYTES      # as the driver has them

    def work(p: dict, batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        acc, st, active = None, {}, 0.0
        tokens = _TokenSums(part, token_bytes)
        for some, x in _matrices(batches, p, step, vec_col):
            if step.arch in FIT1_ARCHS:
                added, known = None, None
                if step.arch == "lookup_switch_topk":
                    known = some.column("token_vec").is_valid().to_numpy(zero_copy_only=False)
                    added = np.zeros_like(x)
                    added[known] = step.lookup_scale * _vec_matrix(some.column("token_vec").drop_null(), x.shape[1])
                gr, s = grads_fit1(p, x, step.arch, step.k, step.l1, step.n_total, added)
                if added is not None:
                    ids = some.column("token_id").to_numpy(zero_copy_only=False)[known].astype(np.int64)
                    yield from tokens.add(ids, step.lookup_scale * s.pop("rows_grad")[known])
            else:
                gr, s = grads_fit2(p, x, step.arch, step.k, step.l1, step.n_total, bandwidth=step.bandwidth, threshold=step.cut,
                                   dead=step.dead, top_k_aux=step.top_k_aux, aux_penalty=step.aux_penalty)
            active = active + s.pop("active")
            acc = gr if acc is None else {name: acc[name] + gr[name] for name in acc}
            st = {name: st.get(name, 0.0) + v for name, v in s.items()}
        if acc is None:
            return
        yield from tokens.flush()
        sums = {**acc, "__active": np.asarray(active, float), **{f"__{name}": np.array([float(v)]) for name, v in st.items()}}
        for name, arr in sums.items():
            size = _block_rows(arr[0].size, block_bytes)
            for bi, lo in enumerate(range(0, arr.shape[0], size)):
                yield _block_row(name, bi, part, arr[lo:lo + size])
    return work


def added_blocks(partials: DataFrame, parts: int) -> DataFrame:
    """Adds partial blocks by key in rounds of at most ``ADD_FAN_IN``."""
    while True:
        parts = -(-parts // ADD_FAN_IN)
        partials = partials.withColumn("part", F.floor(F.col("part") / F.lit(ADD_FAN_IN)).cast("int")) \
                           .groupBy("param", "block", "part").applyInArrow(_add_blocks, _BLOCKS)
        if parts <= 1:
            return partials


def step_gradients(batch: DataFrame, source: Held | Tabled, step: Step, *, vec_col: str = "vec") -> tuple[DataFrame, DataFrame | None]:
    """Gradient sums of one step over ``batch``: blocks (param, block, part, g), one row
    per row block of every parameter (``__``-names carry the scalars of the loss and
    the activity of the features), and for the lookup model (token_id, g)."""
    tokens = ["token_id", "token_vec"] if step.arch == "lookup_switch_topk" else []
    src = batch.select(vec_col, *tokens)
    partials = source.map(src, _gradient_work(step, vec_col), _BLOCKS)
    if not tokens:
        return added_blocks(partials, source.parts(src)), None
    partials = materialize(partials, "fit-partials")        # two readers
    return (added_blocks(partials.where(F.col("param") != LOOKUP), source.parts(src)),
            token_gradients(partials.where(F.col("param") == LOOKUP)))


def token_gradients(partials: DataFrame) -> DataFrame:
    """(token_id, g): the partial sums of every token added in one ordered pass; a
    task before sends a token once or a few times, so a frequent token stays small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None

        def row(names: list, sums: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums, pa.list_(pa.float64()))],
                                              names=["token_id", "g"])
        for b in batches:
            names, sums = [], []
            for t, g in zip(b.column(0).to_pylist(), b.column(1)):
                g = _unblob(g.as_py())
                if t != held and held is not None:
                    names.append(held)
                    sums.append(total)
                held, total = t, g if t != held else total + g
            yield row(names, sums)
        if held is not None:
            yield row([held], [total])

    return (partials.select(F.col("block").alias("token_id"), "g").repartition("token_id").sortWithinPartitions("token_id")
            .mapInArrow(run, "token_id bigint, g array<double>"))


def gradient_blocks(batch: DataFrame, params: dict, arch: str, *, k: int | None = None, l1_coefficient: float = 0.0,
                    n_total: int, vec_col: str = "vec", bandwidth: float = 1e-3, norm: str | None = None) -> DataFrame:
    """Gradient sums of one step from parameters held by the driver, as blocks."""
    source = Held(batch.sparkSession, params)
    step = prepared_step(batch, source, Step(arch, n_total, k, l1_coefficient, bandwidth, norm=norm), vec_col)
    return step_gradients(batch, source, step, vec_col=vec_col)[0]


def prepared_step(batch: DataFrame, source: Held | Tabled, step: Step, vec_col: str = "vec",
                  idle: np.ndarray | None = None, dead_after: int | None = None) -> Step:
    """``step`` with what only the whole batch tells: its moments, the cut of batch
    top-k, and the dead features. ``idle`` counts the batches since a feature was
    last used; a feature that this batch uses is not dead."""
    if step.norm == "batch":
        step = replace(step, moments=batch_moments(batch.select(vec_col), vec_col))
    if step.arch == "batch_topk":
        step = replace(step, cut=_cut(batch.select(vec_col), source, step, vec_col))
    if step.aux_penalty and idle is not None and (idle + 1 >= dead_after).any():
        used = feature_activity(batch.select(vec_col), source, step, vec_col)
        step = replace(step, dead=(idle + 1 >= dead_after) & (used == 0))
    return step


def _merge_moments(tbl: pa.Table) -> pa.Table:
    n, mean, m2 = 0.0, 0.0, 0.0
    for g in tbl.column("g"):
        k, mu, sq = _unblob(g.as_py())
        both = n + k[0]
        m2 = m2 + sq + (mu - mean) ** 2 * n * k[0] / both
        mean = mean + (mu - mean) * k[0] / both
        n = both
    first = tbl.slice(0, 1).to_pylist()[0]
    out = np.stack([np.full_like(mean, n), mean, m2])
    return pa.table({"param": ["moments"], "block": [0], "part": [first["part"]], "g": [_blob(out)]}, schema=_BLOCKS_ARROW)


def batch_moments(rows: DataFrame, vec_col: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of every dimension. Each task merges the moments of
    its batches; the tasks' moments are merged in rounds of ``ADD_FAN_IN``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for b in batches:
            if b.num_rows:
                x = _vec_matrix(b.column(0), int(b.column(0).value_lengths()[0].as_py()))
                mean = x.mean(axis=0)
                now = _block_row("moments", 0, part, np.stack([np.full_like(mean, len(x)), mean, ((x - mean) ** 2).sum(axis=0)]))
                held = now if held is None else _merge_moments(pa.Table.from_batches([held, now])).to_batches()[0]
        if held is not None:
            yield held

    found = rows.select(vec_col).mapInArrow(run, _BLOCKS)
    parts = rows.rdd.getNumPartitions()
    while True:
        parts = -(-parts // ADD_FAN_IN)
        found = found.withColumn("part", F.floor(F.col("part") / F.lit(ADD_FAN_IN)).cast("int")) \
                     .groupBy("part").applyInArrow(_merge_moments, _BLOCKS)
        if parts <= 1:
            break
    got = found.first()
    if got is None:
        raise ValueError("an empty batch has no moments")
    n, mean, m2 = _unblob(bytes(got["g"]))
    return mean, np.sqrt(m2 / np.maximum(n - 1, 1))


def feature_activity(rows: DataFrame, source: Held | Tabled, step: Step, vec_col: str = "vec") -> np.ndarray:
    """How many rows of the batch use each feature (second family)."""
    def work(p: dict, batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        used = np.zeros(p["enc"].shape[0])
        for _, x in _matrices(batches, p, step, vec_col):
            acts = np.maximum((x - p["b_dec"]) @ p["enc"].T + p["b_enc"], 0.0)
            if step.arch == "topk_relu":
                idx, vals = _topk_rows(acts, step.k)
                np.add.at(used, idx[vals > 0], 1)
            else:
                used += (acts >= max(step.cut, np.nextafter(0, 1))).sum(axis=0)
        yield _block_row("__active", 0, part, used)

    found = added_blocks(source.map(rows, work, _BLOCKS), source.parts(rows)).collect()     # one value per feature
    return _unblob(bytes(found[0]["g"])) if found else np.zeros(0)


def gradient_table(blocks: DataFrame, params: dict, scale: float = 1.0) -> DataFrame:
    """(param, row, dim, grad) of summed blocks, times ``scale``; a vector is row 0."""
    vectors = {name for name, v in params.items() if v.ndim == 1}
    steps = {name: _block_rows(v[0].size) for name, v in params.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                name, a = r["param"], _unblob(r["g"])
                first = r["block"] * steps[name]
                row, dim = ((np.zeros(len(a), dtype=np.int64), first + np.arange(len(a))) if name in vectors else
                            (first + np.repeat(np.arange(a.shape[0]), a.shape[1]), np.tile(np.arange(a.shape[1]), a.shape[0])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * a.size, pa.string()), pa.array(row.astype(np.int32)),
                     pa.array(dim.astype(np.int32)), pa.array(a.ravel() * scale)], names=["param", "row", "dim", "grad"])

    return blocks.where(~F.col("param").startswith("__")).mapInArrow(run, "param STRING, row INT, dim INT, grad DOUBLE")


def batch_cut(src: DataFrame, params: dict, keep: int, vec_col: str = "vec") -> float:
    """The ``keep``-th largest activation of a batch (0.0 if fewer are positive)."""
    return _cut(src, Held(src.sparkSession, params), Step("batch_topk", keep, 1), vec_col)


def _cut(src: DataFrame, source: Held | Tabled, step: Step, vec_col: str) -> float:
    """The k x n-th largest activation. Positive doubles sort as their bits do: each
    pass counts 16 further bits among the values that share the bits found so far -
    at most 65,536 counts a task."""
    def counts(prefix: int, level: int) -> RowWork:
        def work(p: dict, batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << 16, dtype=np.int64)
            for _, x in _matrices(batches, p, step, vec_col):
                acts = np.maximum((x - p["b_dec"]) @ p["enc"].T + p["b_enc"], 0.0).ravel()
                bits = acts[acts > 0].view(np.int64)
                if level:
                    bits = bits[(bits >> (64 - 16 * level)) == prefix]
                total += np.bincount((bits >> (48 - 16 * level)) & 0xFFFF, minlength=1 << 16)
            hit = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bin", "n"])
        return work

    keep, prefix = step.k * step.n_total, 0
    for level in range(4):
        found = source.map(src.select(vec_col), counts(prefix, level), "bin INT, n BIGINT").groupBy("bin") \
                      .agg(F.sum("n").alias("n")).orderBy(F.desc("bin")).collect()     # at most 65,536 counts
        for r in found:
            if keep <= r["n"]:
                prefix = (prefix << 16) | r["bin"]
                break
            keep -= r["n"]
        else:
            return 0.0
    return float(np.array([prefix], dtype=np.int64).view(np.float64)[0])


# ----------------------------------------------------------------- estimator

def _blob(a: np.ndarray) -> bytes:
    buf = io.BytesIO()
    np.save(buf, a, allow_pickle=False)
    return buf.getvalue()


def _unblob(b: bytes) -> np.ndarray:
    return np.load(io.BytesIO(b), allow_pickle=False)


@dataclass
class FitResult:
    params: dict
    history: list = field(default_factory=list)
    token_count: int = 0
    n_iter: int = 0
    state: dict = field(default_factory=dict)
    lookup: DataFrame | None = None      # token_id, vec, m, v of the lookup model

    def dictionary(self) -> Dictionary:
        p = self.params
        if "b_dec" in p:
            return Dictionary(enc=p["enc"], dec=p["dec"], pre_b=p["b_dec"], b_enc=p["b_enc"],
                              log_threshold=p.get("log_threshold"))
        return Dictionary(enc=p["enc"], dec=p["dec"], pre_b=p["pre_b"], router=p.get("router"),
                          router_b=p.get("router_b"), n_experts=p["router"].shape[0] if "router" in p else 1)


def adam(value: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, t: int, lr: float,
         betas: tuple[float, float], eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value and both moments after step ``t``."""
    m = betas[0] * m + (1 - betas[0]) * g
    v = betas[1] * v + (1 - betas[1]) * g * g
    return value - lr * (m / (1 - betas[0] ** t)) / (np.sqrt(v / (1 - betas[1] ** t)) + eps), m, v


def unit_decoder(dec: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decoder rows go back to unit length and move only across their direction."""
    dec = dec / np.maximum(np.linalg.norm(dec, axis=1, keepdims=True), 1e-12)
    return dec, grad - (grad * dec).sum(axis=1, keepdims=True) * dec


def lookup_table(tokens: DataFrame) -> DataFrame:
    """(token_id, vec) with empty moments, written once."""
    zero = F.transform("vec", lambda x: F.lit(0.0))
    return materialize(tokens.select(F.col("token_id").cast("bigint").alias("token_id"),
                                     F.col("vec").cast("array<double>").alias("vec"))
                       .withColumns({"m": zero, "v": zero}), "fit-lookup")


def lookup_step(table: DataFrame, grads: DataFrame, t: int, lr: float, betas: tuple[float, float], eps: float) -> DataFrame:
    """The lookup table after step ``t``: rows with a gradient move, the others stay as they are."""
    b1, b2 = betas
    m = F.zip_with("m", "g", lambda a, g: b1 * a + (1 - b1) * g)
    v = F.zip_with("v", "g", lambda a, g: b2 * a + (1 - b2) * g * g)
    moved = (table.join(grads, "token_id", "left")
             .withColumns({"m2": F.when(F.col("g").isNull(), F.col("m")).otherwise(m),
                           "v2": F.when(F.col("g").isNull(), F.col("v")).otherwise(v)}))
    way = F.zip_with("m2", "v2", lambda a, b: lr * (a / (1 - b1 ** t)) / (F.sqrt(b / (1 - b2 ** t)) + eps))
    vec = F.when(F.col("g").isNull(), F.col("vec")).otherwise(F.zip_with("vec", way, lambda x, w: x - w))
    return materialize(moved.select("token_id", vec.alias("vec"), F.col("m2").alias("m"), F.col("v2").alias("v")), "fit-lookup")


def with_token_vectors(batch: DataFrame, table: DataFrame) -> DataFrame:
    """The batch and the lookup's vector of each row's token (null: token not in the table)."""
    return batch.join(table.select("token_id", F.col("vec").alias("token_vec")), "token_id", "left")


class DictionaryEstimator:
    """FIT1 / FIT2: mini-batch Adam over shuffled training batches.

    ``batch_norm`` normalises every batch by its moments, ``input_unit_norm`` every
    row by its own. ``aux_penalty`` adds the auxiliary loss over features that
    ``dead_after`` batches have not used (top-k models of the second family).
    The share of features unused for ``tokens_till_dead`` rows is in the history."""

    def __init__(self, architecture: str, n_features: int, *, k: int | None = None, n_experts: int | None = None,
                 lr: float = 1e-3, l1_coefficient: float = 0.0, n_tokens: int | None = None, seed: int = 42,
                 betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, init_threshold: float = 1.0,
                 bandwidth: float = 1e-3, batch_norm: bool = False, input_unit_norm: bool = False,
                 lookup_scale: float = 0.5, aux_penalty: float = 0.0, top_k_aux: int = 512, dead_after: int = 5,
                 tokens_till_dead: int = 10_000_000):
        if architecture not in FIT1_ARCHS + FIT2_ARCHS:
            raise ValueError(f"unknown architecture {architecture!r}")
        if architecture in ("topk", "switch_topk", "lookup_switch_topk", "topk_relu", "batch_topk") and not k:
            raise ValueError("k is required for top-k architectures")
        if architecture in ("switch_topk", "lookup_switch_topk") and (not n_experts or n_features % n_experts):
            raise ValueError(f"{n_experts} experts cannot share {n_features} features evenly")
        if batch_norm and input_unit_norm:
            raise ValueError("a batch is normalised by its moments or by rows, not both")
        if aux_penalty and architecture not in ("batch_topk", "topk_relu"):
            raise ValueError("the auxiliary loss belongs to the top-k models of the second family")
        self.arch, self.n_features, self.k, self.n_experts = architecture, n_features, k, n_experts
        self.lr, self.l1, self.n_tokens, self.seed = lr, l1_coefficient, n_tokens, seed
        self.betas, self.eps, self.init_threshold, self.bandwidth = betas, eps, init_threshold, bandwidth
        self.norm = "batch" if batch_norm else "unit" if input_unit_norm else None
        self.lookup_scale, self.aux_penalty, self.top_k_aux = lookup_scale, aux_penalty, top_k_aux
        self.dead_after, self.tokens_till_dead = dead_after, tokens_till_dead

    def init_params(self, d_in: int) -> dict:
        rng = np.random.default_rng(self.seed)
        F_ = self.n_features
        if self.arch in FIT1_ARCHS:
            enc = rng.standard_normal((F_, d_in)) / np.sqrt(2) / np.sqrt(d_in)
            p = {"pre_b": rng.standard_normal(d_in) * 0.01, "enc": enc, "dec": enc.copy()}
            if self.n_experts and self.arch != "topk" and self.arch != "relu":
                p["router_b"] = rng.standard_normal(d_in) * 0.01
                p["router"] = rng.standard_normal((self.n_experts, d_in)) / np.sqrt(d_in)
            if self.arch == "lookup_switch_topk":
                p["dec"] *= 1 - self.lookup_scale
            return p
        bound = np.sqrt(6.0 / d_in)  # kaiming-uniform on the decoder, rows unit norm, tied transpose
        dec = rng.uniform(-bound, bound, (F_, d_in))
        dec /= np.linalg.norm(dec, axis=1, keepdims=True)
        p = {"b_dec": np.zeros(d_in), "b_enc": np.zeros(F_), "enc": dec.copy(), "dec": dec}
        if self.arch == "jumprelu":
            p["log_threshold"] = np.full(F_, np.log(self.init_threshold))
        return p

    def step(self, n_total: int) -> Step:
        return Step(self.arch, n_total, self.k, self.l1, self.bandwidth, self.lookup_scale, self.norm,
                    top_k_aux=self.top_k_aux, aux_penalty=self.aux_penalty)

    def _step_sums(self, batch: DataFrame, params: dict, vec_col: str, n_total: int,
                   idle: np.ndarray | None = None) -> tuple[dict, dict, DataFrame | None]:
        """Gradients and scalars of one step, and the gradients of tokens."""
        source = Held(batch.sparkSession, params)
        step = prepared_step(batch, source, self.step(n_total), vec_col, idle, self.dead_after)
        blocks, tokens = step_gradients(batch, source, step, vec_col=vec_col)
        grads: dict[str, dict] = {}
        for r in blocks.collect():       # parameter-sized
            grads.setdefault(r["param"], {})[r["block"]] = _unblob(bytes(r["g"]))
        sums = {name: np.concatenate([parts[i] for i in sorted(parts)]) for name, parts in grads.items()}
        stats = {name[2:]: a if name == "__active" else float(a[0]) for name, a in sums.items() if name.startswith("__")}
        return {name: a for name, a in sums.items() if not name.startswith("__")}, stats, tokens

    def _idle(self, idle: np.ndarray, active: np.ndarray, rows: int) -> np.ndarray:
        """Rows (first family) or batches (second) since each feature was used."""
        gap = rows if self.arch in FIT1_ARCHS else 1
        if self.arch in FIT1_ARCHS:
            return np.where(active > 0, 0, idle) + gap
        return np.where(active > 0, 0, idle + gap)

    def _record(self, row, batch_col: str, n_step: int, stats: dict, idle: np.ndarray, seen: int, d_in: int) -> dict:
        limit = self.tokens_till_dead if self.arch in FIT1_ARCHS else self.dead_after
        return {"step": n_step, "batch": row[batch_col], "loss": stats["loss_sum"],
                "mse": stats["se_sum"] / (stats["rows"] * d_in), "tokens": seen, "aux_loss": stats.get("aux_sum", 0.0),
                "dead_share": float((idle >= limit).mean())}

    def _steps(self, batches: DataFrame, batch_col: str, start_token: int, max_steps: int | None) -> Iterator[tuple]:
        """(batch row, rows seen with it): whole batches in order, from ``start_token`` up to ``n_tokens``."""
        sizes = batches.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n")).orderBy(batch_col).collect()  # one row per batch
        seen, steps = 0, 0
        for row in sizes:
            if seen < start_token:        # resume: skip whole batches already consumed
                seen += row["n"]
                continue
            if (self.n_tokens is not None and seen >= self.n_tokens) or (max_steps is not None and steps >= max_steps):
                return
            seen, steps = seen + row["n"], steps + 1
            yield row, seen

    def fit(self, batches: DataFrame, *, vec_col: str = "vec", batch_col: str = "batch_id",
            init: dict | None = None, start_token: int = 0, state: dict | None = None,
            max_steps: int | None = None, lookup: DataFrame | None = None) -> FitResult:
        """Train on batches in ``batch_col`` order; resume at ``start_token`` with
        saved ``init`` params and optimiser ``state``; stop once n_tokens were seen.

        The lookup model takes ``lookup`` (token_id, vec), or the table of an earlier
        fit with its moments, and reads ``token_id`` of the batches."""
        d_in = len(batches.select(vec_col).first()[0])
        params = {k_: np.array(v, dtype=np.float64) for k_, v in (init or self.init_params(d_in)).items()}
        state = state or {}
        m = state.get("m") or {k_: np.zeros_like(v) for k_, v in params.items()}
        v2 = state.get("v") or {k_: np.zeros_like(v) for k_, v in params.items()}
        t = state.get("t", 0)
        idle = np.array(state.get("idle", np.zeros(self.n_features)), dtype=np.float64)
        if self.arch == "lookup_switch_topk":
            if lookup is None:
                raise ValueError("the lookup model needs a token table")
            lookup = lookup if "m" in lookup.columns else lookup_table(lookup)
        res = FitResult(params=params, token_count=start_token if state else 0)
        for row, seen in self._steps(batches, batch_col, start_token, max_steps):
            batch = batches.where(F.col(batch_col) == row[batch_col])
            if lookup is not None:
                batch = with_token_vectors(batch, lookup)
            grads, stats, tokens = self._step_sums(batch, params, vec_col, int(row["n"]), idle)
            t += 1
            if self.arch in FIT2_ARCHS:
                params["dec"], grads["dec"] = unit_decoder(params["dec"], grads["dec"])
            for name, g in grads.items():
                params[name], m[name], v2[name] = adam(params[name], m[name], v2[name], g, t, self.lr, self.betas, self.eps)
            if tokens is not None:
                lookup = lookup_step(lookup, tokens, t, self.lr, self.betas, self.eps)
            idle = self._idle(idle, stats["active"], int(row["n"]))
            res.token_count = seen
            res.history.append(self._record(row, batch_col, len(res.history), stats, idle, seen, d_in))
        res.params, res.n_iter, res.lookup = params, t, lookup
        res.state = {"m": m, "v": v2, "t": t, "idle": idle}
        return res
