"""Scoring vectors against sparse dictionaries (MOD1-MOD13, JOI7-JOI9).

Parameters are model-sized (features x d_in), never data-sized: they are
collected once, size-checked and broadcast. The dense product never leaves
an Arrow batch; only the sparse latents ``(keys..., expert, feature, value)``
are emitted, so the output grows with k, not with the number of features.
When a dictionary exceeds the broadcast limit it is scored in feature slices
(each slice broadcast on its own) and the per-slice top-k candidates are
merged with one window, which is exact because the union of per-slice top-k
sets contains the global top-k.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.session import materialize

# Largest parameter block broadcast at once (bytes of float64 values).
MAX_BROADCAST_BYTES = 512 * 1024 * 1024
# latents (rows x features) that one step inside a task holds densely: 32 MB
DENSE_VALUES = 1 << 22

ARCHITECTURES = ("relu", "topk", "topk_relu", "batch_topk", "vanilla", "jumprelu",
                 "switch", "switch_topk")


@dataclass
class Dictionary:
    """Dense parameters of one dictionary; rows of ``enc``/``dec`` are features."""
    enc: np.ndarray                      # (n_features, d_in)
    dec: np.ndarray                      # (n_features, d_in)
    pre_b: np.ndarray                    # (d_in,)  subtracted before encoding
    b_enc: np.ndarray | None = None      # (n_features,)
    log_threshold: np.ndarray | None = None  # (n_features,)
    router: np.ndarray | None = None     # (n_experts, d_in)
    router_b: np.ndarray | None = None   # (d_in,)
    n_experts: int = 1
    extra: dict = field(default_factory=dict)

    @property
    def n_features(self) -> int:
        return int(self.enc.shape[0])

    @property
    def d_in(self) -> int:
        return int(self.enc.shape[1])

    def nbytes(self) -> int:
        arrays = [self.enc, self.dec, self.pre_b, self.b_enc, self.log_threshold,
                  self.router, self.router_b]
        return int(sum(a.nbytes for a in arrays if a is not None))

    def check(self) -> None:
        if self.enc.shape != self.dec.shape:
            raise ValueError("enc and dec must have the same shape")
        if self.n_features % self.n_experts:
            raise ValueError(f"{self.n_experts} experts cannot share {self.n_features} features evenly")

    def feature_slice(self, lo: int, hi: int) -> "Dictionary":
        return Dictionary(
            enc=self.enc[lo:hi], dec=self.dec[lo:hi], pre_b=self.pre_b,
            b_enc=None if self.b_enc is None else self.b_enc[lo:hi],
            log_threshold=None if self.log_threshold is None else self.log_threshold[lo:hi],
            router=self.router, router_b=self.router_b, n_experts=1,
            extra={"offset": lo})

    def expert_slice(self, lo: int, hi: int) -> "Dictionary":
        """Experts lo .. hi - 1 with the whole router (every slice routes alike)."""
        per = self.n_features // self.n_experts
        return Dictionary(enc=self.enc[lo * per:hi * per], dec=self.dec[lo * per:hi * per], pre_b=self.pre_b,
                          router=self.router, router_b=self.router_b, n_experts=hi - lo,
                          extra={"offset": lo * per, "first_expert": lo})

    def slices(self, by_expert: bool = False) -> list["Dictionary"]:
        """Slices of features (or whole experts) that each fit the broadcast limit."""
        if self.nbytes() <= MAX_BROADCAST_BYTES:
            return [self]
        n, cut = (self.n_experts, self.expert_slice) if by_expert else (self.n_features, self.feature_slice)
        one = cut(0, 1).nbytes()
        each = max(1, cut(0, min(2, n)).nbytes() - one)
        step = max(1, (MAX_BROADCAST_BYTES - (one - each)) // each)     # one - each: parts every slice carries whole
        return [cut(lo, min(lo + step, n)) for lo in range(0, n, step)]


def _vec_matrix(arr: pa.Array, d: int) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        raise ValueError("null vector in input")
    lengths = arr.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths.min() != d or lengths.max() != d):
        raise ValueError(f"vector length differs from d_in={d}")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(-1, d)


def _topk_rows(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k largest values, ordered by value desc then feature index asc."""
    n, f = values.shape
    k = min(k, f)
    if n == 0 or k == 0:
        return np.empty((n, k), dtype=np.int64), np.empty((n, k))
    if k == f:
        idx = np.argsort(-values, axis=1, kind="stable")
    else:
        idx = np.argpartition(-values, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(values, idx, axis=1).min(axis=1)
        tied = np.nonzero((values >= kth[:, None]).sum(axis=1) > k)[0]
        if len(tied):  # rows with ties at the k-th value: exact stable order
            idx[tied] = np.argsort(-values[tied], axis=1, kind="stable")[:, :k]
        vals = np.take_along_axis(values, idx, axis=1)
        idx = np.take_along_axis(idx, np.lexsort((idx, -vals), axis=1), axis=1)
    return idx.astype(np.int64), np.take_along_axis(values, idx, axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _row_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches whose rows x width stay within ``DENSE_VALUES``."""
    rows = max(1, DENSE_VALUES // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def _product(n: int, r: np.ndarray, f: np.ndarray, v: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """Sums of v * dec[f] per row r, as one matrix product."""
    lat = np.zeros((n, dec.shape[0]))
    np.add.at(lat, (r, f), v)
    return lat @ dec


def _encode_block(x: np.ndarray, p: dict, arch: str, k: int | None):
    """Return (row, expert, feature, value, p_max) arrays for one block of rows."""
    n = x.shape[0]
    offset = p.get("offset", 0)
    if arch in ("switch", "switch_topk"):
        probs = _softmax((x - p["router_b"]) @ p["router"].T)
        expert = probs.argmax(axis=1)
        pmax = probs[np.arange(n), expert]
        e_dim = p["enc"].shape[0] // p["n_experts"]
        first = p.get("first_expert", 0)
        rows, feats, vals = [], [], []
        for e in np.unique(expert):
            if not first <= e < first + p["n_experts"]:
                continue                # another slice holds this expert
            sel = np.nonzero(expert == e)[0]
            enc_e = p["enc"][(e - first) * e_dim:(e - first + 1) * e_dim]
            pre = (x[sel] - p["pre_b"]) @ enc_e.T
            if arch == "switch":
                lat = np.maximum(pre, 0.0)
                r, f = np.nonzero(lat > 0)
                rows.append(sel[r]); feats.append(f + e * e_dim); vals.append(lat[r, f])
            else:
                idx, v = _topk_rows(pre, k)
                rows.append(np.repeat(sel, idx.shape[1])); feats.append(idx.ravel() + e * e_dim)
                vals.append(v.ravel())
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        feats = np.concatenate(feats) if feats else np.empty(0, np.int64)
        vals = np.concatenate(vals) if vals else np.empty(0)
        e_of = feats // e_dim
        return rows, e_of, feats, vals, pmax[rows]
    centred = x - p["pre_b"]
    pre = centred @ p["enc"].T
    if p.get("b_enc") is not None:
        pre = pre + p["b_enc"]
    if arch in ("relu", "vanilla"):
        lat = np.maximum(pre, 0.0)
        r, f = np.nonzero(lat > 0)
        v = lat[r, f]
    elif arch == "jumprelu":
        lat = np.maximum(pre, 0.0)
        thr = np.exp(p["log_threshold"])
        lat = np.where(lat > thr, lat, 0.0)
        r, f = np.nonzero(lat > 0)
        v = lat[r, f]
    elif arch == "topk":
        idx, vv = _topk_rows(pre, k)
        r = np.repeat(np.arange(n), idx.shape[1]); f = idx.ravel(); v = vv.ravel()
    elif arch == "topk_relu":
        idx, vv = _topk_rows(np.maximum(pre, 0.0), k)
        r = np.repeat(np.arange(n), idx.shape[1]); f = idx.ravel(); v = vv.ravel()
        keep = v > 0
        r, f, v = r[keep], f[keep], v[keep]
    else:
        raise ValueError(f"unknown architecture {arch!r}")
    return r, np.zeros_like(f), f + offset, v, np.ones(len(r))


def _latent_schema(df: DataFrame, key_cols: Sequence[str], with_route: bool) -> T.StructType:
    fields = [df.schema[c] for c in key_cols]
    fields += [T.StructField("expert", T.IntegerType(), False),
               T.StructField("feature", T.IntegerType(), False),
               T.StructField("value", T.DoubleType(), False)]
    if with_route:
        fields.append(T.StructField("p_max", T.DoubleType(), False))
    return T.StructType(fields)


def _params_of(d: Dictionary) -> dict:
    p = {"enc": d.enc, "dec": d.dec, "pre_b": d.pre_b, "b_enc": d.b_enc,
         "log_threshold": d.log_threshold, "router": d.router, "router_b": d.router_b,
         "n_experts": d.n_experts}
    p.update(d.extra)
    return p


def _broadcast(spark: SparkSession, d: Dictionary):
    if d.nbytes() > MAX_BROADCAST_BYTES:
        raise ValueError(f"dictionary block of {d.nbytes()} bytes exceeds the broadcast limit")
    return spark.sparkContext.broadcast(_params_of(d))


def _score_once(df: DataFrame, d: Dictionary, arch: str, k: int | None,
                key_cols: Sequence[str], vec_col: str, with_route: bool) -> DataFrame:
    spark = df.sparkSession
    bc = _broadcast(spark, d)
    schema = _latent_schema(df, key_cols, with_route)
    dim = d.d_in
    keys = list(key_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = bc.value
        for b in _row_blocks(batches, p["enc"].shape[0]):
            x = _vec_matrix(b.column(vec_col), dim)
            r, e, f, v, pm = _encode_block(x, p, arch, k)
            cols = [b.column(c).take(pa.array(r, pa.int64())) for c in keys]
            cols += [pa.array(e.astype(np.int32)), pa.array(f.astype(np.int32)),
                     pa.array(v.astype(np.float64))]
            if with_route:
                cols.append(pa.array(pm.astype(np.float64)))
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(
                [pa.field(fl.name, _arrow_type(fl.dataType), fl.nullable) for fl in schema.fields]))

    return df.select(*keys, vec_col).mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    mapping = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
               T.StringType: pa.string(), T.FloatType: pa.float32(), T.ShortType: pa.int16(),
               T.BooleanType: pa.bool_()}
    for k_, v_ in mapping.items():
        if isinstance(t, k_):
            return v_
    raise TypeError(f"unsupported key type {t}")


def encode(df: DataFrame, d: Dictionary, arch: str, *, k: int | None = None,
           key_cols: Sequence[str] = ("sample_id", "pos"), vec_col: str = "vec",
           with_route: bool = False) -> DataFrame:
    """Score every vector; emit sparse latents ``(keys, expert, feature, value)``.

    relu/vanilla/jumprelu/switch emit values > 0; topk emits the k largest
    pre-activations per row (negative ones too); topk_relu emits the positive
    part of the per-row top-k.
    """
    if arch not in ARCHITECTURES or arch == "batch_topk":
        if arch == "batch_topk":
            raise ValueError("use encode_batch_topk")
        raise ValueError(f"unknown architecture {arch!r}")
    d.check()
    if arch in ("topk", "topk_relu", "switch_topk") and (k is None or k < 1):
        raise ValueError("k must be a positive integer")
    keys = list(key_cols)
    parts = [_score_once(df, part, arch, k, keys, vec_col, with_route)
             for part in d.slices(by_expert=arch in ("switch", "switch_topk"))]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    if len(parts) > 1 and arch in ("topk", "topk_relu"):
        w = Window.partitionBy(*keys).orderBy(F.col("value").desc(), F.col("feature"))
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    return out


CUT_SHIFT = 44       # bits of a double left out of its bin: 20 stay, 256 bins between two powers of two


def encode_batch_topk(df: DataFrame, d: Dictionary, k: int, *, batch_col: str = "batch_id",
                      key_cols: Sequence[str] = ("sample_id", "pos"),
                      vec_col: str = "vec") -> DataFrame:
    """MOD5: relu pre-activations, keep the k*n largest of each batch of n rows.

    A first pass counts, per batch, the values by the leading bits of their
    doubles (positive doubles sort as their bits do). The bin that holds the
    k*n-th value is the batch's cut. The second pass emits the values above the
    cut, which stay, and those inside its narrow bin, of which one window per
    batch keeps the best that are still missing. Equal values go by keys and
    feature."""
    d.check()
    keys = list(key_cols)
    spark = df.sparkSession
    x = df.select(*keys, batch_col, vec_col)
    parts = [_broadcast(spark, part) for part in d.slices()]
    cuts = materialize(_batch_cuts(x, parts, k, batch_col, vec_col, d.d_in), "batch-cuts")
    fields = [x.schema[c] for c in keys] + [x.schema[batch_col]]
    schema = T.StructType(fields + [
        T.StructField("feature", T.IntegerType(), False), T.StructField("value", T.DoubleType(), False),
        T.StructField("_need", T.LongType())])
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType), f.nullable) for f in schema.fields])

    def run(bc, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pre in _relu_blocks(batches, bc.value, vec_col, d.d_in):
            cut = b.column("_cut").to_numpy(zero_copy_only=False)[:, None]
            bins = pre.view(np.int64) >> CUT_SHIFT
            r, f = np.nonzero((pre > 0) & (bins >= cut))
            take = pa.array(r, pa.int64())
            # a row inside the cut's bin carries how many of them the batch still needs
            need = pa.array(b.column("_need").to_numpy(zero_copy_only=False)[r], mask=bins[r, f] > cut[r, 0])
            cols = [b.column(c).take(take) for c in [*keys, batch_col]]
            cols += [pa.array((f + bc.value.get("offset", 0)).astype(np.int32)), pa.array(pre[r, f]), need]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    ready = x.join(cuts, on=batch_col, how="inner")
    found = materialize(reduce(DataFrame.unionByName, [ready.mapInArrow(partial(run, bc), schema) for bc in parts]), "batch-top")
    w = Window.partitionBy(batch_col).orderBy(F.col("value").desc(), *[F.col(c) for c in keys], F.col("feature"))
    edge = found.where(F.col("_need").isNotNull()).withColumn("_r", F.row_number().over(w)) \
                .where(F.col("_r") <= F.col("_need")).drop("_r")
    return found.where(F.col("_need").isNull()).unionByName(edge).drop("_need")


def _relu_blocks(batches: Iterator[pa.RecordBatch], p: dict, vec_col: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their positive parts of the pre-activations) in bounded row blocks."""
    for b in _row_blocks(batches, p["enc"].shape[0]):
        bias = 0 if p["b_enc"] is None else p["b_enc"]
        yield b, np.maximum((_vec_matrix(b.column(vec_col), dim) - p["pre_b"]) @ p["enc"].T + bias, 0.0)


def _batch_cuts(x: DataFrame, parts: list, k: int, batch_col: str, vec_col: str, dim: int) -> DataFrame:
    """(batch, _cut, _need): the bin of the k*n-th value of each batch (-1: fewer
    values are positive) and how many values of this bin are kept."""
    arrow_type = _arrow_type(x.schema[batch_col].dataType)
    schema = T.StructType([x.schema[batch_col], T.StructField("_bin", T.LongType()), T.StructField("_n", T.LongType())])

    def run(bc, first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, pre in _relu_blocks(batches, bc.value, vec_col, dim):
            names = b.column(batch_col)
            codes = names.dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False)
            r, f = np.nonzero(pre)
            bins = pre[r, f].view(np.int64) >> CUT_SHIFT
            key, n = np.unique(code[r].astype(np.int64) << (64 - CUT_SHIFT) | bins, return_counts=True)
            who, at = key >> (64 - CUT_SHIFT), key & ((1 << (64 - CUT_SHIFT)) - 1)
            if first:           # the batch's rows are counted once, whatever the model's slices
                rows = np.bincount(code, minlength=len(codes.dictionary))
                who, at, n = (np.concatenate(v) for v in ((who, np.arange(len(rows))), (at, np.full(len(rows), -1)), (n, rows)))
            yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(who)).cast(arrow_type), pa.array(at.astype(np.int64)),
                                              pa.array(n.astype(np.int64))], names=[batch_col, "_bin", "_n"])

    src = x.select(batch_col, vec_col).where(F.col(batch_col).isNotNull())
    counts = reduce(DataFrame.unionByName, [src.mapInArrow(partial(run, bc, i == 0), schema) for i, bc in enumerate(parts)])
    counts = counts.groupBy(batch_col, "_bin").agg(F.sum("_n").alias("_n"))
    down = Window.partitionBy(batch_col).orderBy(F.col("_bin").desc())      # a few thousand bins a batch
    before = F.coalesce(F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keep = F.max(F.when(F.col("_bin") == -1, F.col("_n"))).over(Window.partitionBy(batch_col)) * F.lit(k)
    at = counts.withColumns({"_before": before, "_keep": keep}) \
               .where((F.col("_before") < F.col("_keep")) & ((F.col("_before") + F.col("_n") >= F.col("_keep")) | (F.col("_bin") == -1)))
    # bin -1 holds no values; it is the cut of a batch with fewer positive ones
    return at.groupBy(batch_col).agg(F.max(F.struct("_bin", (F.col("_keep") - F.col("_before")).alias("_need"))).alias("c")) \
             .select(batch_col, F.col("c._bin").alias("_cut"), F.col("c._need").alias("_need"))


def decode(latents: DataFrame, d: Dictionary, *, key_cols: Sequence[str] = ("sample_id", "pos"),
           feature_col: str = "feature", value_col: str = "value",
           add_pre_b: bool = True, scale_col: str | None = None) -> DataFrame:
    """MOD9/JOI7: reconstruction ``latent . dec (+ pre_b)`` as long rows (keys, dim, recon).

    The k latents of a row are gathered by one shuffle on the row key (k rows
    per sample, bounded), then the decoder rows are gathered from the
    broadcast matrix inside Arrow batches.
    """
    keys = list(key_cols)
    parts = d.slices()
    if len(parts) > 1:
        # each slice decodes its own features; the partial sums meet on (keys, dim)
        sums = []
        for part in parts:
            lo = part.extra["offset"]
            mine = latents.where((F.col(feature_col) >= lo) & (F.col(feature_col) < lo + part.n_features)) \
                          .withColumn(feature_col, (F.col(feature_col) - F.lit(lo)).cast("int"))
            sums.append(decode(mine, part, key_cols=keys, feature_col=feature_col, value_col=value_col,
                               add_pre_b=False, scale_col=scale_col))
        out = reduce(DataFrame.unionByName, sums).groupBy(*keys, "dim").agg(F.sum("recon").alias("recon"))
        if not add_pre_b:
            return out
        bias = F.array(*[F.lit(float(v)) for v in d.pre_b])
        return out.withColumn("recon", F.col("recon") + F.get(bias, F.col("dim")))
    agg = [F.collect_list(F.struct(F.col(feature_col).alias("f"), F.col(value_col).alias("v"))).alias("_lat")]
    if scale_col:
        agg.append(F.first(scale_col).alias("_scale"))
    grouped = latents.groupBy(*keys).agg(*agg)
    spark = latents.sparkSession
    bc = _broadcast(spark, d)
    schema = T.StructType([latents.schema[c] for c in keys] + [
        T.StructField("dim", T.IntegerType(), False),
        T.StructField("recon", T.DoubleType(), False)])
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType), f.nullable)
                              for f in schema.fields])
    dim = d.d_in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = bc.value
        dec = p["dec"]
        for b in _row_blocks(batches, max(dec.shape)):
            n = b.num_rows
            lat = b.column("_lat")
            lens = lat.value_lengths().to_numpy(zero_copy_only=False)
            inner = lat.flatten()
            f = inner.field("f").to_numpy(zero_copy_only=False)
            v = inner.field("v").to_numpy(zero_copy_only=False)
            if len(f) and (f.max() >= dec.shape[0] or f.min() < 0):
                raise ValueError("feature index outside the dictionary")
            row = np.repeat(np.arange(n), lens)
            out = _product(n, row, f, v, dec)
            if scale_col:
                out *= b.column("_scale").to_numpy(zero_copy_only=False)[:, None]
            if add_pre_b:
                out += p["pre_b"]
            take = pa.array(np.repeat(np.arange(n), dim), pa.int64())
            cols = [b.column(c).take(take) for c in keys]
            cols += [pa.array(np.tile(np.arange(dim, dtype=np.int32), n)), pa.array(out.ravel())]
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return grouped.mapInArrow(run, schema)


def active_features(latents: DataFrame, group_cols: Sequence[str] = ("batch_id",),
                    threshold: float = 1e-3) -> DataFrame:
    """MOD10: per batch (and expert) a feature is active if its max value > 1e-3."""
    g = [*group_cols, "expert", "feature"]
    return latents.groupBy(*g).agg(F.max("value").alias("max_value")) \
                  .withColumn("active", F.col("max_value") > F.lit(threshold))


def expert_share(routes: DataFrame, n_experts: int, *, group_cols: Sequence[str] = ()) -> DataFrame:
    """MOD11: share of rows routed to each expert (0 when unused) and mean p_max.

    ``routes`` has one row per scored vector with columns expert, p_max.
    """
    g = list(group_cols)
    total = routes.groupBy(*g).agg(F.count(F.lit(1)).alias("_tot"))
    per = routes.groupBy(*g, "expert").agg(F.count(F.lit(1)).alias("_n"), F.avg("p_max").alias("mean_p_max"))
    base = total.withColumn("expert", F.explode(F.sequence(F.lit(0), F.lit(n_experts - 1))))
    out = base.join(per, on=[*g, "expert"], how="left")
    return out.select(*g, "expert",
                      (F.coalesce(F.col("_n"), F.lit(0)) / F.col("_tot")).alias("share"),
                      F.col("mean_p_max"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, z: acc + z)


def reconstruct(df: DataFrame, d: Dictionary, arch: str, *, k: int | None = None,
                key_cols: Sequence[str] = ("sample_id", "pos"), vec_col: str = "vec",
                keep_cols: Sequence[str] = ()) -> DataFrame:
    """Encode and decode in the same Arrow pass: (keys, vec, recon, l0, l1).

    No shuffle: the reconstruction of a row never leaves the batch that
    scored it. ``l0`` counts latents > 0, ``l1`` sums |latent| per row.
    Switch models scale the expert's decode by the winning probability.
    """
    d.check()
    spark = df.sparkSession
    bc = _broadcast(spark, d)
    keys = list(key_cols) + [c for c in keep_cols if c not in key_cols]
    base = [df.schema[c] for c in keys]
    schema = T.StructType(base + [
        T.StructField("vec", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("recon", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("l0", T.LongType(), False),
        T.StructField("l1", T.DoubleType(), False)] + [
        T.StructField(c, T.DoubleType(), False) for c in ROW_STATS])
    dim = d.d_in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = bc.value
        for b in _row_blocks(batches, max(p["enc"].shape)):
            n = b.num_rows
            x = _vec_matrix(b.column(vec_col), dim)
            r, e, f, v, pm = _encode_block(x, p, arch, k)
            scaled = v * pm if arch in ("switch", "switch_topk") else v
            out = _product(n, r, f, scaled, p["dec"]) + p["pre_b"]
            l0 = np.bincount(r[v > 0], minlength=n).astype(np.int64)
            l1 = np.bincount(r, weights=np.abs(v), minlength=n)
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            cols = [b.column(c) for c in keys]
            cols += [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())),
                     pa.ListArray.from_arrays(offsets, pa.array(out.ravel())),
                     pa.array(l0), pa.array(l1)]
            delta = x - out
            mean_row = x.mean(axis=1, keepdims=True)
            stats = {"se": (delta * delta).sum(axis=1), "sx": x.sum(axis=1), "sxx": (x * x).sum(axis=1),
                     "var_row": ((x - mean_row) ** 2).sum(axis=1), "n_dims": np.full(n, float(dim))}
            cols += [pa.array(stats[c]) for c in ROW_STATS]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.select(*keys, vec_col).mapInArrow(run, schema)


ROW_STATS = ("se", "sx", "sxx", "var_row", "n_dims")


def route(df: DataFrame, d: Dictionary, *, key_cols: Sequence[str] = ("sample_id", "pos"),
          vec_col: str = "vec") -> DataFrame:
    """Router probabilities as long rows (keys, expert, p, chosen) - n_experts rows per vector."""
    if d.router is None:
        raise ValueError("dictionary has no router")
    spark = df.sparkSession
    if d.router.nbytes + d.router_b.nbytes > MAX_BROADCAST_BYTES:
        raise ValueError("router larger than the broadcast limit")
    bc = spark.sparkContext.broadcast({"router": d.router, "router_b": d.router_b})
    keys = list(key_cols)
    schema = T.StructType([df.schema[c] for c in keys] + [
        T.StructField("expert", T.IntegerType(), False), T.StructField("p", T.DoubleType(), False),
        T.StructField("chosen", T.BooleanType(), False)])
    dim = d.d_in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = bc.value
        m = p["router"].shape[0]
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            x = _vec_matrix(b.column(vec_col), dim)
            probs = _softmax((x - p["router_b"]) @ p["router"].T)
            win = probs.argmax(axis=1)
            take = pa.array(np.repeat(np.arange(n), m), pa.int64())
            cols = [b.column(c).take(take) for c in keys]
            cols += [pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(probs.ravel()),
                     pa.array((np.tile(np.arange(m), n) == np.repeat(win, m)))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return df.select(*keys, vec_col).mapInArrow(run, schema)


def contrastive_loss(df: DataFrame, *, group_col: str, a_col: str, b_col: str) -> DataFrame:
    """MOD13: per group (a batch, bounded by the batch size) the mean of row-wise
    and column-wise cross-entropy of logits a_i . b_j with diagonal targets."""
    gschema = T.StructType([df.schema[group_col], T.StructField("loss", T.DoubleType(), False),
                            T.StructField("n", T.LongType(), False)])

    def per_group(tbl: pa.Table) -> pa.Table:
        a = _vec_matrix(tbl.column(a_col), len(tbl.column(a_col)[0]))
        bm = _vec_matrix(tbl.column(b_col), len(tbl.column(b_col)[0]))
        if a.shape[0] != bm.shape[0]:
            raise ValueError("logits must be square")
        z = a @ bm.T
        def ce(m):
            mx = m.max(axis=1, keepdims=True)
            lse = (mx[:, 0] + np.log(np.exp(m - mx).sum(axis=1)))
            return float(np.mean(lse - np.diag(m)))
        loss = (ce(z) + ce(z.T)) / 2
        g = tbl.column(group_col)[0].as_py()
        return pa.table({group_col: [g], "loss": [loss], "n": [a.shape[0]]},
                        schema=pa.schema([pa.field(group_col, _arrow_type(gschema[group_col].dataType)),
                                          pa.field("loss", pa.float64(), False), pa.field("n", pa.int64(), False)]))

    return df.select(group_col, a_col, b_col).groupBy(group_col).applyInArrow(per_group, gschema)


def aux_loss(df: DataFrame, d: Dictionary, dead_features: Sequence[int], *, k: int, k_aux: int,
             penalty: float, batch_col: str = "batch_id", key_cols: Sequence[str] = ("sample_id", "pos"),
             vec_col: str = "vec") -> DataFrame:
    """MET9: reconstruct the residual of a top-k (relu) model from the top
    min(k_aux, n_dead) dead features of each row; penalty * mse per batch.
    Batches report 0 when no feature is dead."""
    dead = np.array(sorted(set(int(f) for f in dead_features)), dtype=np.int64)
    spark = df.sparkSession
    bc = _broadcast(spark, d)
    bdead = spark.sparkContext.broadcast(dead)
    dim = d.d_in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, dd = bc.value, bdead.value
        for b in _row_blocks(batches, max(p["enc"].shape)):
            n = b.num_rows
            x = _vec_matrix(b.column(vec_col), dim)
            acts = np.maximum((x - p["pre_b"]) @ p["enc"].T, 0.0)
            idx, vals = _topk_rows(acts, k)
            recon = _product(n, np.arange(n)[:, None], idx, vals, p["dec"]) + p["pre_b"]
            if len(dd) == 0:
                se = np.zeros(n)
            else:
                a_dead = acts[:, dd]
                ai, av = _topk_rows(a_dead, min(k_aux, len(dd)))
                aux = _product(n, np.arange(n)[:, None], dd[ai], av, p["dec"])
                se = ((aux - (x - recon)) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(batch_col), pa.array(se), pa.array(np.full(n, dim, dtype=np.int64))],
                names=[batch_col, "se_aux", "n_dims"])

    schema = T.StructType([df.schema[batch_col], T.StructField("se_aux", T.DoubleType(), False),
                           T.StructField("n_dims", T.LongType(), False)])
    rows = df.select(batch_col, vec_col).mapInArrow(run, schema)
    return rows.groupBy(batch_col).agg(
        (F.lit(float(penalty)) * F.sum("se_aux") / F.sum("n_dims")).alias("aux_loss"))


def row_cosines(df: DataFrame, pairs: dict[str, tuple], *, keep: Sequence[str],
                eps: float = 1e-8) -> DataFrame:
    """Row-wise cosines of vector columns in Arrow batches (NumPy over the batch).

    ``pairs`` maps an output name to (a, b): a is a column or a tuple of columns
    (summed), b a column, a tuple of columns or a constant vector;
    norms are clamped at ``eps`` as in the tensor library. Interpreted array
    lambdas would evaluate every element one by one; here each batch is a few
    vectorised products."""
    spark = df.sparkSession
    def cols_of(x):
        return (x,) if isinstance(x, str) else tuple(x) if isinstance(x, tuple) else ()
    consts = {k: np.asarray(b, dtype=np.float64) for k, (_, b) in pairs.items() if not cols_of(b)}
    bc = spark.sparkContext.broadcast(consts)
    vec_cols = sorted({c for a, b in pairs.values() for c in cols_of(a) + cols_of(b)})
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(k, T.DoubleType(), False) for k in pairs])
    arrow_schema = pa.schema([pa.field(f.name, _arrow_type(f.dataType), f.nullable) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cst = bc.value
        for b in batches:
            if b.num_rows == 0:
                continue
            first = b.column(vec_cols[0])
            d = first.value_lengths()[0].as_py()
            mats = {c: _vec_matrix(b.column(c), d) for c in vec_cols}
            cols = [b.column(c) for c in keep]
            for name, (ca, cb) in pairs.items():
                a = sum(mats[c] for c in cols_of(ca))
                bm = sum(mats[c] for c in cols_of(cb)) if cols_of(cb) else cst[name][None, :]
                dot_ = (a * bm).sum(axis=1)
                na = np.maximum(np.sqrt((a * a).sum(axis=1)), eps)
                nb = np.maximum(np.sqrt((bm * bm).sum(axis=1)), eps)
                cols.append(pa.array(dot_ / (na * nb)))
            yield pa.RecordBatch.from_arrays(cols, schema=arrow_schema)

    return df.select(*keep, *vec_cols).mapInArrow(run, schema)
