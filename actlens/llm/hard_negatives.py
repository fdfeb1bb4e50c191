"""Hard negatives of anchors by segment summary filtering.

Vectors become integers, floor(256 * x). Each vector is cut into segments, level
by level (1, 4, then 16), and of every segment the mean and the deviation (the
length of what is left without the mean) are stored. An inner product then lies
between the products of the means minus and plus the products of the deviations:

    x . y = sum_s n_s * mean_s(x) * mean_s(y) + rest,   |rest| <= sum_s dev_s(x) * dev_s(y)

A pair whose bounds miss what its anchor still wants is dropped; the pairs left
are bounded again by the finer segments; exact integer scores are made for the
rest only. Two searches run this way: the positives of every anchor (same label,
best scores), then, per positive, the best rows of other labels within its band
of scores. The band is known before the second search starts, so whole tiles of
rows are skipped by the ranges of their summaries.

Rows are sorted by label and means and cut into tiles; a tile of anchors (at most
``ANCHOR_TILE`` rows, held) meets a tile of rows (streamed, never held). A tile
pair returns at most the wanted number of rows per anchor and positive, and one
window merges the tiles; a label with a third of all rows is many tiles.

Defined cases: rows with a null id, label or vector, a null or non-finite
component, or a squared integer length of 2^56 or more (its scores would not fit)
take no part; zero and empty vectors do; vectors of different dimensions never
meet; repeated rows are rows of their own (also as anchors, and as positives of
their copies); anchors without a positive, and positives with an empty band
(negative scores) return nothing; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.llm.common import materialize
from actlens.operators.ordering import slice_rows

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: of a positive's score, in percent
LOW, HIGH = 30, 90
LEVELS = (1, 4, 16)
#: level whose ranges describe a tile
TILE_LEVEL = 1
ANCHOR_TILE = 8192
ROW_TILES = 32
SUB_ANCHORS = 1024
BUFFER = 200_000
#: share of surviving pairs below which they are scored one by one
SPARSE = 0.05
_FAR = 1 << 62

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def segment_edges(dim: int, n: int) -> np.ndarray:
    return np.linspace(0, dim, min(n, dim) + 1).astype(np.int64)


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and segment of all levels, one after the other: mean times the root
    of the segment's length, and deviation."""
    means, devs = [], []
    for level in LEVELS:
        edges = segment_edges(x.shape[1], level)
        for a, b in zip(edges[:-1], edges[1:]):
            part = x[:, a:b]
            mean = part.mean(axis=1, keepdims=True)
            means.append(mean[:, 0] * np.sqrt(b - a))
            devs.append(np.sqrt(((part - mean) ** 2).sum(axis=1)))
    if not means:
        return np.zeros((len(x), 0)), np.zeros((len(x), 0))
    return np.stack(means, axis=1), np.stack(devs, axis=1)


def level_slices(dim: int) -> list[slice]:
    ends = np.cumsum([min(level, dim) for level in LEVELS]).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def bounded_scores(a: np.ndarray, a_sum: tuple, v: np.ndarray, v_sum: tuple, floor: np.ndarray, ceil: np.ndarray,
                   open_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the open pairs whose score is within [floor, ceil] of the
    anchor; bounds drop the others level by level."""
    i, j = np.flatnonzero(open_pairs.any(axis=1)), np.flatnonzero(open_pairs.any(axis=0))
    left = open_pairs[np.ix_(i, j)]
    top = float(np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((v * v).sum(axis=1).max(initial=0)))
    slack = 0.5 + 1e-12 * top
    for part in level_slices(a.shape[1]):
        if not len(i) or not len(j):
            break
        mid = a_sum[0][i, part] @ v_sum[0][j, part].T
        off = a_sum[1][i, part] @ v_sum[1][j, part].T
        left &= (mid + off >= floor[i, None] - slack) & (mid - off <= ceil[i, None] + slack)
        rows, cols = left.any(axis=1), left.any(axis=0)
        if rows.sum() * cols.sum() < 0.8 * left.size:
            i, j, left = i[rows], j[cols], left[np.ix_(rows, cols)]
    at, to = np.nonzero(left)
    if top >= 2 ** 53:          # beyond exact doubles
        score = np.array([int(np.dot(a[i[p]].astype(np.int64), v[j[q]].astype(np.int64)))
                          for p, q in zip(at.tolist(), to.tolist())], np.int64)
    elif len(at) < SPARSE * left.size:
        score = np.einsum("ij,ij->i", a[i[at]], v[j[to]])
    else:
        score = (a[i] @ v[j].T)[at, to]
    at, to, score = i[at], j[to], score.astype(np.int64)
    ok = (score >= floor[at]) & (score <= ceil[at])
    return at[ok], to[ok], score[ok]


class Best:
    """The k best (score, smaller id first) of every slot, gathered batch by batch."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.slot, self.score, self.vid = (np.zeros(0, np.int64) for _ in range(3))
        self.held, self.n = [], 0

    def add(self, slot: np.ndarray, score: np.ndarray, vid: np.ndarray) -> None:
        ok = score >= self.floor[slot]
        if ok.any():
            self.held.append((slot[ok], score[ok], vid[ok]))
            self.n += int(ok.sum())
        if self.n > BUFFER:
            self.settle()

    def settle(self) -> None:
        if not self.n:
            return
        self.slot, self.score, self.vid = (np.concatenate([old, *(h[c] for h in self.held)])
                                           for c, old in enumerate((self.slot, self.score, self.vid)))
        self.held, self.n = [], 0
        order = np.lexsort((self.vid, -self.score, self.slot))
        slot = self.slot[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order = order[nth < self.k]
        self.slot, self.score, self.vid = self.slot[order], self.score[order], self.vid[order]
        last = nth[nth < self.k] == self.k - 1
        self.floor[self.slot[last]] = np.maximum(self.floor[self.slot[last]], self.score[last])


def prepare_rows(rows: DataFrame) -> DataFrame:
    """uid, vec_id, label, dim, q, means, devs of the rows that take part; written once."""
    x = F.col("embedding")
    usable = F.forall(x, lambda c: F.coalesce((F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    whole = lambda c: F.floor(c * F.lit(float(SCALE)))
    length2 = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.pow(whole(c).cast("double"), F.lit(2.0)))
    label = F.col("label").cast("long")
    base = (rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
            .filter("vec_id is not null and label is not null and embedding is not null")
            .filter(usable).filter(length2 < float(2 ** 56))
            .select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"),
                    F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                    F.transform(x, lambda c: whole(c).cast("int")).alias("q")))
    kinds = (("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()),
             ("q", pa.list_(pa.int32())), ("means", pa.list_(pa.float64())), ("devs", pa.list_(pa.float64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, q in _matrices(batch.column(3)):
                means, devs = summaries(q)
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array(np.full(len(at), dim), pa.int32()), some.column(3),
                     _lists(means), _lists(devs)], names=[k for k, _ in kinds])

    return materialize(base.mapInArrow(run, "uid long, vec_id long, label long, dim int, q array<int>, "
                                            "means array<double>, devs array<double>"), "negatives-rows")


def _matrices(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, rows as doubles) of a list column without nulls."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    out = []
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        out.append((d, at, flat[offsets[at][:, None] + np.arange(d)].astype(np.float64)))
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _tiled(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Rows by dimension, label and means, cut into ``n`` tiles of about equal size."""
    order = [F.col(c) for c in ("dim", "label", "means", "uid")]
    sliced = slice_rows(rows, order, n, "slice")
    made = (sliced.agg(F.max("slice")).first()[0] or 0) + 1     # Spark may have dealt more slices
    return sliced.withColumn(name, F.floor(F.col("slice") * n / made).cast("int") if made > n
                             else F.col("slice").cast("int")).drop("slice")


def _directory(rows: DataFrame, tile: str) -> DataFrame:
    """Ranges of the summaries at ``TILE_LEVEL``, per tile and dimension."""
    first = sum(LEVELS[:TILE_LEVEL])
    every = [(F.min(F.get("means", F.lit(first + s))), F.max(F.get("means", F.lit(first + s))), F.max(F.get("devs", F.lit(first + s))))
             for s in range(LEVELS[TILE_LEVEL])]
    return rows.groupBy(tile, "dim").agg(*[F.array(*[e[k] for e in every]).alias(f"{c}_{tile}")
                                           for k, c in enumerate(("lo", "hi", "dev"))])


def _tile_bounds() -> tuple[Column, Column]:
    """Least and largest score that two tiles' ranges allow. Vectors of fewer
    dimensions than segments have other levels; their tiles are never skipped."""
    least, most = F.lit(0.0), F.lit(0.0)
    for s in range(LEVELS[TILE_LEVEL]):
        at = lambda c: F.col(c)[s]
        ends = [at(f"{a}_ta") * at(f"{b}_tv") for a in ("lo", "hi") for b in ("lo", "hi")]
        off = at("dev_ta") * at("dev_tv")
        least, most = least + F.least(*ends) - off, most + F.greatest(*ends) + off
    small = F.col("dim") < LEVELS[TILE_LEVEL]
    inf = F.lit(float("inf"))
    return F.when(small, -inf).otherwise(least), F.when(small, inf).otherwise(most)


_SIDES = "ta int, tv int, kind int, uid long, vec_id long, label long, q array<int>, means array<double>, " \
         "devs array<double>, pos array<struct<vec_id:long,score:long>>"
_FOUND = "uid long, anchor_id long, slot int, positive_id long, positive_score long, score long, vec_id long"


def _search(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, n_pairs: int, k: int, negatives: bool) -> DataFrame:
    """The k best rows of every anchor (or anchor and positive) within each tile pair."""
    columns = [c.split()[0] for c in _SIDES.split(", ")]
    no_pos = F.lit(None).cast("array<struct<vec_id:long,score:long>>")
    left = anchors.withColumn("kind", F.lit(0)) if negatives else anchors.withColumns({"kind": F.lit(0), "pos": no_pos})
    sides = (left.join(pairs, ["ta", "dim"]).select(*columns, "dim")
             .unionByName(rows.withColumns({"kind": F.lit(1), "pos": no_pos}).join(pairs, ["tv", "dim"])
                          .select(*columns, "dim")))
    dealt = (sides.repartition(max(1, min(n_pairs, 4000)), "ta", "tv", "dim")
             .sortWithinPartitions("ta", "tv", "dim", "kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tile = None, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in (0, 1, 10)])
            kind = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.any(np.diff(np.vstack([key, kind]), axis=1), axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if group != (now := tuple(key[:, a].tolist())):
                    if tile:
                        yield from tile.result()
                    group, tile = now, _Tile(k, negatives)
                tile.take(batch.slice(a, b - a), bool(kind[a]))
        if tile:
            yield from tile.result()

    return dealt.mapInArrow(run, _FOUND)


class _Tile:
    """The anchors of one tile pair, and what they have found so far."""

    def __init__(self, k: int, negatives: bool):
        self.k, self.negatives = k, negatives
        self.parts: list[pa.RecordBatch] = []
        self.best: Best | None = None

    def take(self, batch: pa.RecordBatch, is_row: bool) -> None:
        if not is_row:
            self.parts.append(batch)
            return
        if self.best is None:
            if not self.parts:
                return
            self._open()
        (_, _, v), = _matrices(batch.column(6))
        v_sum = tuple(_matrices(batch.column(c))[0][2] for c in (7, 8))
        uid, vid, label = (batch.column(c).to_numpy() for c in (3, 4, 5))
        for s in range(0, len(self.uid), SUB_ANCHORS):
            e = s + SUB_ANCHORS
            same = self.label[s:e, None] == label[None, :]
            # the least that still counts for any of an anchor's slots
            floor = self.best.floor.reshape(-1, self.slots)[s:e].min(axis=1)
            may = ~same if self.negatives else same & (self.uid[s:e, None] != uid[None, :])
            i, j, score = bounded_scores(self.a[s:e], tuple(x[s:e] for x in self.a_sum), v, v_sum, floor,
                                         self.ceil[s:e].max(axis=1), may)
            for p in range(self.slots):
                ok = score <= self.ceil[s + i, p]
                self.best.add((s + i[ok]) * self.slots + p, score[ok], vid[j[ok]])
        self.best.settle()

    def _open(self) -> None:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        column = lambda c: table.column(c).combine_chunks()
        self.uid, self.vid, self.label = (column(c).to_numpy() for c in (3, 4, 5))
        (_, _, self.a), = _matrices(column(6))
        self.a_sum = tuple(_matrices(column(c))[0][2] for c in (7, 8))
        n = len(self.uid)
        self.slots = POSITIVES if self.negatives else 1
        floor, self.ceil = np.full((n, self.slots), -_FAR), np.full((n, self.slots), _FAR)
        if self.negatives:
            self.pos = np.zeros((n, self.slots, 2), np.int64)
            floor[:], self.ceil[:] = _FAR, -_FAR
            for i, found in enumerate(column(9).to_pylist()):
                for p, x in enumerate(found):
                    self.pos[i, p] = x["vec_id"], x["score"]
                    floor[i, p], self.ceil[i, p] = -(-LOW * x["score"] // 100), HIGH * x["score"] // 100
        self.best = Best(floor.ravel(), self.k)

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.best is None:
            return
        self.best.settle()
        i, p = np.divmod(self.best.slot, self.slots)
        pos = self.pos[i, p] if self.negatives else np.zeros((len(i), 2), np.int64)
        columns = [self.uid[i], self.vid[i], p.astype(np.int32), pos[:, 0], pos[:, 1], self.best.score, self.best.vid]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns],
                                         names=[c.split()[0] for c in _FOUND.split(", ")])


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine_negatives(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    base = prepare_rows(rows)
    n_anchors = base.filter(is_anchor).count()
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], _RESULT)
    anchors = _tiled(base.filter(is_anchor), -(-n_anchors // ANCHOR_TILE), "ta")
    tiled = _tiled(base, ROW_TILES, "tv")

    same = (anchors.select("ta", "dim", "label").distinct().join(tiled.select("tv", "dim", "label").distinct(), ["dim", "label"])
            .select("ta", "tv", "dim").distinct())
    same = materialize(same, "negatives-pairs")
    found = _merged(_search(anchors, tiled, same, same.count(), POSITIVES, False), POSITIVES)
    positives = found.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("pos"))
    asked = materialize(anchors.join(positives.select("uid", F.transform("pos", lambda p: F.struct(p["vec_id"], p["score"]))
                                                      .alias("pos")), "uid"), "negatives-anchors")

    bands = asked.groupBy("ta", "dim").agg(
        F.min(F.array_min(F.transform("pos", lambda p: p["score"] * LOW / 100))).alias("low"),
        F.max(F.array_max(F.transform("pos", lambda p: p["score"] * HIGH / 100))).alias("high"))
    least, most = _tile_bounds()
    near = (_directory(asked, "ta").join(bands, ["ta", "dim"]).join(_directory(tiled, "tv"), "dim")
            .withColumns({"least": least, "most": most, "slack": 1 + F.abs("low") * 1e-9 + F.abs("high") * 1e-9})
            .filter("most >= low - slack and least <= high + slack").select("ta", "tv", "dim"))
    near = materialize(near, "negatives-pairs")
    negatives = _merged(_search(asked, tiled, near, near.count(), NEGATIVES, True), NEGATIVES)
    return negatives.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
                            F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
