"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= t lie within eps = sqrt(2 - 2t) of each other. The
vectors are rotated to their principal axes (fitted on a bounded sample; a
rotation keeps distances) and sorted by the cells, eps wide, of their leading
coordinates. The sorted sequence is cut into blocks with bounding boxes. Pairs
of intervals of the sequence are joined recursively, level by level: a pair
splits into the pairs of its children, and a pair whose boxes are farther apart
than eps in the leading coordinates is skipped. The pairs of blocks that are
left are compared in double precision, again skipping distant sub-blocks. The
sequence is cut into tiles of many blocks; a task compares the pairs of two tiles
and gets each of their blocks once, however many pairs it is in.

A pair of tiles returns its rows' link counts and a spanning forest of its links,
never the links themselves, so a group of near copies with a third of all rows
costs comparisons, not rows. Components join the forests.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do vectors of different dimensions; repeated
rows are vectors of their own and link with each other; a null vec_id takes
part, its component is the smallest non-null id (null if there is none); an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import materialize
from actlens.llm.components import connected_components
from actlens.llm.vectors import sample_vectors, vectors_of

COSINE = 0.95
SAMPLE_ROWS = 5_000
GRID_DIMS, BOX_DIMS = 8, 16
BLOCK_ROWS, SUB_ROWS = 512, 64
FAN_BITS = 3
TILE_BYTES, MIN_TILES = 16 << 20, 8     # a tile's vectors as doubles; tiles, if there are as many ranges


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Divided by the largest component first, so that no norm
    over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, by falling variance."""
    unit = unit_vectors(sample)
    _, axes = np.linalg.eigh(np.cov(unit, rowvar=False).reshape(sample.shape[1], -1))
    return axes[:, ::-1]


def _leading(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors (plain ones where no axes fit)."""
    unit = unit_vectors(x)
    y = unit @ axes[:, :BOX_DIMS] if axes.shape[0] == x.shape[1] else unit[:, :BOX_DIMS]
    return y if y.shape[1] == BOX_DIMS else np.hstack([y, np.zeros((len(y), BOX_DIMS - y.shape[1]))])


def _grid_keys(y: np.ndarray, dim: int, eps: float) -> list[bytes]:
    cells = np.floor(y[:, :GRID_DIMS] / eps).astype(np.int32) + (1 << 15)
    head = int(dim).to_bytes(4, "big")
    return [head + row.tobytes() for row in cells.astype(">u2")]


def grid_order(rows: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """(uid, embedding) -> uid, embedding, key: the cell key that sorts the sequence."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = [None] * batch.num_rows
            for dim, at, x in vectors_of(batch.column(1)):
                for i, k in zip(at.tolist(), _grid_keys(_leading(x, axes), dim, eps)):
                    keys[i] = k
            batch = batch.append_column("key", pa.array(keys, pa.binary()))
            yield batch.filter(batch.column("key").is_valid())

    return rows.mapInArrow(run, "uid long, embedding array<double>, key binary")


def _packed(x: np.ndarray) -> bytes:
    """As single precision where that is exact (vectors given so), else double."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return (single if (single == x).all() else x).tobytes()


def _unpacked(x: bytes, rows: int, dim: int) -> np.ndarray:
    kind = np.float64 if len(x) == 8 * rows * dim else np.float32
    return np.frombuffer(x, kind).reshape(rows, dim).astype(np.float64)


def cut_blocks(ordered: DataFrame, axes: np.ndarray, n_parts: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: part and idx (its place in the sequence), dim, its box,
    and its rows as packed arrays."""
    schema = ("part int, idx int, dim int, lo array<double>, hi array<double>, uids binary, x binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        idx = 0

        def block(dim: int, uids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal idx
            y = _leading(x, axes)
            idx += 1
            row = {"part": part, "idx": idx - 1, "dim": dim, "lo": y.min(axis=0).tolist(), "hi": y.max(axis=0).tolist(),
                   "uids": uids.tobytes(), "x": _packed(x)}
            return pa.RecordBatch.from_pylist([row], pa.schema([
                ("part", pa.int32()), ("idx", pa.int32()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())),
                ("hi", pa.list_(pa.float64())), ("uids", pa.binary()), ("x", pa.binary())]))

        held: dict[int, list] = {}
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for dim, at, x in vectors_of(batch.column(1)):
                u, v = held.pop(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                u, v = np.concatenate([u, uid[at]]), np.concatenate([v, x])
                while len(u) >= block_rows:
                    yield block(dim, u[:block_rows], v[:block_rows])
                    u, v = u[block_rows:], v[block_rows:]
                held[dim] = (u, v)
        for dim, (u, v) in sorted(held.items()):
            if len(u):
                yield block(dim, u, v)

    return (ordered.repartitionByRange(n_parts, "key", "uid").sortWithinPartitions("key", "uid")
            .select("uid", "embedding").mapInArrow(run, schema))


def _gap2(a: str, b: str):
    """Squared distance of two boxes."""
    gaps = F.zip_with(
        F.zip_with(F.col(f"{a}.lo"), F.col(f"{b}.hi"), lambda x, y: x - y),
        F.zip_with(F.col(f"{b}.lo"), F.col(f"{a}.hi"), lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def block_pairs(directory: DataFrame, bits: int, eps: float) -> DataFrame:
    """(a, b) with a <= b: the blocks that are not provably distant. Starts from
    the whole sequence joined with itself and splits the surviving pairs."""
    near2 = (eps * (1 + 1e-9)) ** 2
    bounds = [(F.min(F.col("lo")[i]), F.max(F.col("hi")[i])) for i in range(BOX_DIMS)]
    shifts = sorted({0, *range(0, bits + FAN_BITS, FAN_BITS)}, reverse=True)
    top = directory.select("dim", F.shiftright("seq", shifts[0]).alias("a")).distinct()
    pairs = top.withColumn("b", F.col("a"))
    for above, shift in zip(shifts, shifts[1:]):
        level = (directory.groupBy("dim", F.shiftright("seq", shift).alias("node"))
                 .agg(F.array(*[lo for lo, _ in bounds]).alias("lo"), F.array(*[hi for _, hi in bounds]).alias("hi"))
                 .withColumn("parent", F.shiftright("node", above - shift)))
        left, right = level.alias("l"), level.alias("r")
        pairs = (pairs.alias("p").join(left, (F.col("p.dim") == F.col("l.dim")) & (F.col("p.a") == F.col("l.parent")))
                 .join(right, (F.col("p.dim") == F.col("r.dim")) & (F.col("p.b") == F.col("r.parent")))
                 .filter((F.col("l.node") <= F.col("r.node")) & (_gap2("l", "r") <= near2))
                 .select(F.col("p.dim").alias("dim"), F.col("l.node").alias("a"), F.col("r.node").alias("b")))
    return pairs


def _forest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels (a row number) of the linked rows and columns of a link
    matrix; rows and columns without a link get -1."""
    none = m.shape[0]
    rows = np.where(m.any(axis=1), np.arange(m.shape[0]), none)
    while True:
        cols = np.where(m, rows[:, None], none).min(axis=0)
        new = np.minimum(rows, np.where(m, cols[None, :], none).min(axis=1))
        if (new == rows).all():
            return np.where(rows < none, rows, -1), np.where(cols < none, cols, -1)
        rows = new


def compare_blocks(xa: np.ndarray, xb: np.ndarray, same: bool, ya: np.ndarray, yb: np.ndarray,
                   cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Link counts of both blocks' rows and spanning links, as positions with
    the rows of b after those of a."""
    na, nb = len(xa), len(xb)
    deg_a, deg_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    xa, xb = (x / np.abs(x).max(axis=1, keepdims=True) for x in (xa, xb))
    norm_a, norm_b = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
    parent = list(range(na + (0 if same else nb)))
    shift = 0 if same else na

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    near2 = (eps * (1 + 1e-9)) ** 2
    starts_a, starts_b = range(0, na, SUB_ROWS), range(0, nb, SUB_ROWS)
    box = lambda y, s: (y[s:s + SUB_ROWS].min(axis=0), y[s:s + SUB_ROWS].max(axis=0))
    boxes_a, boxes_b = [box(ya, s) for s in starts_a], [box(yb, s) for s in starts_b]
    lo_b, hi_b = np.stack([b[0] for b in boxes_b]), np.stack([b[1] for b in boxes_b])
    for (lo, hi), s in zip(boxes_a, starts_a):
        gap = np.maximum(0, np.maximum(lo - hi_b, lo_b - hi))
        for q in np.flatnonzero((gap * gap).sum(axis=1) <= near2):
            t = int(q) * SUB_ROWS
            if same and t < s:
                continue
            ea, eb = min(na, s + SUB_ROWS), min(nb, t + SUB_ROWS)
            cos = (xa[s:ea] @ xb[t:eb].T) / (norm_a[s:ea, None] * norm_b[None, t:eb])
            m = cos >= cosine
            if same and s == t:
                np.fill_diagonal(m, False)
            if not m.any():
                continue
            deg_a[s:ea] += m.sum(axis=1)
            if not (same and s == t):
                (deg_a if same else deg_b)[t:eb] += m.sum(axis=0)
            rows, cols = _forest(m)
            for base, label in ((s, rows), (shift + t, cols)):
                for i in np.flatnonzero(label >= 0):
                    u, v = find(base + int(i)), find(s + int(label[i]))
                    if u != v:
                        parent[max(u, v)] = min(u, v)
    links = [(i, r) for i in range(len(parent)) if (r := find(i)) != i]
    return deg_a, deg_b, links


def tile_rows(pairs: DataFrame, blocks: DataFrame, in_part: int, tile_parts: int) -> DataFrame:
    """(dim, ta, tb, seq, mates, uids, x): the blocks that a pair of tiles needs, each
    once, with the blocks ``mates`` it is compared with there as the smaller side."""
    tile = lambda c: F.floor(F.shiftright(c, in_part) / F.lit(tile_parts)).cast("long")
    sides = F.array(F.struct(F.col("a").alias("seq"), F.col("b").alias("mate")),
                    F.struct(F.col("b").alias("seq"), F.lit(None).cast("long").alias("mate")))
    need = (pairs.select("dim", tile("a").alias("ta"), tile("b").alias("tb"), F.explode(sides).alias("s"))
            .groupBy("dim", "ta", "tb", "s.seq").agg(F.collect_list("s.mate").alias("mates")))
    return need.join(blocks.select("dim", "seq", "uids", "x"), ["dim", "seq"]) \
        .select("dim", "ta", "tb", "seq", "mates", "uids", "x")


def _compare_tile(axes: np.ndarray, cosine: float, eps: float):
    """(uid, n, other): link counts (other null) and spanning links (n 0) of a pair of tiles."""
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        seqs = table.column("seq").to_pylist()
        ids = [np.frombuffer(u, np.int64) for u in table.column("uids").to_pylist()]
        xs = [_unpacked(x, len(u), dim) for x, u in zip(table.column("x").to_pylist(), ids)]
        ys = [_leading(x, axes) for x in xs]
        at = {seq: i for i, seq in enumerate(seqs)}
        first = np.cumsum([0, *map(len, ids)]).tolist()
        uid, n = np.concatenate(ids), np.zeros(first[-1], np.int64)
        parent = list(range(first[-1]))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, mates in enumerate(table.column("mates").to_pylist()):
            for j in (at[m] for m in mates):
                deg_a, deg_b, links = compare_blocks(xs[i], xs[j], i == j, ys[i], ys[j], cosine, eps)
                n[first[i]:first[i + 1]] += deg_a
                n[first[j]:first[j + 1]] += deg_b
                rows = len(ids[i])
                for u, v in links:
                    u, v = (find(first[i] + p if p < rows else first[j] + p - rows) for p in (u, v))
                    if u != v:
                        parent[max(u, v)] = min(u, v)
        linked = np.flatnonzero(n)
        roots = np.array([find(i) for i in linked.tolist()], np.int64)
        member, root = linked[roots != linked], roots[roots != linked]
        count = np.concatenate([n[linked], np.zeros(len(member), np.int64)])
        other = pa.array(np.concatenate([np.zeros(len(linked), np.int64), uid[root]]), mask=count > 0)
        return pa.table({"uid": np.concatenate([uid[linked], uid[member]]), "n": count, "other": other})
    return run


def near_duplicate_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept; one row per input row."""
    spark = rows.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine))
    base = materialize(rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
                       .withColumn("uid", F.monotonically_increasing_id()), "ego-rows")
    n = base.count()
    sample = (base.filter("embedding is not null").orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(SAMPLE_ROWS)
              .select("embedding").collect())
    matrix = sample_vectors([r["embedding"] for r in sample])
    axes = principal_axes(matrix) if len(matrix) > 1 else np.zeros((0, BOX_DIMS))
    per_part = 8 * BLOCK_ROWS
    n_parts = max(1, -(-n // per_part))
    blocks = materialize(cut_blocks(grid_order(base.select("uid", "embedding"), axes, eps), axes, n_parts), "ego-blocks")
    top = blocks.agg(F.max("part").alias("p"), F.max("idx").alias("i")).first()
    in_part = int(top["i"] or 0).bit_length()
    bits = in_part + int(top["p"] or 0).bit_length()
    numbered = blocks.withColumn("seq", F.shiftleft(F.col("part").cast("long"), in_part) + F.col("idx"))
    pairs = materialize(block_pairs(numbered.select("seq", "dim", "lo", "hi"), bits, eps), "ego-pairs")

    dim = blocks.agg(F.max("dim")).first()[0] or 1
    tile_parts = max(1, min(n_parts // MIN_TILES, TILE_BYTES // (8 * dim * per_part)))
    tiles = -(-n_parts // tile_parts)
    found = (tile_rows(pairs, numbered, in_part, tile_parts)
             .repartition(max(1, min(tiles * (tiles + 1), 2000)), "dim", "ta", "tb")
             .groupBy("dim", "ta", "tb")
             .applyInArrow(_compare_tile(axes, cosine, eps), "uid long, n long, other long"))
    found = materialize(found, "ego-found")
    degrees = found.filter("n > 0").groupBy("uid").agg(F.sum("n").alias("n_links"))
    labels = connected_components(found.filter("n = 0").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    named = base.select("uid", "vec_id").join(labels.withColumnRenamed("node", "uid"), "uid", "left")
    named = materialize(named.withColumn("root", F.coalesce("component_id", "uid")).drop("component_id"), "ego-labels")
    # the smallest vec_id of each component; a vector without links needs no join
    least = named.join(labels.select(F.col("component_id").alias("root")).distinct(), "root", "left_semi") \
        .groupBy("root").agg(F.min("vec_id").alias("least"))
    return (named.join(degrees, "uid", "left").join(least, "root", "left")
            .withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
            .withColumn("component_id", F.when(F.col("n_links") > 0, F.col("least")).otherwise(F.col("vec_id")))
            .select("vec_id", "n_links", "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")))
