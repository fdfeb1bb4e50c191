"""Approximate nearest neighbours by a hierarchical k-means tree.

Largest inner product is turned into smallest distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm (0 for a query). A tree of k-means
clusterings is fitted on a bounded sample. Every vector is stored at one leaf;
a leaf with many vectors is dealt over several chunks, so a hot leaf is no hot
task. A query walks the tree best-bin-first: a priority queue holds the
branches by their distance to the query, and popping it yields leaves from the
nearest on. How many leaves are visited is calibrated: the number is widened
until a bounded set of queries, compared with all vectors in blocks, finds
``TARGET_RECALL`` of its true neighbours, and ``SERVED`` of these queries and of
as many from different leaves each find that share of their own. A query goes on
beyond this number until its leaves hold k rows of other ids. All scores are inner products of the
original vectors in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids; every dimension has a tree of its own,
and a query's candidates are the vectors of its dimension; with fewer candidates
than k, all are returned; ties go to the smaller id; an id that several query
rows share is asked once, with its vector of the smallest dimension and, among
these, the first in order; rows with the query's id are not candidates, other
repeated rows are candidates of their own; a table without rows or without
queries gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.llm.common import materialize
from actlens.llm.vectors import vectors_of

K = 20
SAMPLE_ROWS = 20_000
BRANCH = 8
ROWS_PER_LEAF = 1024
MAX_LEAVES = 4096
CHUNK_ROWS = 4_000
QUERY_ROWS = 4_000
CALIBRATION_QUERIES = 64
TARGET_RECALL = 0.97
SERVED = 0.9
FIRST_VISITS = 2


@dataclass
class Tree:
    """Nodes as arrays: children of node i are ``child[i]`` (empty at a leaf)."""

    dim: int
    top_norm: float
    child: list[list[int]]
    centre: np.ndarray
    leaf: list[int]          # leaf number by node, -1 inside

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(0.0, self.top_norm ** 2 - (x * x).sum(axis=1))
        return np.hstack([x, np.sqrt(rest)[:, None]])

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector is stored at."""
        lifted, at = self.lift(x), np.zeros(len(x), np.int64)
        for node, kids in enumerate(self.child):       # parents come before children
            rows = np.flatnonzero(at == node)
            if kids and len(rows):
                c = self.centre[kids]
                d = (c * c).sum(axis=1) - 2 * lifted[rows] @ c.T
                at[rows] = np.array(kids)[d.argmin(axis=1)]
        return np.array(self.leaf)[at]

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for a query, best bin first."""
        point = np.append(q, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.child[node]:
                yield self.leaf[node]
                continue
            gap = self.centre[self.child[node]] - point
            for d, kid in zip((gap * gap).sum(axis=1).tolist(), self.child[node]):
                heapq.heappush(queue, (d, kid))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        for j in range(k):
            mine = x[label == j]
            centres[j] = mine.mean(axis=0) if len(mine) else x[rng.integers(len(x))]
    label = ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
    return centres, label


def fit_tree(sample: np.ndarray, top_norm: float, n_leaves: int) -> Tree:
    tree = Tree(sample.shape[1], top_norm, [[]], np.zeros((1, sample.shape[1] + 1)), [-1])
    lifted = tree.lift(sample)
    centres = [lifted.mean(axis=0)]
    least = max(2, -(-len(sample) // max(1, n_leaves)))
    queue = [(0, np.arange(len(sample)))]
    while queue:
        node, rows = queue.pop(0)
        if len(rows) <= max(least, BRANCH) or (lifted[rows] == lifted[rows[0]]).all():
            continue
        c, label = _kmeans(lifted[rows], min(BRANCH, -(-len(rows) // least)), node)
        for j in np.unique(label):
            tree.child[node].append(len(tree.child))
            queue.append((len(tree.child), rows[label == j]))
            tree.child.append([])
            centres.append(c[j])
    tree.centre = np.stack(centres)
    n = 0
    tree.leaf = []
    for kids in tree.child:
        tree.leaf.append(-1 if kids else n)
        n += not kids
    return tree


_TOP = "query_id long, vec_id long, score double"


def _best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, x: np.ndarray, k: int,
          least: np.ndarray | None = None) -> pd.DataFrame:
    """The k best candidates of every query within one block of vectors, of
    those that reach the query's ``least`` score."""
    out = []
    order = np.argsort(vid, kind="stable")
    vid, x = vid[order], x[order]
    for a in range(0, len(qid), 256):
        scores = np.einsum("id,jd->ij", q[a:a + 256], x) if len(x) < 4 else q[a:a + 256] @ x.T
        scores[qid[a:a + 256, None] == vid[None, :]] = -np.inf
        m = min(k, len(vid))
        if m < len(vid):
            floor = np.partition(scores, len(vid) - m, axis=1)[:, len(vid) - m]
            take = scores >= floor[:, None]            # with all ties; cut later by id
        else:
            take = np.ones_like(scores, bool)
        take &= scores > -np.inf
        if least is not None:
            take &= scores >= least[a:a + 256, None]
        i, j = np.nonzero(take)
        s = scores[i, j]
        rank = np.lexsort((vid[j], -s, i))
        i, j, s = i[rank], j[rank], s[rank]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        ok = nth < k
        out.append(pd.DataFrame({"query_id": qid[a:a + 256][i[ok]], "vec_id": vid[j[ok]], "score": s[ok]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _against_all(vectors: DataFrame, qid: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """A bounded set of queries against all rows, a batch of rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vid = batch.column(0).to_numpy()
            for dim, at, x in vectors_of(batch.column(1)):
                if dim == q.shape[1]:
                    yield pa.RecordBatch.from_pandas(_best(qid, q, vid[at], x, k).astype(
                        {"query_id": "int64", "vec_id": "int64", "score": "float64"}), preserve_index=False)

    return _merge(vectors.select("vec_id", "embedding").mapInArrow(run, _TOP), k)


def store(vectors: DataFrame, tree: Tree) -> DataFrame:
    """Every usable vector with its leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.full(batch.num_rows, -1, np.int64)
            for dim, at, x in vectors_of(batch.column(1)):
                if dim == tree.dim:
                    leaf[at] = tree.leaf_of(x)
            batch = batch.append_column("leaf", pa.array(leaf))
            yield batch.filter(pa.array(leaf >= 0))

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, leaf long")


def _visits(queries: DataFrame, tree: Tree, n: int, sizes: dict[int, int], k: int) -> DataFrame:
    """(vec_id, embedding, leaf, nth): the first n leaves of each query, and more
    until they hold k rows besides the query's ``own``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaves, nth = [], [], []
            own = batch.column(2).to_pylist()
            for dim, at, x in vectors_of(batch.column(1)):
                for i, q in zip(at.tolist(), x):
                    held = 0
                    for v, leaf in enumerate(tree.visit(q) if dim == tree.dim else ()):
                        if v >= n and held >= k + own[i]:
                            break
                        held += sizes.get(leaf, 0)
                        rows.append(i)
                        leaves.append(leaf)
                        nth.append(v)
            got = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(leaves, pa.int64()), pa.array(nth, pa.int32())],
                                             names=["vec_id", "embedding", "leaf", "nth"])

    return queries.select("vec_id", "embedding", "own").mapInArrow(
        run, "vec_id long, embedding array<double>, leaf long, nth int")


def _calibrated(base: DataFrame, asked: DataFrame, stored: DataFrame, tree: Tree, k: int, target: float) -> int:
    """How many leaves to visit, by a bounded set of queries against all rows."""
    by_hash = [F.xxhash64("vec_id", F.lit(7)), F.col("vec_id")]
    some = asked.select("vec_id", "embedding").orderBy(*by_hash).limit(CALIBRATION_QUERIES).collect()
    # queries of different leaves: those of small leaves count as much as those of large ones
    spread = (store(asked, tree).withColumn("nth", F.row_number().over(Window.partitionBy("leaf").orderBy(*by_hash)))
              .filter(F.col("nth") <= CALIBRATION_QUERIES).orderBy("nth", *by_hash).limit(CALIBRATION_QUERIES).collect())
    points = {r["vec_id"]: r["embedding"] for r in [*some, *spread]}
    qid = np.array(list(points), np.int64)
    q = np.array(list(points.values()), np.float64)
    truth = _against_all(base, qid, q, k)
    where = stored.select("vec_id", "leaf").distinct()
    hits = truth.join(where, "vec_id").groupBy("query_id", "leaf").count().collect()
    found = {}
    for r in hits:
        found.setdefault(r["query_id"], {})[r["leaf"]] = r["count"]
    gains = np.zeros((len(qid), max(tree.leaf) + 1))
    for i, point in enumerate(q):
        mine = found.get(int(qid[i]), {})
        for at, leaf in enumerate(tree.visit(point) if mine else ()):
            gains[i, at] = mine.get(leaf, 0)
    pooled = gains[:len(some)].sum(axis=0)
    reached = np.cumsum(pooled) / max(1.0, pooled.sum())
    alone = np.cumsum(gains, axis=1) >= (target - 1e-12) * gains.sum(axis=1, keepdims=True)
    served = np.sort(alone.argmax(axis=1))[int(np.ceil(SERVED * len(qid))) - 1]
    return max(int(np.searchsorted(reached, target - 1e-12)), int(served)) + 1


def _search_chunk(dim: int, k: int):
    def matrix(col: pd.Series) -> np.ndarray:
        return np.stack(col.to_list()).astype(np.float64) if len(col) else np.zeros((0, dim))

    def run(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(stored):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        return _best(queries["vec_id"].to_numpy(), matrix(queries["embedding"]),
                     stored["vec_id"].to_numpy(), matrix(stored["embedding"]), k, queries["least"].to_numpy())
    return run


def _parts_of(sizes: dict[int, int], most: int) -> Column:
    """Into how many parts of at most ``most`` rows the column's leaf is split."""
    split = {leaf: -(-n // most) for leaf, n in sizes.items() if n > most}
    if not split:
        return F.lit(1)
    pairs = [F.lit(v) for kv in sorted(split.items()) for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col("leaf").cast("int")), F.lit(1))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, dim, embedding of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, _ in vectors_of(batch.column(1)):
                some = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(at), dim, np.int32)), some.column(1)],
                                                 names=["vec_id", "dim", "embedding"])

    known = (rows.filter("vec_id is not null and embedding is not null")
             .select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")))
    return known.mapInArrow(run, "vec_id long, dim int, embedding array<double>")


def search_vectors(rows: DataFrame, is_query: Column, k: int = K, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every query row."""
    base = materialize(usable_vectors(rows), "ann-rows")
    asked = (base.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "embedding")).alias("q"))
             .select("vec_id", "q.dim", "q.embedding"))
    own = base.groupBy("vec_id", "dim").agg(F.count("*").alias("own"))
    asked = materialize(asked.join(own, ["vec_id", "dim"]), "ann-queries")
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in asked.select("dim").distinct().orderBy("dim").collect():       # dimensions, not rows
        of_dim = F.col("dim") == r["dim"]
        found = _search_dimension(base.filter(of_dim), asked.filter(of_dim), r["dim"], k, target)
        out = out.unionByName(found)
    return out


def _search_dimension(base: DataFrame, asked: DataFrame, dim: int, k: int, target: float) -> DataFrame:
    n = base.count()
    picked = base.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "embedding").limit(SAMPLE_ROWS).collect()
    sample = np.array([r["embedding"] for r in picked], np.float64)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [float((x * x).sum(axis=1).max()) for _, _, x in vectors_of(batch.column(0)) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(tops, pa.float64())], names=["n2"])

    top2 = base.select("embedding").mapInArrow(norms, "n2 double").agg(F.max("n2").alias("m")).first()["m"]
    tree = fit_tree(sample, float(np.sqrt(top2)) * (1 + 1e-12), min(MAX_LEAVES, max(1, n // ROWS_PER_LEAF)))
    stored = materialize(store(base, tree), "ann-stored")
    sizes = {r["leaf"]: r["count"] for r in stored.groupBy("leaf").count().collect()}   # at most MAX_LEAVES rows

    visits = _calibrated(base, asked, stored, tree, k, target)

    # a leaf with many vectors, or asked by many queries, is dealt over several groups
    walked = materialize(_visits(asked, tree, visits, sizes, k), "ann-visits")
    asks = {r["leaf"]: r["count"] for r in walked.groupBy("leaf").count().collect()}     # at most MAX_LEAVES rows
    chunks, q_chunks = _parts_of(sizes, CHUNK_ROWS), _parts_of(asks, QUERY_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = (stored.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks).cast("int"))
             .withColumn("part", every(q_chunks)))
    walked = (walked.withColumn("part", F.pmod(F.xxhash64("vec_id"), q_chunks).cast("int"))
              .withColumn("chunk", every(chunks)))

    def searched(asked_leaves: DataFrame) -> DataFrame:
        return (asked_leaves.select("vec_id", "embedding", "least", "leaf", "chunk", "part")
                .groupBy("leaf", "chunk", "part").cogroup(dealt.groupBy("leaf", "chunk", "part"))
                .applyInPandas(_search_chunk(dim, k), _TOP))

    # the nearest leaves first: later leaves only return what beats their k-th score
    near = walked.filter(F.col("nth") < FIRST_VISITS).withColumn("least", F.lit(float("-inf")))
    top = materialize(_merge(searched(near), k), "ann-near")
    least = (top.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")))
    far = (walked.filter(F.col("nth") >= FIRST_VISITS).join(least, "vec_id", "left")
           .withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    found = top.select("query_id", "vec_id", "score").unionByName(searched(far))
    return _merge(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
