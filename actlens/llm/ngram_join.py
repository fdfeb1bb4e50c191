"""N-gram Jaccard join: linked documents by a distributed prefix-tree join.

Two documents link when their shingle sets x, y have 7 |x n y| >= 3 (|x| + |y|),
that is a Jaccard similarity of 0.75 or more. All sets are put in one global
order (rare shingles first, then by hash), which makes every set a path of a
trie. Linked sets must share a shingle near the root: within the first
n - ceil(6n/7) + 1 of the smaller and the first n - ceil(3n/4) + 1 of the
larger one. The trie is therefore dealt over Spark by these first shingles:

1. ``describe``: per document, the id of its set (equal sets are one node from
   here on, so exact copies cost nothing), its size, and a parity bitmap; and
   the shingles that are locally frequent. Their summed counts give the order;
   any counts give a correct one, so the table is cut to a fixed size.
2. ``postings``: first shingles, packed per range of the hash; each range is
   joined on sorted arrays, and only runs (shingles held by two or more nodes)
   go on. Runs with the same nodes are one run.
3. Rounds of candidates. First every node of a run is compared with one node of
   about its size; links make components. Then the nodes outside a run's largest
   component meet members of it. Last come all pairs of a run that are still in
   different components, gathered by component, so that no pair is a row unless
   sizes and bitmaps allow a link. A pair within one component need not be
   compared: only components are asked for.
4. Candidates whose bitmaps differ in too many bits cannot link. The rest are
   verified on tries: the sets to compare with one set are walked in trie
   order, sharing the partial overlap of common beginnings, and a subtree is
   left when the overlap so far and the remaining length cannot reach the bound.

Shingles are compared by 64-bit hashes.

Defined cases: null text, empty text and text without words have the empty set
and link with nothing; equal sets link; a null doc_id takes part, its
component is the smallest non-null id (null if there is none); repeated rows
are documents of their own; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.llm.common import materialize, released, small_or_none
from actlens.llm.components import connected_components
from actlens.llm.shingles import mix64, set_id, shingle_sets

MIN_COUNT = 16
MAX_FREQUENT = 1 << 20
POSTINGS_PER_RANGE = 500_000
GROUP_MEMBERS = 256
HELD_SHINGLES = 3_000_000
BLOCK_ROWS = 8_000
PAIRS_PER_BATCH = 100_000
MAIN_ROUNDS = 2
MAX_BROADCAST_IDS = 500_000


def _need(nx, ny):
    """Least overlap of linked sets."""
    return -(-3 * (nx + ny) // 7)


def parity_bits(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of m cells, m the power of two from four
    times the set's size on (64 at least). Sets differ in at least as many
    shingles as their bitmaps, folded to one size, differ in bits."""
    m = 64
    while m < 4 * len(s):
        m *= 2
    cell = (mix64(s) >> np.uint64(32)).astype(np.int64) & (m - 1)
    return np.packbits((np.bincount(cell, minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(nx: int, ny: int, bx: bytes, by: bytes) -> bool:
    a, b = np.frombuffer(bx, np.uint64), np.frombuffer(by, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    apart = int(np.bitwise_count(a ^ b).sum())
    return (nx + ny - apart) // 2 >= _need(nx, ny)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "node", "bits", "often", "count"]
    seen, held = {}, 0

    def repeated() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        token, count = token[count > 1].view(np.int64), count[count > 1].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
             pa.ListArray.from_arrays([0, len(token)], pa.array(token)),
             pa.ListArray.from_arrays([0, len(count)], pa.array(count))], names=names)

    for batch in batches:
        size, node, bits = [], [], []
        for _, s in shingle_sets(batch.column(1)):
            size.append(len(s))
            i = set_id(s)
            node.append(i if len(s) else None)
            bits.append(parity_bits(s) if len(s) else None)
            if len(s) and i not in seen:
                seen[i] = s
                held += len(s)
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(node, pa.int64()),
             pa.array(bits, pa.binary()), pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int32()))],
            names=names)
        if held >= HELD_SHINGLES:
            yield repeated()
            seen, held = {}, 0
    if seen:
        yield repeated()


def describe(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "text").mapInArrow(
        released(_describe), "doc_id long, n long, node long, bits binary, often array<long>, count array<int>"), "ngram-sets")


def frequent_shingles(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and their counts; at most
    ``MAX_FREQUENT`` of 16 bytes each."""
    top = (described.filter("often is not null")
           .select(F.explode(F.arrays_zip("often", "count")).alias("z")).select("z.often", "z.count")
           .groupBy("often").agg(F.sum("count").alias("count")).filter(F.col("count") >= MIN_COUNT)
           .orderBy(F.desc("count"), "often").limit(MAX_FREQUENT).toPandas())
    token = top["often"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["count"].to_numpy(np.int64)[order]


def global_order(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The set as a path of the trie, and how many of its shingles are not frequent."""
    token, count = frequent
    if not len(token):
        return s, len(s)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    hit = token[at] == s
    rare, often = s[~hit], s[hit]
    return np.concatenate([rare, often[np.argsort(count[at[hit]], kind="stable")]]), len(rare)


_PACKED = pa.schema([("range", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("low", pa.binary()),
                     ("who", pa.binary()), ("pos", pa.binary()), ("tokens", pa.list_(pa.int64())),
                     ("t_node", pa.list_(pa.int64())), ("t_n", pa.list_(pa.int64())), ("t_pos", pa.list_(pa.int64()))])


class _Postings:
    """First shingles of the sets of a task, gathered until they fill a row per range."""

    def __init__(self, n_ranges: int) -> None:
        self.n_ranges, self.seen, self.held = n_ranges, set(), 0
        self.nodes, self.sizes, self.parts, self.who, self.pos = [], [], [], [], []
        self.often = ([], [], [], [])

    def add(self, s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> None:
        n, i = len(s), set_id(s)
        if not n or i in self.seen:
            return
        self.seen.add(i)
        path, rare = global_order(s, frequent)
        p = n - -(-3 * n // 4) + 1
        q = min(p, rare)
        self.parts.append(path[:q].copy())
        self.who.append(np.full(q, len(self.nodes), np.uint32))
        self.pos.append(np.arange(q, dtype=np.uint32))
        self.nodes.append(i)
        self.sizes.append(n)
        self.held += p
        if p > q:
            for column, values in zip(self.often, (path[q:p].view(np.int64).copy(), np.full(p - q, i, np.int64),
                                                   np.full(p - q, n, np.int64), np.arange(q, p, dtype=np.int64))):
                column.append(values)

    def rows(self) -> pa.RecordBatch:
        token, who, pos = map(np.concatenate, (self.parts, self.who, self.pos))
        node, size = np.array(self.nodes, np.int64), np.array(self.sizes, np.uint32)
        high = ((token >> np.uint64(32)) * np.uint64(self.n_ranges) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(high, kind="stable")
        present, first = np.unique(high[order], return_index=True)
        rows = []
        for r, at in zip(present.tolist(), np.split(order, first[1:])):
            mine, local = np.unique(who[at], return_inverse=True)
            # 40 other bits of the hash tell the shingles of a range apart
            low = (mix64(token[at]) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append({"range": r, "nodes": node[mine].tobytes(), "sizes": size[mine].tobytes(), "low": low.tobytes(),
                         "who": local.astype(np.uint16 if len(mine) < 65536 else np.uint32).tobytes(),
                         "pos": pos[at].tobytes()})
        if self.often[0]:
            t = [np.concatenate(x).tolist() for x in self.often]
            rows.append({"tokens": t[0], "t_node": t[1], "t_n": t[2], "t_pos": t[3]})
        return pa.RecordBatch.from_pylist(rows, _PACKED)


def _pack(n_ranges: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Postings(n_ranges)
        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                gathered.add(s, shared.value)
            if gathered.held >= HELD_SHINGLES // 4:
                yield gathered.rows()
                gathered = _Postings(n_ranges)
        if gathered.nodes:
            yield gathered.rows()
    return run


def _runs_of_range(packed: pd.DataFrame) -> pd.DataFrame:
    """Runs of one hash range: (run, node, n, pos), a row per node of each run."""
    low, node, n, pos = [], [], [], []
    for nodes, sizes, lows, who, at in zip(packed["nodes"], packed["sizes"], packed["low"], packed["who"], packed["pos"]):
        at = np.frombuffer(at, np.uint32)
        who = np.frombuffer(who, np.uint16 if len(who) == 2 * len(at) else np.uint32)
        wide = np.zeros((len(at), 8), np.uint8)
        wide[:, :5] = np.frombuffer(lows, np.uint8).reshape(-1, 5)
        low.append(wide.view(np.uint64)[:, 0])
        node.append(np.frombuffer(nodes, np.int64)[who])
        n.append(np.frombuffer(sizes, np.uint32)[who])
        pos.append(at)
    low, node, n, pos = map(np.concatenate, (low, node, n, pos))
    order = np.argsort(low, kind="stable")
    low = low[order]
    same = np.concatenate([[False], low[1:] == low[:-1], [False]])
    keep = same[1:] | same[:-1]
    order, low = order[keep], low[keep]
    node, n, pos = node[order], n[order], pos[order]
    order = np.lexsort((node, low))
    low, node, n, pos = low[order], node[order], n[order], pos[order]
    fresh = np.ones(len(low), bool)      # the same node from several tasks counts once
    fresh[1:] = (low[1:] != low[:-1]) | (node[1:] != node[:-1])
    low, node, n, pos = low[fresh], node[fresh], n[fresh], pos[fresh]
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(low)))
    run = np.add.reduceat(mix64(node.view(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
    out = pd.DataFrame({"run": np.repeat(mix64(run + length.astype(np.uint64)), length).view(np.int64),
                        "node": node, "n": n.astype(np.int64), "pos": pos.astype(np.int64)})
    return out[np.repeat(length > 1, length)].groupby(["run", "node"], as_index=False).min()


def runs(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], n_postings: int) -> DataFrame:
    """(run, node, n, pos): the nodes that share a first shingle, and the place
    of the first such shingle in each."""
    n_ranges = max(1, -(-n_postings // POSTINGS_PER_RANGE))
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    packed = materialize(docs.select("text").mapInArrow(released(_pack(n_ranges, shared)), (
        "range int, nodes binary, sizes binary, low binary, who binary, pos binary, tokens array<long>, "
        "t_node array<long>, t_n array<long>, t_pos array<long>")), "ngram-postings")
    schema = "run long, node long, n long, pos long"
    rare = (packed.filter("range is not null").select("range", "nodes", "sizes", "low", "who", "pos")
            .groupBy("range").applyInPandas(_runs_of_range, schema))
    often = (packed.filter("tokens is not null")
             .select(F.explode(F.arrays_zip("tokens", "t_node", "t_n", "t_pos")).alias("z"))
             .select(F.col("z.tokens").alias("run"), F.col("z.t_node").alias("node"), F.col("z.t_n").alias("n"),
                     F.col("z.t_pos").alias("pos")))
    return materialize(rare.unionByName(often).groupBy("run", "node")
                       .agg(F.min("n").alias("n"), F.min("pos").alias("pos")), "ngram-runs")


def first_candidates(shared: DataFrame) -> DataFrame:
    """Every node of a run with the smallest node of its run and size class."""
    classed = shared.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))))
    pivot = classed.groupBy("run", "size_class").agg(F.min(F.struct("n", "node")).alias("p"))
    return (classed.join(pivot, ["run", "size_class"]).filter("node <> p.node")
            .select(F.col("p.node").alias("x"), F.col("p.n").alias("nx"), F.col("node").alias("y"), F.col("n").alias("ny"))
            .filter(4 * F.col("nx") >= 3 * F.col("ny")).distinct())


def main_candidates(shared: DataFrame, labels: DataFrame, salt: int) -> DataFrame:
    """Every node outside the largest component of a run with one node of that
    component, chosen by a hash of the run: a node that shares many runs with a
    group meets as many of its members."""
    named = _named(shared, labels)
    parts = named.groupBy("run", "part").agg(
        F.count("*").alias("held"),
        F.min(F.struct(F.xxhash64("run", "node", F.lit(salt)).alias("h"), "node", "n")).alias("p"))
    main = parts.groupBy("run").agg(F.max(F.struct("held", F.col("part"), "p")).alias("m"), F.count("*").alias("parts"))
    main = main.filter("parts > 1").select("run", F.col("m.part").alias("main"), F.col("m.p.node").alias("x"),
                                           F.col("m.p.n").alias("nx"))
    pairs = named.join(main, "run").filter("part <> main").select("x", "nx", F.col("node").alias("y"), F.col("n").alias("ny"))
    swap = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    return (pairs.filter(4 * F.least("nx", "ny") >= 3 * F.greatest("nx", "ny"))
            .select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.least("nx", "ny").alias("nx"),
                    F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"), F.greatest("nx", "ny").alias("ny"))
            .distinct())


def _named(shared: DataFrame, labels: DataFrame) -> DataFrame:
    return (shared.join(labels, "node", "left")
            .withColumn("part", F.coalesce("component_id", "node")).drop("component_id"))


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (main, block, minor_block, run), the nodes of a group (null run) first."""
    def packed(out) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["x", "nx", "y", "ny"])

    def flush() -> Iterator[pa.RecordBatch]:
        out = ([], [], [], [])
        ids = list(nodes)
        place = {v: i for i, v in enumerate(ids)}
        size = np.array([nodes[v][0] for v in ids], np.int64)
        part = np.array([nodes[v][1] for v in ids], np.int64)
        bits = [nodes[v][2] for v in ids]
        met = {r: np.array([place[v] for v in m], np.int64) for r, m in members.items()}
        for x, at in minors.items():
            i = place[x]
            some = np.unique(np.concatenate([met[r] for r in at if r in met] or [np.zeros(0, np.int64)]))
            n = size[i]
            some = some[(part[some] != part[i]) & (4 * np.minimum(size[some], n) >= 3 * np.maximum(size[some], n))]
            for j in some.tolist():
                if may_link(int(n), int(size[j]), bits[i], bits[j]):
                    a, b = sorted(((int(n), x), (int(size[j]), ids[j])))
                    for col, v in zip(out, (a[1], a[0], b[1], b[0])):
                        col.append(v)
            if len(out[0]) >= PAIRS_PER_BATCH:
                yield packed(out)
                out = ([], [], [], [])
        if out[0]:
            yield packed(out)

    key, nodes, members, minors = None, {}, {}, {}
    for batch in batches:
        for *group, run, node, minor, n, part, bits in zip(*(c.to_pylist() for c in batch.columns)):
            if key != group:
                if minors:
                    yield from flush()
                key, nodes, members, minors = group, {}, {}, {}
            if run is None:
                nodes[node] = (n, part, bits)
            elif minor:
                minors.setdefault(node, []).append(run)
            else:
                members.setdefault(run, []).append(node)
    if minors:
        yield from flush()


def open_candidates(shared: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """All pairs of a run that are in different components, of fitting size and
    close bitmaps.

    The runs are gathered by their largest component. Its members are dealt over
    blocks, and the nodes outside it over blocks of their own; a task gets one
    block of each (a node's rows stay together). So a pair that shares many runs
    is looked at once, and no group grows with the data. Only components of more
    than one block have their number of blocks looked up: one row for each
    ``BLOCK_ROWS`` rows at most."""
    named = _named(shared, labels)
    parts = named.groupBy("run", "part").agg(F.count("*").alias("held"))
    main = (parts.groupBy("run").agg(F.max(F.struct("held", "part")).alias("m"), F.count("*").alias("parts"))
            .filter("parts > 1").select("run", F.col("m.part").alias("main")))
    live = materialize(named.join(main, "run").select("main", "run", "node", "part"), "ngram-live")
    several = materialize(
        live.groupBy("main").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"),
                                 F.ceil(F.count_if(F.col("part") != F.col("main")) / BLOCK_ROWS).cast("int")
                                 .alias("minor_blocks")).filter("blocks > 1"), "ngram-several")
    dealt = (live.join(small_or_none(several, MAX_BROADCAST_IDS), "main", "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("minor_blocks", F.greatest(F.coalesce("minor_blocks", F.lit(1)), F.lit(1))))

    def place(blocks: str, salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(blocks)).cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    group = ["main", "block", "minor_block"]
    member = dealt.withColumn("block", place("blocks", 0)).withColumn("minor_block", every("minor_blocks"))
    minor = (dealt.filter("part <> main").withColumn("minor_block", place("minor_blocks", 1))
             .withColumn("block", every("blocks")))
    none = F.lit(None)
    met = (member.select(*group, "run", "node", F.lit(False).alias("minor"))
           .union(minor.select(*group, "run", "node", F.lit(True)))
           .select("*", none.cast("long").alias("n"), none.cast("long").alias("part"), none.cast("binary").alias("bits")))
    present = member.select(*group, "node", "part").union(minor.select(*group, "node", "part")).distinct()
    known = (present.join(nodes.select("node", "n", "bits"), "node")
             .select(*group, none.cast("long").alias("run"), "node", F.lit(False).alias("minor"), "n", "part", "bits"))
    tasks = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (met.unionByName(known).repartition(tasks, *group)
            .sortWithinPartitions(*group, F.asc_nulls_first("run"))
            .mapInArrow(released(_open_pairs), "x long, nx long, y long, ny long").distinct())


def _bit_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(1, 6)]
        ok = [may_link(nx, ny, bx, by) for nx, _, ny, bx, by in zip(*cols)]
        yield batch.select([0, 2]).filter(pa.array(ok, pa.bool_()))


def walk_trie(target: np.ndarray, paths: list[np.ndarray], step: int = 64) -> list[bool]:
    """Which of the paths (sets in global order) link with the target set.

    The paths are walked in trie order; the overlap of a shared beginning is
    kept, and a path is left where it can no longer reach the bound."""
    inside = np.sort(target)
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
    linked = [False] * len(paths)
    last, overlap, known = np.zeros(0, np.uint64), np.zeros(1, np.int64), 0
    for i in order:
        path = paths[i]
        n, need = len(path), _need(len(path), len(target))
        m = min(n, len(last), known)
        apart = np.flatnonzero(path[:m] != last[:m])
        depth = int(apart[0]) if len(apart) else m
        counts = np.empty(n + 1, np.int64)
        counts[:depth + 1] = overlap[:depth + 1]
        while depth < n and counts[depth] + (n - depth) >= need:
            rest = path[depth:depth + step]
            at = np.minimum(np.searchsorted(inside, rest), len(inside) - 1)
            counts[depth + 1:depth + 1 + len(rest)] = counts[depth] + np.cumsum(inside[at] == rest)
            depth += len(rest)
        linked[i] = depth == n and int(counts[n]) >= need
        last, overlap, known = path, counts, depth
    return linked


def _sets_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            seen = {}
            for _, s in shingle_sets(batch.column(0)):
                if len(s):
                    seen.setdefault(set_id(s), s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()),
                 pa.array([global_order(s, frequent)[0].tobytes() for s in seen.values()], pa.binary())],
                names=["node", "path"])
    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (x, part), the row of x itself first."""
    key, target, nodes, paths = None, None, [], []

    def links() -> pa.RecordBatch:
        ok = walk_trie(target, paths) if target is not None and paths else []
        hit = [n for n, k in zip(nodes, ok) if k]
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(hit), pa.int64()), pa.array(hit, pa.int64())],
                                          names=["a", "b"])

    for batch in batches:
        for x, part, node, path in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key != (x, part):
                if key is not None:
                    yield links()
                key, target, nodes, paths = (x, part), None, [], []
            path = np.frombuffer(path, np.uint64)
            if node == x:
                target = path
            else:
                nodes.append(node)
                paths.append(path)
    if key is not None:
        yield links()


def close_pairs(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidate pairs whose bitmaps do not rule a link out."""
    bits = nodes.select("node", "bits")
    return (pairs.join(bits.select(F.col("node").alias("x"), F.col("bits").alias("bx")), "x")
             .join(bits.select(F.col("node").alias("y"), F.col("bits").alias("by")), "y")
             .select("x", "nx", "y", "ny", "bx", "by")
             # column order of the filter: x, nx, y, ny, bx, by
             .mapInArrow(_bit_filter, "x long, y long"))


def verified_links(docs: DataFrame, nodes: DataFrame, close: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(a, b): the candidate pairs that link."""
    wanted = close.select(F.col("x").alias("node")).union(close.select(F.col("y").alias("node"))).distinct()
    ids = materialize(nodes.join(wanted, "node").select(F.col("rep").alias("_rep")).distinct(), "ngram-wanted")
    picked = docs.join(small_or_none(ids, MAX_BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    paths = (picked.select("text").mapInArrow(released(_sets_of(shared)), "node long, path binary")
             .groupBy("node").agg(F.any_value("path").alias("path")))
    sizes = close.groupBy("x").agg(F.ceil(F.count("*") / GROUP_MEMBERS).cast("int").alias("parts"))
    member = (close.join(sizes, "x")
              .withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int")).drop("parts"))
    member = (member.select("x", "part", F.col("y").alias("node"))
              .union(member.select("x", "part", F.col("x").alias("node")).distinct()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (member.join(paths, "node").select("x", "part", "node", "path")
            .repartition(parts, "x", "part").sortWithinPartitions("x", "part", "node")
            .mapInArrow(released(_verify), "a long, b long"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select("doc_id", "text")
    described = describe(docs)
    frequent = frequent_shingles(described)
    rows = described.filter("often is null").select("doc_id", "n", "node", "bits")
    nodes = materialize(rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits")), "ngram-nodes")
    n_postings = nodes.agg(F.sum(F.col("n") / 4 + 1).cast("long")).first()[0] or 0
    shared = runs(docs, frequent, n_postings)
    tested, labels = None, None
    for step in range(2 + MAIN_ROUNDS):
        if step == 0:
            pairs = first_candidates(shared)
        elif step <= MAIN_ROUNDS:
            pairs = main_candidates(shared, labels, step)
        else:
            pairs = open_candidates(shared, labels, nodes)
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti").select("x", "nx", "y", "ny")
        pairs = materialize(pairs, "ngram-pairs")
        close = pairs.select("x", "y") if step > MAIN_ROUNDS else materialize(close_pairs(nodes, pairs), "ngram-close")
        links = verified_links(docs, nodes, close, frequent)
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("component_id").alias("b")))
        labels = materialize(connected_components(links), "ngram-labels")
        tested = pairs.select("x", "y") if tested is None else tested.union(pairs.select("x", "y"))
    grouped = (nodes.select("node", "rep").join(labels, "node", "left")
               .withColumn("group", F.coalesce("component_id", "node")))
    least = grouped.groupBy("group").agg(F.min("rep").alias("component"))
    named = grouped.join(least, "group").select(F.col("node").alias("_node"), "component")
    return (rows.join(named, F.col("node") == F.col("_node"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")))
