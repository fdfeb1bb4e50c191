"""Ranked lexical search with pair-bound MaxScore.

Terms are runs of ASCII letters and digits and of all other non-ASCII characters,
A-Z lower-cased. One pass over whole documents keeps, of every document, its
number of terms and the counts of the terms that any item asks for. From these
come the corpus statistics, and then an index in shards of whole documents: per
term its postings (document, impact) and its greatest impact, and per pair of
terms the greatest joint impact of a document that holds both.

An item's terms are ordered by weight, the commonest first, and neighbours form
the pairs. The bound of the first j terms adds, for every pair, the greatest of
its two single maxima and its joint maximum, which is never above the sum of the
single ones. Terms whose bound together stays below the score to beat are not
essential: documents are taken from the essential terms' postings only, and
looked up in the other lists, rarest first, as long as what is left can lift them
high enough. The score to beat comes from the shard with an item's highest bound
first; a shard whose bound is below it is skipped.

Terms are compared by 64-bit hashes. Items are worked on in groups of bounded
total size; a shard ends at ``SHARD_POSTINGS`` postings or ``SHARD_DOCS``
documents, so no task holds more than one shard of one group.

Defined cases: a null or empty text has no terms; documents without terms do not
count; documents with a null id count in the statistics but are not ranked; rows
that repeat a document or item are documents and items of their own; equal scores
go by ascending doc_id; items without a match, and empty tables, give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actlens.llm.common import materialize, released
from actlens.llm.shingles import _BYTE_CODE, _LOWER, _buffers, _powers, mix64

K = 10
ITEM_TERMS = 1_000_000
SHARD_DOCS, SHARD_POSTINGS = 16_384, 400_000
CHUNK_BYTES = 1 << 21
_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x80:] = True
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _IS_TERM[_a:_b + 1] = True

_RESULT = "item_id long, rank int, doc_id long, score long"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every term and, per text, the index of its first term."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)        # a text starts here
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    size = end - start
    total = int(size.sum())
    first = np.cumsum(size) - size
    place = np.arange(total) - np.repeat(first, size)
    code = _BYTE_CODE[_LOWER[data[np.repeat(start, size) + place]]]
    code *= _powers(int(size.max(initial=1)))[place]
    sums = np.add.reduceat(code, first) if len(first) else np.zeros(0, np.uint64)
    return mix64(sums + size.astype(np.uint64)), np.searchsorted(start, offsets)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, term hashes, index of each row's first term)."""
    data, offsets = _buffers(texts)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        stop = min(len(texts), max(row + 1, stop))
        yield row, stop, *term_hashes(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, text) -> uid, item_id, terms: the distinct term hashes of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, h, first in _chunks(batch.column(2)):
                found += [np.unique(h[first[i]:first[i + 1]]).view(np.int64) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["uid", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("long"), "text")
    return rows.mapInArrow(released(run), "uid long, item_id long, terms array<long>")


def document_hits(docs: DataFrame, dictionary: np.ndarray) -> DataFrame:
    """doc_id, n (its terms), term and tf (the asked terms it holds, by their
    number in the sorted ``dictionary``); documents without terms are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, h, first in _chunks(batch.column(1)):
                n = np.diff(first)
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                hit = np.flatnonzero(known[at] == h) if len(known) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b - a), n)[hit]
                key, tf = np.unique(row * np.int64(len(known) + 1) + at[hit], return_counts=True)
                row, term = np.divmod(key, len(known) + 1)
                edge = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(edge, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(edge, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "term", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        released(run), "doc_id long, n long, term array<int>, tf array<long>")


@dataclass
class Plan:
    """The items of a group, as the search needs them."""

    weight: np.ndarray              # by term number
    n_docs: int
    n_terms: int
    terms: list[np.ndarray]         # per item: term numbers, lightest first
    pair: list[np.ndarray]          # per item: number of the pair at positions (0, 1), (2, 3), ...
    pairs: np.ndarray               # two term numbers per distinct pair

    def impacts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 10 + 90 * n * self.n_docs // self.n_terms
        return self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def make_plan(items: list[np.ndarray], df: dict[int, int], n_docs: int, n_terms: int, n_known: int) -> Plan:
    """``items``: term numbers; terms that no document holds are left out."""
    weight = np.zeros(n_known, np.int64)
    for t, c in df.items():
        weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1)))
    numbers: dict[tuple[int, int], int] = {}
    terms, pair = [], []
    for item in items:
        t = item[weight[item] > 0]
        t = t[np.lexsort((t, weight[t]))]
        terms.append(t)
        pair.append(np.array([numbers.setdefault(p, len(numbers)) for p in zip(t[:-1:2].tolist(), t[1::2].tolist())], np.int64))
    return Plan(weight, n_docs, n_terms, terms, pair, np.array(list(numbers), np.int64).reshape(-1, 2))


@dataclass
class Shard:
    doc_id: np.ndarray
    term: np.ndarray        # sorted term numbers
    start: np.ndarray       # of each term's postings, one more at the end
    top: np.ndarray         # greatest impact of each term
    doc: np.ndarray         # places in doc_id, ascending within a term
    impact: np.ndarray
    joint: np.ndarray       # greatest joint impact of each pair of the plan, 0 where no document holds both

    FIELDS = (("doc_id", np.int64), ("term", np.int32), ("start", np.int32), ("top", np.int64), ("doc", np.int32),
              ("impact", np.int64), ("joint", np.int64))

    @staticmethod
    def build(plan: Plan, doc_id: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> "Shard":
        order = np.argsort(term, kind="stable")     # documents stay in order
        term, doc, impact = term[order], doc[order], impact[order]
        names, start = np.unique(term, return_index=True)
        top = np.maximum.reduceat(impact, start) if len(start) else np.zeros(0, np.int64)
        shard = Shard(doc_id, names, np.append(start, len(term)), top, doc, impact, np.zeros(len(plan.pairs), np.int64))
        at = shard.find(plan.pairs)
        for p in np.flatnonzero((at >= 0).all(axis=1)).tolist():
            (d, x), (e, y) = sorted((shard.postings(i) for i in at[p].tolist()), key=lambda s: len(s[0]))
            to = np.searchsorted(e, d)
            to[to == len(e)] = 0
            both = e[to] == d
            shard.joint[p] = (x + y[to])[both].max(initial=0)
        return shard

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term number, -1 where the shard has none."""
        at = np.searchsorted(self.term, terms)
        at[at == len(self.term)] = 0
        return np.where(self.term[at] == terms, at, -1) if len(self.term) else np.full(terms.shape, -1)

    def postings(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.doc[self.start[i]:self.start[i + 1]], self.impact[self.start[i]:self.start[i + 1]]

    def bounds(self, plan: Plan, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the item's terms, and the bound of its first j terms for every j."""
        at = self.find(plan.terms[item])
        alone = np.where(at >= 0, self.top[at], 0) if len(self.top) else np.zeros(len(at), np.int64)
        pairs = plan.pair[item]
        both = np.maximum(np.maximum(alone[:-1:2], alone[1::2]), self.joint[pairs])
        bound = np.zeros(len(at) + 1, np.int64)
        bound[2::2] = np.cumsum(both)
        bound[1::2] = bound[:-1:2] + alone[::2]
        return at, bound

    def search(self, plan: Plan, item: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc_id, score) of the k best documents that reach ``least``."""
        at, bound = self.bounds(plan, item)
        least = max(1, least)
        if bound[-1] < least:
            return _NOTHING
        score = np.zeros(len(self.doc_id), np.int64)
        cut = int(np.searchsorted(bound, least)) - 1      # the first `cut` terms are not essential
        for i in at[cut:].tolist():
            if i >= 0:
                doc, impact = self.postings(i)
                score[doc] += impact
        docs = np.flatnonzero(score)
        for j in range(cut - 1, -1, -1):
            got = score[docs]
            if len(docs) > k:           # what is there already is a lower bound
                least = max(least, int(np.partition(got, len(got) - k)[len(got) - k]))
            docs = docs[got + bound[j + 1] >= least]
            if not len(docs):
                return _NOTHING
            if at[j] >= 0:
                doc, impact = self.postings(int(at[j]))
                if len(doc) > 4 * len(docs):
                    to = np.searchsorted(doc, docs)
                    to[to == len(doc)] = 0
                    score[docs] += np.where(doc[to] == docs, impact[to], 0)
                else:
                    score[doc] += impact
        got, ids = score[docs], self.doc_id[docs]
        order = np.lexsort((ids, -got))[:k]
        order = order[got[order] >= least]
        return ids[order], got[order]

    def row(self, number: int, bounds: np.ndarray) -> dict:
        return {"shard": number, "bounds": bounds.tolist()} | {
            name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.FIELDS}


_NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))
_SHARD = "shard long, bounds array<long>, " + ", ".join(f"{name} binary" for name, _ in Shard.FIELDS)


def build_shards(hits: DataFrame, plan: Plan) -> DataFrame:
    """The index: one row per shard, and each item's bound in it."""
    shared = hits.sparkSession.sparkContext.broadcast(plan)
    schema = pa.schema([("shard", pa.int64()), ("bounds", pa.list_(pa.int64())), *((n, pa.binary()) for n, _ in Shard.FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, number = shared.value, TaskContext.get().partitionId() << 32
        held, docs, postings = [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, docs, postings, number
            ids, size, term, impact = (np.concatenate(x) for x in zip(*held))
            shard = Shard.build(plan, ids, np.repeat(np.arange(len(ids)), size), term, impact)
            bounds = np.array([shard.bounds(plan, i)[1][-1] for i in range(len(plan.terms))], np.int64)
            held, docs, postings, number = [], 0, 0, number + 1
            return pa.RecordBatch.from_pylist([shard.row(number - 1, bounds)], schema)

        for batch in batches:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = batch.column(2).offsets.to_numpy()
            term, tf = (batch.column(c).values.to_numpy() for c in (2, 3))
            size = np.diff(edge)
            a = 0
            while a < len(ids):
                room = max(int(edge[a]) + SHARD_POSTINGS - postings, int(edge[a + 1]) if not docs else 0)
                b = int(np.searchsorted(edge, room, side="right")) - 1
                b = min(b, a + SHARD_DOCS - docs, len(ids))
                if b > a:
                    part = slice(int(edge[a]), int(edge[b]))
                    held.append((ids[a:b], size[a:b], term[part], plan.impacts(np.repeat(n[a:b], size[a:b]), term[part], tf[part])))
                    docs, postings, a = docs + b - a, postings + int(edge[b] - edge[a]), b
                if a < len(ids) and docs:
                    yield close()
        if docs:
            yield close()

    ranked = hits.filter("doc_id is not null and size(term) > 0")
    return ranked.mapInArrow(released(run), _SHARD)


def _searched(shards: DataFrame, plan: Plan, least: np.ndarray, first: np.ndarray | None, k: int) -> DataFrame:
    """item, doc_id, score. Without ``first`` every item in the shards named in
    ``asked``; with it every item in every shard but its ``first``."""
    shared = shards.sparkSession.sparkContext.broadcast((plan, least, first))
    rest = first is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, least, first = shared.value
        least = least.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                number = batch.column(0)[r].as_py()
                bounds = batch.column(1).slice(r, 1).flatten().to_numpy()
                if rest:
                    items = np.flatnonzero((bounds >= np.maximum(least, 1)) & (first != number))
                else:
                    items = batch.column(2).slice(r, 1).flatten().to_numpy()
                if not len(items):
                    continue
                at = 2 if rest else 3
                shard = Shard(*(np.frombuffer(batch.column(at + c)[r].as_buffer(), kind)
                                for c, (_, kind) in enumerate(Shard.FIELDS)))
                for i in items.tolist():
                    ids, score = shard.search(plan, i, int(least[i]), k)
                    if not len(ids):
                        continue
                    if i in best:
                        ids, score = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], score])
                        order = np.lexsort((ids, -score))[:k]
                        ids, score = ids[order], score[order]
                    best[i] = ids, score
                    if len(ids) == k:
                        least[i] = max(least[i], score[-1])
        if best:
            size = [len(ids) for ids, _ in best.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(list(best), np.int64), size)),
                 pa.array(np.concatenate([ids for ids, _ in best.values()])),
                 pa.array(np.concatenate([s for _, s in best.values()]))], names=["item", "doc_id", "score"])

    columns = ["shard", "bounds", *([] if rest else ["asked"]), *(name for name, _ in Shard.FIELDS)]
    return shards.select(*columns).mapInArrow(released(run), "item long, doc_id long, score long")


def _search_group(docs: DataFrame, items: list, k: int) -> DataFrame:
    """uid, rank, doc_id, score for the collected items (uid, item_id, terms) of one group."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], _RESULT)
    asked = [np.array(r["terms"], np.int64).view(np.uint64) for r in items]
    dictionary = np.unique(np.concatenate([*asked, np.zeros(0, np.uint64)]))
    hits = materialize(document_hits(docs, dictionary), "lexical-hits")
    total = hits.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"] or not len(dictionary):
        return empty
    df = {r["t"]: r["count"] for r in hits.select(F.explode("term").alias("t")).groupBy("t").count().collect()}
    plan = make_plan([np.searchsorted(dictionary, t) for t in asked], df, total["docs"], total["terms"], len(dictionary))
    shards = materialize(build_shards(hits, plan), "lexical-shards")

    # the shard with an item's highest bound first: its k-th score is the one to beat
    first = (shards.select("shard", F.posexplode("bounds").alias("item", "bound")).filter("bound > 0")
             .groupBy("item").agg(F.max_by("shard", F.struct("bound", -F.col("shard"))).alias("shard")))
    first = materialize(first, "lexical-first")
    chosen = np.full(len(items), -1, np.int64)
    for r in first.collect():
        chosen[r["item"]] = r["shard"]
    by_shard = first.groupBy("shard").agg(F.sort_array(F.collect_list(F.col("item").cast("long"))).alias("asked"))
    near = materialize(_searched(shards.join(F.broadcast(by_shard), "shard"), plan, np.zeros(len(items), np.int64), None, k),
                       "lexical-near")
    least = np.zeros(len(items), np.int64)
    for r in near.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).collect():
        least[r["item"]] = r["s"]
    found = near.unionByName(_searched(shards, plan, least, chosen, k))
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item long, item_id long")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, item_terms_held: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    asked = materialize(item_terms(items).filter("size(terms) > 0"), "lexical-items")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-size // item_terms_held)
    out = docs.sparkSession.createDataFrame([], _RESULT)
    for g in range(groups):
        mine = asked.filter(F.pmod(F.xxhash64("uid"), F.lit(groups)) == g).orderBy("uid").collect()
        if mine:
            found = _search_group(docs, mine, k)
            out = found if groups == 1 else out.unionByName(materialize(found, "lexical-group"))
    return out
