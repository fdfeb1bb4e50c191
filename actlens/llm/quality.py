"""Quality classification by a sparse ensemble of rules.

Every text is described by statistics of the whole text. Small trees are
boosted on a bounded sample of labelled rows; each path from a root to a node
is a rule, a conjunction of comparisons. A logistic model with lasso penalty
weighs the rules; those that keep a weight are compiled into one Spark column
expression over the statistics columns, which scores all documents.

Defined cases: null and empty texts have all statistics 0 and are scored like
any other; labels that are null, or whose document is missing, are not learned
from; without both labels in the sample the score is the share of label 1 (0.5
without any); repeated rows are scored alike; an empty table gives an empty
result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.common import released
from actlens.llm.shingles import _buffers, word_hashes

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
PREFIX = "_stat_"
STATS = ("bytes", "words", "word_len", "upper", "digit", "symbol", "marks", "stops", "beyond_ascii", "space",
         "line_len", "distinct_words", "top_word", "repeated_lines", "repeated_runs", "long_words",
         "capital_words", "mark_words")

_CLASS = np.zeros(256, np.uint8)      # 0: other bytes
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@<>{}[]|~^=+\\/_", b",;:'\"!?()-", b".",
                             b" \t\n\x0b\x0c\r"), start=1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7
_CLASSES = 8
_LONG_WORD = 20


def _share(values: np.ndarray) -> tuple[float, float]:
    """Share of distinct values, and of the most frequent one."""
    s = np.sort(values)
    edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    runs = np.diff(edges)
    return len(runs) / len(s), float(runs.max()) / len(s)


def text_stats(texts: pa.Array, chunk_bytes: int = 1 << 20) -> np.ndarray:
    """One row of ``STATS`` per text."""
    data, offsets = _buffers(texts)
    out = np.zeros((len(texts), len(STATS)))
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        stop = min(len(texts), max(row + 1, stop))
        part = offsets[row:stop + 1] - offsets[row]
        chunk = data[offsets[row]:offsets[stop]]
        kinds = _CLASS[chunk]
        words, firsts = word_hashes(chunk, part)
        separators = kinds == 6
        ends = np.flatnonzero(chunk == 10)
        for i in range(stop - row):
            a, b, wa, wb = int(part[i]), int(part[i + 1]), int(firsts[i]), int(firsts[i + 1])
            if b == a or wb == wa:
                out[row + i, 0] = b - a
                continue
            n, w = b - a, words[wa:wb]
            c = np.bincount(kinds[a:b], minlength=_CLASSES) / n
            seps = separators[a:b]
            starts = np.flatnonzero(~seps & np.concatenate([[True], seps[:-1]]))
            stops = np.flatnonzero(~seps & np.concatenate([seps[1:], [True]]))
            lens = stops - starts + 1
            distinct, top = _share(w)
            lines = ends[np.searchsorted(ends, a):np.searchsorted(ends, b)]
            line_starts = np.concatenate([[a], lines + 1])
            line_starts = line_starts[line_starts < b]
            repeated_lines = 0.0
            if len(line_starts) > 1:
                at = np.searchsorted(starts + a, line_starts)
                at = at[at < len(w)]
                sums = np.add.reduceat(w, np.unique(at))
                repeated_lines = 1 - _share(sums)[0]
            runs = 0.0
            if len(w) > 3:
                runs = 1 - _share(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7))[0]
            out[row + i] = (n, len(w), lens.mean(), c[1], c[2], c[3], c[4], c[5], c[7], c[6],
                            n / len(line_starts), distinct, top, repeated_lines, runs,
                            (lens > _LONG_WORD).mean(), (kinds[a:b][starts] == 1).mean(),
                            (kinds[a:b][stops] == 3).mean())
        row = stop
    return out


def free_prefix(columns: list[str]) -> str:
    """``PREFIX``, with more underscores in front where a column begins with it."""
    prefix = PREFIX
    while any(c.startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` and one column per statistic of its text, named by ``free_prefix``."""
    at = docs.columns.index("text")
    prefix = free_prefix(docs.columns)
    names = [prefix + s for s in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_stats(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(stats[:, k], pa.float64()) for k in range(len(STATS)))],
                names=[*batch.schema.names, *names])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


Rule = tuple[tuple[int, bool, float], ...]   # (statistic, above, threshold), all must hold


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self, prefix: str = PREFIX) -> Column:
        """The probability of label 1 as a column over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            held = F.lit(True)
            for k, above, t in rule:
                c = F.col(prefix + STATS[k])
                held = held & (c > t if above else c <= t)
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for k, above, t in rule:
            out[:, j] &= x[:, k] > t if above else x[:, k] <= t
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32,
               rate: float = 0.3, least: int = 10) -> list[Rule]:
    """Paths of small boosted trees (logistic loss, quantile bins)."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    rules: dict[Rule, None] = {}
    margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        stack: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(y)))]
        while stack:
            path, rows = stack.pop()
            g, h = gradient[rows], curve[rows]
            best = (1e-3, -1, 0)
            if len(path) < depth and len(rows) >= 2 * least:
                base = g.sum() ** 2 / (h.sum() + 1)
                for k in range(x.shape[1]):
                    if not len(cuts[k]):
                        continue
                    m = len(cuts[k]) + 1
                    gs = np.cumsum(np.bincount(codes[rows, k], g, m))[:-1]
                    hs = np.cumsum(np.bincount(codes[rows, k], h, m))[:-1]
                    ns = np.cumsum(np.bincount(codes[rows, k], minlength=m))[:-1]
                    gain = gs ** 2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), k, j)
            if path:
                rules.setdefault(path)
            if best[1] < 0:
                margin[rows] += rate * g.sum() / (h.sum() + 1)
                continue
            _, k, j = best
            low = codes[rows, k] <= j
            t = float(cuts[k][j])
            stack.append((path + ((k, False, t),), rows[low]))
            stack.append((path + ((k, True, t),), rows[~low]))
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient steps."""
    r = r.astype(np.float64)
    n = len(y)
    v = np.ones(r.shape[1]) / np.sqrt(r.shape[1])
    for _ in range(20):
        v = r.T @ (r @ v)
        v /= np.linalg.norm(v) + 1e-12
    bound = 0.25 * (float(np.linalg.norm(r @ v) ** 2) / n + 1.0) + 1e-9
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ pw + pb)))
        e = p - y
        nw = pw - (r.T @ e) / n / bound
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / bound, 0)
        nb = pb - e.mean() / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel([], [], float(np.log(share / (1 - share))))
    rules = grow_rules(x, y)
    held = rule_matrix(x, rules)
    w, b = lasso_logistic(held, y)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[j] for j in keep], [float(w[j]) for j in keep], b)


def fit_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fits on at most ``rows`` labelled rows: of at most that many ids (the first
    by a hash of the id, broadcast to pick the texts) the first different texts
    by a hash of id and text."""
    sample = (labels.filter(learn_from & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("quality").alias("_label"))
              .orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(rows))
    chosen = with_stats(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    chosen = (chosen.withColumn("_key", F.xxhash64("doc_id", "text")).drop("text").dropDuplicates(["doc_id", "_key"])
              .orderBy("_key", "doc_id").limit(rows).drop("_key"))
    got = sorted(tuple(r) for r in chosen.collect())
    values = np.array([r[1:] for r in got], float).reshape(len(got), len(STATS) + 1)
    return fit_rules(values[:, 1:], (values[:, 0] == 1).astype(float))


def score_quality(docs: DataFrame, model: RuleModel, score_column: str = "quality_score") -> DataFrame:
    """``docs`` and its score; a column of the score's name is replaced."""
    prefix = free_prefix(docs.columns)
    scored = with_stats(docs).withColumn(score_column, model.column(prefix))
    return scored.drop(*(prefix + s for s in STATS))
