"""Hard negatives, lexical search and token counts against brute force and odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actlens.llm import hard_negatives, lexical, token_counts
from actlens.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


# -- hard negatives

def mined(rows, positives=5, negatives=10):
    """Plain Python over (vec_id, label, vector): the contract, read literally."""
    used = []
    for uid, (vid, label, x) in enumerate(rows):
        if None in (vid, label, x) or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = [math.floor(256 * c) for c in x]
        if sum(c * c for c in q) < 2 ** 56:
            used.append((uid, vid, (label + 1) % 10 if vid % 7 == 0 else label, q))
    out = []
    for uid, vid, label, q in used:
        if vid % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), v, u, lab) for u, v, lab, r in used if len(r) == len(q) and u != uid]
        for ps, pid, _, _ in sorted(s for s in scored if s[3] == label)[:positives]:
            found = sorted(s for s in scored if s[3] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:negatives]
            out += [(vid, pid, n, f[1], -ps, -f[0]) for n, f in enumerate(found, 1)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, uid string, q int, ta int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)


def got_negatives(spark, rows):
    got = hard_negatives.mine_negatives(vectors(spark, rows), F.col("vec_id") % 100 == 0).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                  for r in got)


@pytest.mark.parametrize("dim,scale", [(1, 1.0), (3, 1.0), (20, 0.5), (64, 2000.0)])
def test_negatives_match_brute_force(spark, dim, scale):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(4, dim))
    rows = [(int(i) * 25, int(rng.integers(4)), (scale * (centres[i % 4] + rng.normal(size=dim) * 0.6)).tolist())
            for i in range(160)]
    rows += rows[:30] + [(i + 1, 1, rows[0][2]) for i in range(20)]       # repeated rows, copies and ties
    got = got_negatives(spark, rows)
    assert got == mined(rows) and got


def test_negatives_of_odd_rows(spark):
    x, nan, inf = [0.5, -0.25, 1.0], float("nan"), float("inf")
    rows = [(0, 1, x), (0, 1, x), (1, 1, x), (2, 2, [0.25, -0.1, 0.5]), (3, 2, None), (4, 2, [None, 1.0, 1.0]), (5, None, x),
            (6, 2, [nan, 0.0, 0.0]), (8, 2, [inf, 0.0, 0.0]), (9, 2, [0.0, 0.0, 0.0]), (10, 2, [0.3]), (None, 2, x),
            (11, 2, [1e300, 1.0, 1.0]), (100, 1, []), (101, 1, []), (102, 3, []), (7, 0, x), (14, 9, [0.2, -0.2, 0.4]),
            (200, 5, [-1.0, 0.0, 0.0]), (201, 5, [1.0, 0.0, 0.0])]
    got = got_negatives(spark, rows)
    assert got == mined(rows) and {r[0] for r in got} == {0, 100}
    assert got_negatives(spark, rows[2:4]) == []
    assert hard_negatives.mine_negatives(vectors(spark, rows).limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_negatives_beyond_exact_doubles(spark):
    rng = np.random.default_rng(5)
    rows = [(100 * i, i % 2, [float(c) for c in rng.integers(400_000, 700_000, 2)]) for i in range(12)]
    assert got_negatives(spark, rows) == mined(rows)


def test_negatives_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_TILE", 3)
    monkeypatch.setattr(hard_negatives, "ROW_TILES", 7)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 8))
    rows = [(50 * i, i % 3, (centres[i % 3] + rng.normal(size=8) * 0.5).tolist()) for i in range(60)]
    rows += [(1000 + i, 2, rows[5][2]) for i in range(1, 40)]
    assert got_negatives(spark, rows) == mined(rows)


@given(st.integers(1, 40), st.integers(0, 2 ** 31))
@settings(max_examples=40, deadline=None)
def test_bounds_never_lose_a_pair(dim, seed):
    rng = np.random.default_rng(seed)
    a, v = (rng.integers(-300, 300, (n, dim)).astype(float) for n in (5, 9))
    score = a @ v.T
    floor, ceil = score[:, 0].astype(np.int64) - 10, score[:, 1].astype(np.int64) + 10
    i, j, s = hard_negatives.bounded_scores(a, hard_negatives.summaries(a), v, hard_negatives.summaries(v), floor, ceil,
                                            np.ones(score.shape, bool))
    want = np.argwhere((score >= floor[:, None]) & (score <= ceil[:, None]))
    assert sorted(zip(i.tolist(), j.tolist())) == [tuple(x) for x in want.tolist()] and (s == score[i, j]).all()


# -- lexical search

def terms_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k=10):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(terms_of(text)) if c[t])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


DOCS = "doc_id long, text string, term string, n int"


def got_ranks(spark, docs, items, **kwargs):
    d = spark.createDataFrame([(*r, "t", 1) for r in docs], DOCS)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, uid int")
    return sorted(map(tuple, lexical.rank_documents(d, i, **kwargs).collect()))


def random_texts(seed, n):
    rng = random.Random(seed)
    common, rare = ["the", "Of", "é", "x1", "und"], [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randrange(1, 60)))
             for _ in range(n)]
    return texts + texts[: n // 4]


@pytest.mark.parametrize("shard_docs,held", [(lexical.SHARD_DOCS, lexical.ITEM_TERMS), (7, 25)])
def test_ranks_match_brute_force(spark, monkeypatch, shard_docs, held):
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard_docs)
    docs = list(enumerate(random_texts(1, 150)))
    items = list(enumerate(random_texts(2, 8)))
    got = got_ranks(spark, docs, items, item_terms_held=held)
    assert got == ranked(docs, items) and len(got) == 10 * len(items)


def test_ranks_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!! --"), (4, "Cat cat\x7fDOG"), (4, "cat dog"), (5, "cat dog"), (None, "cat cat"),
            (6, "naïve café İ"), (7, "word " * 30_000), (8, "a_b"), (9, "x")]
    items = [(1, "cat"), (1, "cat"), (2, None), (3, "?"), (4, "CAFÉ café naïve"), (5, "zebra"), (None, "b a"), (6, "word x")]
    key = lambda rows: sorted(rows, key=repr)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert key(map(tuple, lexical.rank_documents(d, i).collect())) == key(ranked_any(docs, items))
    assert lexical.rank_documents(d.limit(0), i).count() == 0 and lexical.rank_documents(d, i.limit(0)).count() == 0


def ranked_any(docs, items):
    return [(i if i != -1 else None, *rest) for i, *rest in ranked(docs, [(-1 if i is None else i, t) for i, t in items])]


@given(st.lists(st.one_of(st.none(), st.text("aB9_ \x7f\x00é@[`{", max_size=25)), max_size=6))
@settings(max_examples=60, deadline=None)
def test_term_counts_match_plain_python(texts):
    rows = [(a + i, first[i + 1] - first[i]) for a, b, _, first in lexical._chunks(pa.array(texts, pa.string())) for i in range(b - a)]
    assert [n for _, n in rows] == [len(terms_of(t)) for t in texts]


def test_pair_bounds_hold_and_are_tighter():
    rng = np.random.default_rng(4)
    n_terms, n_docs = 12, 200
    doc, term = np.nonzero(rng.random((n_docs, n_terms)) < 0.3)
    impact = rng.integers(1, 1000, len(doc))
    item = np.arange(n_terms)
    plan = lexical.make_plan([item], {t: 5 + t for t in range(n_terms)}, n_docs, 10 * n_docs, n_terms)
    shard = lexical.Shard.build(plan, np.arange(n_docs), doc, term, impact)
    at, bound = shard.bounds(plan, 0)
    dense = np.zeros((n_docs, n_terms), np.int64)
    dense[doc, term] = impact
    for j in range(n_terms + 1):
        assert dense[:, plan.terms[0][:j]].sum(axis=1).max(initial=0) <= bound[j] <= shard.top[at[:j]].sum()
    assert bound[-1] < shard.top[at].sum()
    ids, score = shard.search(plan, 0, 0, 10)
    total = dense.sum(axis=1)
    want = np.lexsort((np.arange(n_docs), -total))[:10]
    assert ids.tolist() == want.tolist() and score.tolist() == total[want].tolist()


# -- token counts

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL_NAME))


@pytest.fixture(scope="module")
def merges():
    return token_counts.load_merges(public_tokenizers.path(token_counts.MODEL_NAME))


@given(st.lists(st.one_of(st.text(max_size=60), st.text(" \n\t▁aethoin", max_size=90), st.text("ﬁé😀<s>/0x41\x00", max_size=40)),
                max_size=6))
@settings(max_examples=150, deadline=None)
def test_counts_equal_the_library(library, merges, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert token_counts.token_counts(merges, pa.array(texts, pa.string()), 64).tolist() == [len(library.encode(t)) for t in texts]


def test_queue_and_rounds_merge_alike(library, merges, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("theinroasd éñ▁\n0") for _ in range(rng.randrange(120))) for _ in range(400)]
    want = [len(library.encode(t)) for t in texts]
    for long in (1, 6, 10 ** 6):
        monkeypatch.setattr(token_counts, "LONG", long)
        assert token_counts.token_counts(merges, pa.array(texts)).tolist() == want


def test_every_whole_token_is_one(library, merges):
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())
              if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
    alone = [len(library.encode("\n" + p.replace("▁", " "))) - 2 for p in pieces]
    assert len(merges.whole) == alone.count(1) > 30_000


def test_counts_of_odd_rows(spark, library, merges):
    rows = [(1, None), (2, ""), (3, " "), (None, "a <s> </s>"), (4, "word " * 30_000), (4, "x" * 50_000), (5, "a▁b c"), (5, "a▁b c")]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, n_tokens int, over_limit boolean")
    got = token_counts.count_tokens(docs, merges)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = [len(library.encode(t or "")) for _, t in rows]
    want = [(d, len((t or "").encode()), k, k > 4096) for (d, t), k in zip(rows, n)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(docs.limit(0), merges).count() == 0


def test_registered_counts_equal_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in Q.QUERIES["op13_token_counts"](spark, SMALL).collect()}
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs}
