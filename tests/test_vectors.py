"""Moment accumulators, tiled products, row-local top-k and the checked lookup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.operators import joins as J
from actlens.operators import moments as MO
from actlens.operators import stats as A
from actlens.operators import tiles as TI


def rows_of(spark, x, groups):
    return spark.createDataFrame([(i, g, v.tolist()) for i, (v, g) in enumerate(zip(x, groups))], "id BIGINT, g STRING, vec ARRAY<DOUBLE>")


@pytest.mark.parametrize("held", [1, 64 << 20])
def test_group_moments_match_numpy(spark, held):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 5)) * 2 + 1e5
    groups = np.where(rng.random(300) < 0.4, "hot", [f"g{i}" for i in rng.integers(0, 40, 300)]).tolist()
    groups[7] = groups[8] = None
    got = {r["g"]: r for r in MO.group_moments(rows_of(spark, x, groups).repartition(7), ["g"], held_bytes=held).collect()}
    assert set(got) == set(groups)
    for g, r in got.items():
        mine = x[[i for i, v in enumerate(groups) if v == g]]
        assert r["n"] == len(mine) and np.allclose(r["mean"], mine.mean(axis=0), rtol=1e-12)
        assert np.allclose(r["m2"], ((mine - mine.mean(axis=0)) ** 2).sum(axis=0), atol=1e-4)
        assert np.array_equal(r["lo"], mine.min(axis=0)) and np.array_equal(r["hi"], mine.max(axis=0))
    whole = MO.group_moments(rows_of(spark, x, groups).repartition(3), []).collect()
    assert len(whole) == 1 and np.allclose(whole[0]["mean"], x.mean(axis=0))
    assert MO.group_moments(rows_of(spark, x, groups).limit(0), ["g"]).count() == 0


def test_batch_norm_shuffles_accumulators_not_values(spark):
    rng = np.random.default_rng(2)
    x, groups = rng.standard_normal((80, 4)), [f"g{i % 3}" for i in range(79)] + [None]
    df = rows_of(spark, x, groups)
    got = {r["id"]: r["normed"] for r in MO.batch_norm_vectors(df, group_cols=["g"]).collect()}
    for g in ("g0", "g1", "g2"):
        at = [i for i, v in enumerate(groups) if v == g]
        want = (x[at] - x[at].mean(axis=0)) / (x[at].std(axis=0, ddof=1) + 1e-6)
        assert np.allclose([got[i] for i in at], want)
    assert got[79] is None          # a group of one has no deviation
    plan = MO.batch_norm_vectors(df, group_cols=["g"])._jdf.queryExecution().toString()
    assert "explode" not in plan


@pytest.mark.parametrize("dense,result", [(1024, 4096), (4, 3)])
def test_products_match_numpy(spark, monkeypatch, dense, result):
    monkeypatch.setattr(TI, "DENSE_TILE", dense)
    monkeypatch.setattr(TI, "RESULT_TILE", result)
    monkeypatch.setattr(TI, "PAIR_TILE", dense)
    rng = np.random.default_rng(3)
    full = rng.standard_normal((20, 12)) * (rng.random((20, 12)) < 0.3)
    full[:, 5] = rng.standard_normal(20)               # a hot index
    full[4] = 0
    w = rng.standard_normal((12, 6))
    entries = [(int(a), int(i), float(full[a, i])) for a, i in zip(*np.nonzero(full))] + [(4, 1, 0.0), (3, 99, 2.0)]
    sp = spark.createDataFrame(entries, "a BIGINT, index INT, value DOUBLE").repartition(5)
    de = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "row INT, vec ARRAY<DOUBLE>")
    got = {r["row"]: r["out"] for r in TI.sparse_dense_product(sp, de).collect()}
    assert set(got) == {a for a in range(20) if full[a].any()}
    assert all(np.allclose(got[a], full[a] @ w) for a in got)
    x = rng.standard_normal((20, 3))
    xs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row BIGINT, vec ARRAY<DOUBLE>")
    got = {r["row"]: r["out"] for r in TI.sparse_t_dense_product(sp.where("index < 12"), xs, 14).collect()}
    want = np.vstack([full.T @ x, np.zeros((2, 3))])
    assert sorted(got) == list(range(14)) and all(np.allclose(got[i], want[i]) for i in got)
    y = rng.standard_normal((9, 3))
    ys = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "j BIGINT, vec ARRAY<DOUBLE>")
    at = [(i, 2) for i in range(20)] + [(3, j) for j in range(9)] + [(50, 1), (1, 50)]      # (3, 2) twice, two without vectors
    got = TI.sampled_product(xs.withColumnRenamed("row", "i"), ys, spark.createDataFrame(at, "i BIGINT, j BIGINT")).collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted(p for p in at if 50 not in p)
    assert all(abs(r["value"] - x[r["i"]] @ y[r["j"]]) < 1e-12 for r in got)


def test_topk_dims_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, [3.0, 1.0, 3.0, -2.0]), (2, [5.0])], "vec_id BIGINT, vec ARRAY<DOUBLE>")
    hi = A.topk_dims(df, 2)
    assert sorted(map(tuple, hi.collect())) == [(1, 1, 0, 3.0), (1, 2, 2, 3.0), (2, 1, 0, 5.0)]
    assert sorted(map(tuple, A.topk_dims(df, 2, largest=False).collect())) == [(1, 1, 3, -2.0), (1, 2, 1, 1.0), (2, 1, 0, 5.0)]
    assert "Exchange" not in hi._jdf.queryExecution().executedPlan().toString()


def test_lookup_join_names_a_missing_id(spark):
    table = spark.createDataFrame([(1, [1.0]), (2, None)], "token_id BIGINT, vec ARRAY<DOUBLE>")
    seq = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "pos BIGINT, token_id BIGINT")
    assert sorted((r["pos"], r["vec"]) for r in J.lookup_join(seq, table).collect()) == [(0, [1.0]), (1, None), (2, [1.0])]
    lost = seq.union(spark.createDataFrame([(3, 9)], "pos BIGINT, token_id BIGINT"))
    with pytest.raises(Exception, match="id 9 has no entry"):
        J.lookup_join(lost, table).agg(F.count(F.lit(1))).collect()
    assert J.lookup_join(lost, table, check_missing=False).count() == 3
