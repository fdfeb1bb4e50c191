import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.operators import metrics as M
from actlens.operators import scoring as S


def _frame(spark, x):
    return spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "sample_id BIGINT, pos INT, vec ARRAY<DOUBLE>")


def _dict(rng, f, d, experts=1):
    enc = rng.standard_normal((f, d))
    d_ = S.Dictionary(enc=enc, dec=rng.standard_normal((f, d)), pre_b=rng.standard_normal(d) * 0.1)
    if experts > 1:
        d_.router = rng.standard_normal((experts, d))
        d_.router_b = rng.standard_normal(d) * 0.1
        d_.n_experts = experts
    return d_


def test_topk_encode_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 16))
    d = _dict(rng, 40, 16)
    got = S.encode(_frame(spark, x), d, "topk", k=4).toPandas()
    pre = (x - d.pre_b) @ d.enc.T
    for i in range(50):
        top = np.argsort(-pre[i], kind="stable")[:4]
        g = got[got.sample_id == i].sort_values("value", ascending=False)
        assert list(g.feature) == list(top)
        assert np.allclose(g.value, pre[i, top])


def test_feature_slices_equal_single_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 8))
    d = _dict(rng, 64, 8)
    one = sorted(map(tuple, S.encode(_frame(spark, x), d, "topk", k=3).select("sample_id", "feature").collect()))
    monkeypatch.setattr(S, "MAX_BROADCAST_BYTES", 2000)   # forces ~8 feature slices
    sliced = sorted(map(tuple, S.encode(_frame(spark, x), d, "topk", k=3).select("sample_id", "feature").collect()))
    assert one == sliced


def test_decode_parity_with_dense_product(spark):
    # k 4, 64 features, 4 experts, d_in 32, batch 8
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8, 32))
    d = _dict(rng, 64, 32, experts=4)
    lat = S.encode(_frame(spark, x), d, "switch_topk", k=4, with_route=True)
    rec = S.decode(lat, d, key_cols=["sample_id", "pos"], scale_col="p_max").toPandas()
    dense = np.zeros((8, 64))
    pm = np.zeros(8)
    for r in lat.collect():
        dense[r.sample_id, r.feature] = r.value
        pm[r.sample_id] = r.p_max
    expect = pm[:, None] * (dense @ d.dec) + d.pre_b
    for r in rec.itertuples():
        assert abs(expect[r.sample_id, r.dim] - r.recon) < 1e-9


def test_reconstruct_equals_decode(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 8))
    d = _dict(rng, 16, 8)
    rows = S.reconstruct(_frame(spark, x), d, "relu").toPandas()
    lat = np.maximum((x - d.pre_b) @ d.enc.T, 0)
    expect = lat @ d.dec + d.pre_b
    for r in rows.itertuples():
        assert np.allclose(r.recon, expect[r.sample_id])
        assert r.l0 == int((lat[r.sample_id] > 0).sum())


def test_batch_topk_keeps_k_times_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 8))
    d = _dict(rng, 16, 8)
    df = _frame(spark, x).withColumn("batch_id", (F.col("sample_id") / 10).cast("long"))
    got = S.encode_batch_topk(df.repartition(3), d, 2).toPandas()
    pre = np.maximum((x - d.pre_b) @ d.enc.T, 0)
    for b in range(4):
        block = pre[b * 10:(b + 1) * 10].ravel()
        expect = np.sort(block[block > 0])[::-1][:20]
        assert np.allclose(np.sort(got[got.batch_id == b].value)[::-1], expect)


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 6))
    d = _dict(rng, 12, 6)
    df = _frame(spark, x).withColumn("batch_id", F.lit(0))
    rows = S.reconstruct(df, d, "topk", k=3, keep_cols=["batch_id"])
    m = M.batch_metrics(rows).first()
    pre = (x - d.pre_b) @ d.enc.T
    lat = np.zeros_like(pre)
    idx = np.argsort(-pre, axis=1, kind="stable")[:, :3]
    np.put_along_axis(lat, idx, np.take_along_axis(pre, idx, 1), 1)
    rec = lat @ d.dec + d.pre_b
    delta = x - rec
    assert abs(m.mse - (delta ** 2).mean()) < 1e-12
    assert abs(m.sum_mse - (delta ** 2).sum(1).mean()) < 1e-12
    vp = (delta ** 2 / np.sqrt((x ** 2).sum(-1, keepdims=True)) + 1e-9).mean()
    assert abs(m.variance_prop_mse - vp) < 1e-12
    ev = (1 - (delta ** 2).sum(-1) / ((x - x.mean(-1, keepdims=True)) ** 2).sum(-1)).mean()
    assert abs(m.explained_variance - ev) < 1e-12
    assert abs(m.input_std - x.std(ddof=1)) < 1e-9


def test_dictionary_checks():
    with pytest.raises(ValueError):
        S.Dictionary(enc=np.zeros((10, 4)), dec=np.zeros((10, 4)), pre_b=np.zeros(4), n_experts=3).check()


def test_feature_slices_fit_the_limit_at_common_dimensions(spark, monkeypatch):
    import numpy as np

    from actlens.operators import scoring as S
    rng = np.random.default_rng(0)
    for d_in in (64, 512, 1024):
        d = S.Dictionary(enc=rng.normal(size=(64, d_in)), dec=rng.normal(size=(64, d_in)), pre_b=rng.normal(size=d_in))
        rows = [(i, 0, rng.normal(size=d_in).tolist()) for i in range(6)]
        df = spark.createDataFrame(rows, "sample_id long, pos long, vec array<double>")
        plain = lambda out: sorted((*tuple(r)[:-1], round(r[-1], 9)) for r in out.collect())
        want = plain(S.encode(df, d, "topk", k=3))
        with monkeypatch.context() as m:
            m.setattr(S, "MAX_BROADCAST_BYTES", d.nbytes() // 2)
            assert plain(S.encode(df, d, "topk", k=3)) == want


def test_slices_of_every_kind_equal_the_whole(spark, monkeypatch):
    """d_in = 1024, small limits: feature slices, expert slices, sliced decode and batch top-k."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((23, 1024))
    df = spark.createDataFrame([(i, 0, i // 12, v.tolist()) for i, v in enumerate(x)],
                               "sample_id BIGINT, pos INT, batch_id BIGINT, vec ARRAY<DOUBLE>").repartition(3)
    w = rng.standard_normal((24, 1024)) / 32
    plain = S.Dictionary(enc=w, dec=w.copy(), pre_b=rng.standard_normal(1024) / 10)
    routed = S.Dictionary(enc=w, dec=w.copy(), pre_b=plain.pre_b, router=rng.standard_normal((6, 1024)) / 32,
                          router_b=np.zeros(1024), n_experts=6)

    def rows():
        lat = S.encode(df, plain, "topk", k=5)
        return {
            "relu": S.encode(df, plain, "relu"), "topk": lat, "batch": S.encode_batch_topk(df, plain, 4),
            "switch": S.encode(df, routed, "switch_topk", k=2, with_route=True), "decode": S.decode(lat, plain)}

    def read(frames):
        return {n: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in f.collect())
                for n, f in frames.items()}

    whole = read(rows())
    monkeypatch.setattr(S, "MAX_BROADCAST_BYTES", 180_000)
    monkeypatch.setattr(S, "DENSE_VALUES", 5_000)
    assert len(plain.slices()) > 2 and len(routed.slices(by_expert=True)) > 2
    assert all(p.nbytes() <= 180_000 for p in plain.slices() + routed.slices(by_expert=True))
    assert read(rows()) == whole


def test_batch_topk_cut_with_ties_and_few_positive_values(spark):
    """Copies on a third of the rows, a batch without positive values, more asked than there is."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((60, 6))
    x[::3] = x[0]
    x[40:50] = 0.0
    d = _dict(rng, 9, 6)
    d.pre_b[:] = 0
    df = _frame(spark, x).withColumn("batch_id", (F.col("sample_id") / 20).cast("long"))
    pre = np.maximum(x @ d.enc.T, 0)
    at = {(r["sample_id"], r["pos"]): i for i, r in enumerate(_frame(spark, x).collect())}
    for k in (1, 3, 50):
        got = S.encode_batch_topk(df.repartition(4), d, k).collect()
        for b in sorted({r["batch_id"] for r in df.collect()}):
            mine = [key for key, i in at.items() if key[0] // 20 == b]
            every = sorted((-pre[at[s], f], *s, f) for s in mine for f in range(9) if pre[at[s], f] > 0)
            want = [(s, p, f) for _, s, p, f in every[:k * len(mine)]]
            assert sorted((r["sample_id"], r["pos"], r["feature"]) for r in got if r["batch_id"] == b) == sorted(want)


def test_batch_topk_emits_little_more_than_it_keeps(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2000, 16))
    d = _dict(rng, 64, 16)
    df = _frame(spark, x).withColumn("batch_id", F.lit(5)).repartition(16)
    cut = S._batch_cuts(df, [S._broadcast(spark, d)], 4, "batch_id", "vec", 16).first()
    pre = np.maximum((x - d.pre_b) @ d.enc.T, 0)
    emitted = ((pre > 0) & (pre.view(np.int64) >> S.CUT_SHIFT >= cut["_cut"])).sum()
    assert 8000 <= emitted <= 8000 * 1.02 and S.encode_batch_topk(df, d, 4).count() == 8000
