import numpy as np
import pytest

from actlens.operators import fit as FT


def _num_grad(f, p, name, eps=1e-6):
    g = np.zeros_like(p[name])
    it = np.nditer(p[name], flags=["multi_index"])
    for _ in it:
        i = it.multi_index
        old = p[name][i]
        p[name][i] = old + eps
        hi = f(p)
        p[name][i] = old - eps
        lo = f(p)
        p[name][i] = old
        g[i] = (hi - lo) / (2 * eps)
    return g


@pytest.mark.parametrize("arch,k", [("relu", None), ("topk", 3), ("switch_topk", 2)])
def test_fit1_gradients(arch, k):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((12, 5))
    est = FT.DictionaryEstimator(arch, 8, k=k, n_experts=2 if arch == "switch_topk" else None)
    p = est.init_params(5)
    loss = lambda q: FT.grads_fit1(q, x, arch, k, 0.01, 12)[1]["loss_sum"]
    g, _ = FT.grads_fit1(p, x, arch, k, 0.01, 12)
    for name in g:
        assert np.allclose(g[name], _num_grad(loss, p, name), atol=1e-6), name


@pytest.mark.parametrize("arch,k", [("vanilla", None), ("topk_relu", 3), ("batch_topk", 3)])
def test_fit2_gradients(arch, k):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((10, 5))
    est = FT.DictionaryEstimator(arch, 8, k=k)
    p = est.init_params(5)
    p["b_enc"] = rng.standard_normal(8) * 0.1
    loss = lambda q: FT.grads_fit2(q, x, arch, k, 0.01, 10)[1]["loss_sum"]
    g, _ = FT.grads_fit2(p, x, arch, k, 0.01, 10)
    for name in ("enc", "dec", "b_dec", "b_enc"):
        assert np.allclose(g[name], _num_grad(loss, p, name), atol=1e-6), name


@pytest.mark.parametrize("pre_enc_bias", [False, True])
def test_jumprelu_gradients(pre_enc_bias):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 5))
    p = FT.DictionaryEstimator("jumprelu", 8).init_params(5)
    assert np.all(p["log_threshold"] == 0)
    p["b_enc"], p["b_dec"] = rng.standard_normal(8) * 0.1, rng.standard_normal(5) * 0.1
    p["log_threshold"] = np.log(rng.uniform(0.2, 0.6, 8))
    kw = {"bandwidth": 0.3, "pre_enc_bias": pre_enc_bias}
    loss = lambda q: FT.grads_fit2(q, x, "jumprelu", None, 0.01, 30, **kw)[1]["loss_sum"]
    g, _ = FT.grads_fit2(p, x, "jumprelu", None, 0.01, 30, **kw)
    for name in ("enc", "dec", "b_dec", "b_enc"):
        assert np.allclose(g[name], _num_grad(loss, p, name), atol=1e-6), name
    # thresholds: value by value from the definition of the pseudo-gradient
    want = np.zeros(8)
    for v in x:
        r = np.maximum(p["enc"] @ (v - p["b_dec"] if pre_enc_bias else v) + p["b_enc"], 0)
        th = np.exp(p["log_threshold"])
        a = np.where(r > th, r, 0)
        da = p["dec"] @ (2 * (a @ p["dec"] + p["b_dec"] - v) / (30 * 5))
        for j in range(8):
            if abs(r[j] - th[j]) < 0.15:
                want[j] -= th[j] / 0.3 * da[j]
            if abs(a[j] - th[j]) < 0.15:
                want[j] -= 0.01 / 0.3 / 30
    assert np.allclose(g["log_threshold"], want, atol=1e-12)


@pytest.mark.parametrize("arch", ["batch_topk", "jumprelu", "topk"])
def test_distributed_sums_equal_one_call(spark, arch, monkeypatch):
    """Small blocks, more tasks than one round adds, empty tasks."""
    monkeypatch.setattr(FT, "BLOCK_BYTES", 100)
    monkeypatch.setattr(FT, "ADD_FAN_IN", 3)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 5))
    est = FT.DictionaryEstimator(arch, 8, k=3, init_threshold=0.3, bandwidth=0.2)
    p = est.init_params(5)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec ARRAY<DOUBLE>").repartition(11)
    g, st, _ = est._step_sums(df.where("vec[0] > -9"), p, "vec", 60)
    want, ws = (FT.grads_fit1(p, x, arch, 3, 0.0, 60) if arch == "topk" else
                FT.grads_fit2(p, x, arch, 3, 0.0, 60, bandwidth=0.2))
    assert all(np.allclose(g[name], want[name], atol=1e-12) for name in want)
    assert abs(st["loss_sum"] - ws["loss_sum"]) < 1e-12 and st["rows"] == 60


def test_batch_cut_is_the_kth_largest(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((50, 4)), 1)
    p = {"enc": np.eye(4), "dec": np.eye(4), "b_dec": np.zeros(4), "b_enc": np.zeros(4)}
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec ARRAY<DOUBLE>").repartition(5)
    acts = np.sort(np.maximum(x, 0).ravel())[::-1]
    bc = spark.sparkContext.broadcast(p)
    for keep in (1, 7, 60, 199, 1000):
        assert FT.batch_cut(df, p, keep) == (acts[keep - 1] if keep <= acts.size else 0.0)


def test_decoder_keeps_unit_directions(spark):
    """The gradient along a decoder row is removed before the step."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(0, v.tolist()) for v in rng.standard_normal((40, 5))], "batch_id BIGINT, vec ARRAY<DOUBLE>")
    est = FT.DictionaryEstimator("vanilla", 8, lr=1e-3)
    start = est.init_params(5)["dec"]
    res = est.fit(df)
    assert np.abs((res.state["m"]["dec"] * start).sum(axis=1)).max() < 1e-12


def test_unknown_architecture():
    with pytest.raises(ValueError):
        FT.DictionaryEstimator("mystery", 8)
    with pytest.raises(ValueError):
        FT.DictionaryEstimator("switch_topk", 10, k=2, n_experts=3)


def test_fit_reduces_loss_and_resumes(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6))
    df = spark.createDataFrame([(int(i // 50), v.tolist()) for i, v in enumerate(x)], "batch_id BIGINT, vec ARRAY<DOUBLE>")
    est = FT.DictionaryEstimator("topk", 12, k=3, lr=0.01, n_tokens=400)
    res = est.fit(df.repartition(3))
    assert len(res.history) == 8 and res.token_count == 400
    assert res.history[-1]["mse"] < res.history[0]["mse"]
    # resume after 4 batches with the saved params and optimiser state
    part = FT.DictionaryEstimator("topk", 12, k=3, lr=0.01, n_tokens=200).fit(df)
    rest = FT.DictionaryEstimator("topk", 12, k=3, lr=0.01, n_tokens=400).fit(
        df, init=part.params, start_token=200, state=part.state)
    assert np.allclose(rest.params["enc"], res.params["enc"], atol=1e-10)


@pytest.mark.parametrize("arch", ["vanilla", "switch_topk"])
def test_saved_fit_continues_as_unbroken(spark, tmp_path, arch):
    from actlens.sources import checkpoints as K
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i // 20, v.tolist()) for i, v in enumerate(rng.standard_normal((80, 4)))],
                               "batch_id BIGINT, vec ARRAY<DOUBLE>")
    kw = {"k": 2, "n_experts": 2, "lr": 0.01}
    whole = FT.DictionaryEstimator(arch, 8, n_tokens=80, **kw).fit(df)
    half = FT.DictionaryEstimator(arch, 8, n_tokens=40, **kw).fit(df)
    path = K.save_fit(spark, str(tmp_path), "run", half, dead_latents=[3])
    rest = FT.DictionaryEstimator(arch, 8, n_tokens=80, **kw).fit(df, **K.load_fit(spark, path))
    assert rest.n_iter == whole.n_iter == 4
    assert all(np.allclose(rest.params[n], whole.params[n], atol=1e-12) for n in whole.params)


def test_geometric_median_matches_numpy(spark):
    from actlens.operators.geometry import geometric_median
    rng = np.random.default_rng(3)
    pts = rng.standard_normal((200, 4)) + np.array([5, 0, 0, 0])
    df = spark.createDataFrame([(v.tolist(),) for v in pts], "vec ARRAY<DOUBLE>")
    got = geometric_median(df.repartition(4), "vec", maxiter=50)
    m = pts.mean(0)
    obj = np.linalg.norm(pts - m, axis=1).mean()
    for _ in range(50):
        w = 1 / np.maximum(np.linalg.norm(pts - m, axis=1), 1e-6)
        m_new = (w[:, None] * pts).sum(0) / w.sum()
        obj_new = np.linalg.norm(pts - m_new, axis=1).mean()
        m = m_new
        if abs(obj - obj_new) <= 1e-20 * obj_new:
            break
        obj = obj_new
    assert np.allclose(got, m, atol=1e-9)
