"""Normalised input, lookup, auxiliary loss and table-held parameters of the fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.operators import fit as FT
from actlens.operators import fit_tables as TB
from actlens.sources import checkpoints as K
from tests.test_fit_geometry import _num_grad


def frame(spark, x, per_batch=20, tokens=None):
    rows = [(i // per_batch, v.tolist(), int(tokens[i]) if tokens is not None else 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "batch_id BIGINT, vec ARRAY<DOUBLE>, token_id BIGINT")


@pytest.mark.parametrize("arch", ["batch_topk", "topk_relu"])
def test_aux_gradients(arch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((10, 5))
    p = FT.DictionaryEstimator(arch, 8, k=2).init_params(5)
    p["b_enc"] = rng.standard_normal(8) * 0.1
    kw = {"dead": np.arange(8) % 3 == 0, "top_k_aux": 2, "aux_penalty": 0.7}
    loss = lambda q: FT.grads_fit2(q, x, arch, 2, 0.01, 10, **kw)[1]["loss_sum"]
    g, stats = FT.grads_fit2(p, x, arch, 2, 0.01, 10, **kw)
    assert stats["aux_sum"] > 0 and stats["loss_sum"] > FT.grads_fit2(p, x, arch, 2, 0.01, 10)[1]["loss_sum"]
    for name in ("enc", "dec", "b_dec", "b_enc"):
        assert np.allclose(g[name], _num_grad(loss, p, name), atol=1e-6), name


def test_lookup_gradients():
    rng = np.random.default_rng(2)
    x, tokens = rng.standard_normal((12, 5)), rng.integers(0, 4, 12)
    est = FT.DictionaryEstimator("lookup_switch_topk", 8, k=2, n_experts=2)
    p = {**est.init_params(5), "lookup": rng.standard_normal((4, 5))}
    plain = FT.DictionaryEstimator("switch_topk", 8, k=2, n_experts=2).init_params(5)
    assert np.allclose(p["dec"], 0.5 * plain["dec"])

    def run(q):
        model = {n: a for n, a in q.items() if n != "lookup"}
        return FT.grads_fit1(model, x, est.arch, 2, 0.0, 12, 0.5 * q["lookup"][tokens])
    g, stats = run(p)
    for name in g:
        assert np.allclose(g[name], _num_grad(lambda q: run(q)[1]["loss_sum"], p, name), atol=1e-6), name
    rows = np.zeros((4, 5))
    np.add.at(rows, tokens, 0.5 * stats["rows_grad"])
    assert np.allclose(rows, _num_grad(lambda q: run(q)[1]["loss_sum"], p, "lookup"), atol=1e-6)


@pytest.mark.parametrize("flush", [False, True])
def test_lookup_moves_only_the_batch_tokens(spark, monkeypatch, flush):
    if flush:
        monkeypatch.setattr(FT, "TOKEN_BYTES", 64)
    rng = np.random.default_rng(3)
    x, tokens = rng.standard_normal((40, 5)), np.where(rng.random(40) < 0.4, 1, rng.integers(0, 6, 40))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((9, 5)))][:5] + [(8, [1.0] * 5)],
                                  "token_id BIGINT, vec ARRAY<DOUBLE>")      # token 5 is in no row of the table
    est = FT.DictionaryEstimator("lookup_switch_topk", 8, k=2, n_experts=2, lr=0.05, n_tokens=40)
    res = est.fit(frame(spark, x, tokens=tokens).repartition(5), lookup=table)
    before = {r["token_id"]: np.array(r["vec"]) for r in table.collect()}
    after = {r["token_id"]: np.array(r["vec"]) for r in res.lookup.collect()}
    assert set(after) == set(before)
    assert {t for t in after if not np.array_equal(after[t], before[t])} == set(tokens.tolist()) & set(before)
    # the same two steps with one array
    p = est.init_params(5)
    m, v = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
    look = {t: [a, np.zeros(5), np.zeros(5)] for t, a in before.items()}
    for t, lo in enumerate((0, 20), 1):
        tok, xb = tokens[lo:lo + 20], x[lo:lo + 20]
        added = np.array([0.5 * look[i][0] if i in look else np.zeros(5) for i in tok])
        g, s = FT.grads_fit1(p, xb, est.arch, 2, 0.0, 20, added)
        for name in g:
            p[name], m[name], v[name] = FT.adam(p[name], m[name], v[name], g[name], t, est.lr, est.betas, est.eps)
        for i in set(tok.tolist()) & set(look):
            look[i] = list(FT.adam(*look[i], 0.5 * s["rows_grad"][tok == i].sum(axis=0), t, est.lr, est.betas, est.eps))
    assert all(np.allclose(after[i], look[i][0], atol=1e-10) for i in look)
    assert all(np.allclose(res.params[n], p[n], atol=1e-10) for n in p)
    with pytest.raises(ValueError):
        est.fit(frame(spark, x, tokens=tokens))


def test_moments_merge_to_those_of_the_batch(spark, monkeypatch):
    monkeypatch.setattr(FT, "ADD_FAN_IN", 3)
    x = np.random.default_rng(4).standard_normal((70, 6)) * 3 + 1e6
    mean, std = FT.batch_moments(frame(spark, x).repartition(11))
    assert np.allclose(mean, x.mean(axis=0), rtol=1e-12) and np.allclose(std, x.std(axis=0, ddof=1), rtol=1e-6)


@pytest.mark.parametrize("arch,option", [("topk", "batch_norm"), ("batch_topk", "input_unit_norm")])
def test_normalised_fit_equals_fit_on_normalised_rows(spark, arch, option):
    x = np.random.default_rng(5).standard_normal((40, 6)) * 2 + 1
    if option == "batch_norm":
        ready = np.concatenate([(b - b.mean(axis=0)) / (b.std(axis=0, ddof=1) + 1e-6) for b in (x[:20], x[20:])])
    else:
        ready = FT.unit_norm(x)[0]
    kw = {"k": 2, "lr": 0.01, "n_tokens": 40}
    a = FT.DictionaryEstimator(arch, 8, **{option: True}, **kw).fit(frame(spark, x))
    b = FT.DictionaryEstimator(arch, 8, **kw).fit(frame(spark, ready))
    assert len(a.history) == 2 and all(np.allclose(a.params[n], b.params[n], atol=1e-9) for n in a.params)
    with pytest.raises(ValueError):
        FT.DictionaryEstimator("topk", 8, k=2, batch_norm=True, input_unit_norm=True)


def test_unit_norm_is_undone():
    x = np.random.default_rng(6).standard_normal((9, 7)) * 4 + 2
    y, mean, std = FT.unit_norm(x)
    assert np.allclose(y * (std + 1e-5) + mean, x) and np.allclose(y.mean(axis=1), 0)


def aux_fit(spark, df, n_tokens, arch="batch_topk", **kw):
    # features 6 and 7 never win: their bias keeps them out, so they die after two batches
    est = FT.DictionaryEstimator(arch, 8, k=2, lr=0.01, n_tokens=n_tokens, aux_penalty=0.5, top_k_aux=2, dead_after=2)
    p = est.init_params(5)
    p["b_enc"] = np.array([0.5] * 6 + [-3.0, -0.4])
    return est.fit(df, init=kw.pop("init", p), **kw)


@pytest.mark.parametrize("arch", ["batch_topk", "topk_relu"])
def test_dead_features_get_the_auxiliary_loss(spark, tmp_path, arch):
    x = np.random.default_rng(7).standard_normal((100, 5))
    df = frame(spark, x)
    whole = aux_fit(spark, df, 100, arch)
    aux = [h["aux_loss"] for h in whole.history]
    assert aux[0] == 0 and aux[1] > 0 and whole.history[1]["dead_share"] > 0
    # a saved fit goes on as the unbroken one: the counters come back too
    half = aux_fit(spark, df, 40, arch)
    path = K.save_fit(spark, str(tmp_path), "aux", half)
    rest = aux_fit(spark, df, 100, arch, **K.load_fit(spark, path))
    assert rest.n_iter == 5 and np.array_equal(rest.state["idle"], whole.state["idle"])
    assert all(np.allclose(rest.params[n], whole.params[n], atol=1e-12) for n in whole.params)


def test_saved_lookup_fit_goes_on(spark, tmp_path):
    rng = np.random.default_rng(8)
    x, tokens = rng.standard_normal((40, 4)), rng.integers(0, 5, 40)
    df = frame(spark, x, 10, tokens)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((5, 4)))], "token_id BIGINT, vec ARRAY<DOUBLE>")
    kw = {"k": 2, "n_experts": 2, "lr": 0.02}
    whole = FT.DictionaryEstimator("lookup_switch_topk", 8, n_tokens=40, **kw).fit(df, lookup=table)
    half = FT.DictionaryEstimator("lookup_switch_topk", 8, n_tokens=20, **kw).fit(df, lookup=table)
    rest = FT.DictionaryEstimator("lookup_switch_topk", 8, n_tokens=40, **kw).fit(
        df, **K.load_fit(spark, K.save_fit(spark, str(tmp_path), "look", half)))
    want = {r["token_id"]: r["vec"] for r in whole.lookup.collect()}
    assert all(np.allclose(r["vec"], want[r["token_id"]], atol=1e-12) for r in rest.lookup.collect())
    assert all(np.allclose(rest.params[n], whole.params[n], atol=1e-12) for n in whole.params)


TABLE_CASES = [("topk", {"batch_norm": True}), ("batch_topk", {"aux_penalty": 0.5, "top_k_aux": 2, "dead_after": 1}),
               ("jumprelu", {"init_threshold": 0.3, "bandwidth": 0.2}), ("lookup_switch_topk", {"n_experts": 2})]


@pytest.mark.parametrize("arch,options", TABLE_CASES)
def test_table_fit_equals_held_fit(spark, monkeypatch, arch, options):
    """Blocks of three rows, several slices; the driver never sees the parameters."""
    monkeypatch.setattr(FT, "BLOCK_BYTES", 120)
    rng = np.random.default_rng(9)
    x, tokens = rng.standard_normal((60, 5)), rng.integers(0, 6, 60)
    df = frame(spark, x, tokens=tokens).repartition(3)
    kw = {"k": 2, "lr": 0.01, "l1_coefficient": 0.01, "n_tokens": 60, **options}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((6, 5)))], "token_id BIGINT, vec ARRAY<DOUBLE>")
    more = {"lookup": table} if arch == "lookup_switch_topk" else {}
    held = FT.DictionaryEstimator(arch, 8, **kw)
    want = held.fit(df, **more)
    est = TB.TableEstimator(arch, 8, slices=3, **kw)
    got = est.fit(df, init=TB.state_table(spark, held.init_params(5)), **more)
    assert got.state.where("param = 'dec'").count() == 3 and got.n_iter == 3
    assert [round(h["loss"], 9) for h in got.history] == [round(h["loss"], 9) for h in want.history]
    assert all(np.allclose(got.arrays()[n], want.params[n], atol=1e-10) for n in want.params)
    assert all(np.allclose(got.arrays("v")[n], want.state["v"][n], atol=1e-12) for n in want.params)
    assert np.array_equal(got.idle, want.state["idle"])
    if more:
        vec = {r["token_id"]: r["vec"] for r in want.lookup.collect()}
        assert all(np.allclose(r["vec"], vec[r["token_id"]], atol=1e-10) for r in got.lookup.collect())
    # a stopped fit goes on from its table
    part = TB.TableEstimator(arch, 8, slices=2, **{**kw, "n_tokens": 20}).fit(df, init=TB.state_table(spark, held.init_params(5)), **more)
    rest = est.fit(df, resume=part)
    assert rest.n_iter == 3 and all(np.allclose(rest.arrays()[n], want.params[n], atol=1e-10) for n in want.params)


@pytest.mark.parametrize("arch", ["topk", "vanilla", "lookup_switch_topk"])
def test_fresh_state_is_drawn_in_tasks(spark, monkeypatch, arch):
    monkeypatch.setattr(FT, "BLOCK_BYTES", 200)
    est = TB.TableEstimator(arch, 12, k=2, n_experts=3)
    state = TB.TableFit(TB.initial_state(spark, est, 6)).arrays()
    shapes = {n: a.shape for n, a in est.init_params(6).items()}
    assert {n: a.shape for n, a in state.items()} == shapes
    again = TB.TableFit(TB.initial_state(spark, est, 6)).arrays()
    assert all(np.array_equal(state[n], again[n]) for n in state)
    scale = 0.5 if arch == "lookup_switch_topk" else 1.0
    assert np.allclose(state["dec"], scale * state["enc"]) and len(np.unique(state["enc"].round(9))) == 72


def test_state_rows_name_every_value(spark, monkeypatch):
    monkeypatch.setattr(FT, "BLOCK_BYTES", 100)
    p = FT.DictionaryEstimator("vanilla", 7).init_params(3)
    rows = TB.parameter_rows(TB.state_table(spark, p)).collect()
    assert len(rows) == sum(a.size for a in p.values())
    assert all(r["value"] == np.atleast_2d(p[r["param"]])[r["row"], r["dim"]] for r in rows)
