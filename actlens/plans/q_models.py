"""Queries of dictionary scoring, sparse products and reconstruction metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from actlens.functions import columns as FN
from actlens.operators import joins as J
from actlens.operators import metrics as M
from actlens.operators import scoring as S
from actlens.operators import tiles as TI
from actlens.operators import windows as W
from actlens.plans import canonical as C
from actlens.plans.registry import query
from actlens.sources.tables import read_table

ACT = C.ACT_SQL
ALONG = C.ACT_LONG_SQL
KEYS = C.LATENT_KEYS
AX = f"SELECT vec_id, sample_id, pos, batch_id, label, vec::DOUBLE[] AS x FROM ({ACT})"
DICT = C.dict_sql()
DICT_LONG = ("SELECT CAST(e.vec_id AS INTEGER) AS feature, CAST(u.i - 1 AS INTEGER) AS dim, "
             "CAST(e.embedding[u.i] AS DOUBLE) AS w FROM embeddings e, "
             "LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) u WHERE e.vec_id < 32")
CENTRED = "list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] - mu.mu[i])"
BIAS = "(-0.01 * (d.feature % 3))"


def r6(c):
    return F.round(c, 6)


def _lat_out(df, extra=()):
    return df.select("vec_id", "feature", r6("value").alias("value"), *extra)


@query("mod1_encode_relu", f"""
SELECT vec_id, feature, round(v, 6) AS value FROM (
 SELECT a.vec_id, d.feature, list_dot_product({CENTRED}, d.w) AS v FROM ({AX}) a, ({C.MEAN_SQL}) mu, ({DICT}) d)
WHERE v > 0
""")
def mod1(spark, sf):
    d = C.dictionary(spark, sf, pre_b="mean")
    return _lat_out(S.encode(C.activations(spark, sf), d, "relu", key_cols=KEYS))


@query("mod2_encode_topk", f"SELECT vec_id, feature, round(value, 6) AS value FROM ({C.latents_sql()})")
def mod2(spark, sf):
    return _lat_out(C.latents(spark, sf))


_ROUTE_SQL = f"""
z AS (SELECT a.vec_id, r.expert, list_dot_product(a.x, r.r) AS z FROM ({AX}) a, ({C.ROUTER_SQL}) r),
e AS (SELECT vec_id, expert, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
q AS (SELECT vec_id, expert, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
w AS (SELECT vec_id, expert, p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS rn
      FROM q) WHERE rn = 1)"""


@query("mod3_encode_switch", f"""
WITH {_ROUTE_SQL}
SELECT w.vec_id, w.expert, f.feature, round(list_dot_product(a.x, f.w), 6) AS value, round(w.p, 6) AS p_max
FROM w JOIN ({AX}) a USING (vec_id) JOIN ({C.EXPERT_FEATURES_SQL}) f ON f.expert = w.expert
WHERE list_dot_product(a.x, f.w) > 0
""")
def mod3(spark, sf):
    d, _ = C.expert_tables(spark, sf)
    lat = S.encode(C.activations(spark, sf), d, "switch", key_cols=KEYS, with_route=True)
    return lat.select("vec_id", "expert", "feature", r6("value").alias("value"), r6("p_max").alias("p_max"))


@query("mod4_encode_switch_topk", f"""
WITH {_ROUTE_SQL},
s AS (SELECT w.vec_id, w.expert, f.feature, list_dot_product(a.x, f.w) AS v, w.p
      FROM w JOIN ({AX}) a USING (vec_id) JOIN ({C.EXPERT_FEATURES_SQL}) f ON f.expert = w.expert)
SELECT vec_id, expert, feature, round(v, 6) AS value, round(p, 6) AS p_max FROM (
 SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, feature) AS rk FROM s) WHERE rk <= 2
""")
def mod4(spark, sf):
    d, _ = C.expert_tables(spark, sf)
    lat = S.encode(C.activations(spark, sf), d, "switch_topk", k=2, key_cols=KEYS, with_route=True)
    return lat.select("vec_id", "expert", "feature", r6("value").alias("value"), r6("p_max").alias("p_max"))


@query("mod5_encode_batch_topk", f"""
WITH s AS (SELECT a.vec_id, a.batch_id, d.feature, list_dot_product(a.x, d.w) AS v FROM ({AX}) a, ({DICT}) d),
n AS (SELECT batch_id, count(*) AS bn FROM ({ACT}) GROUP BY batch_id),
r AS (SELECT s.*, n.bn, row_number() OVER (PARTITION BY s.batch_id ORDER BY v DESC, vec_id, feature) AS rk
      FROM s JOIN n USING (batch_id) WHERE v > 0)
SELECT vec_id, batch_id, feature, round(v, 6) AS value FROM r WHERE rk <= 4 * bn
""")
def mod5(spark, sf):
    d = C.dictionary(spark, sf)
    lat = S.encode_batch_topk(C.activations(spark, sf), d, 4, key_cols=("vec_id", "sample_id", "pos"))
    return lat.select("vec_id", "batch_id", "feature", r6("value").alias("value"))


@query("mod6_encode_topk_relu", f"""
SELECT vec_id, feature, round(v, 6) AS value FROM (
 SELECT a.vec_id, d.feature, greatest(list_dot_product({CENTRED}, d.w), 0) AS v,
        row_number() OVER (PARTITION BY a.vec_id ORDER BY greatest(list_dot_product({CENTRED}, d.w), 0) DESC, d.feature) AS rk
 FROM ({AX}) a, ({C.MEAN_SQL}) mu, ({DICT}) d) WHERE rk <= 4 AND v > 0
""")
def mod6(spark, sf):
    d = C.dictionary(spark, sf, pre_b="mean")
    return _lat_out(S.encode(C.activations(spark, sf), d, "topk_relu", k=4, key_cols=KEYS))


@query("mod7_encode_vanilla", f"""
SELECT vec_id, feature, round(v, 6) AS value FROM (
 SELECT a.vec_id, d.feature, list_dot_product({CENTRED}, d.w) + {BIAS} AS v FROM ({AX}) a, ({C.MEAN_SQL}) mu, ({DICT}) d)
WHERE v > 0
""")
def mod7(spark, sf):
    d = C.dictionary(spark, sf, pre_b="mean", with_bias=True)
    return _lat_out(S.encode(C.activations(spark, sf), d, "vanilla", key_cols=KEYS))


@query("mod8_encode_jumprelu", f"""
SELECT vec_id, feature, round(v, 6) AS value FROM (
 SELECT a.vec_id, d.feature, list_dot_product(a.x, d.w) + {BIAS} AS v FROM ({AX}) a, ({DICT}) d)
WHERE v > 0 AND v > exp(ln(0.05 + 0.01 * (feature % 5)))
""")
def mod8(spark, sf):
    d = C.dictionary(spark, sf, with_bias=True, with_threshold=True)
    return _lat_out(S.encode(C.activations(spark, sf), d, "jumprelu", key_cols=KEYS))


RECON_SQL = (f"SELECT l.vec_id, d.dim, sum(l.value * d.w) AS recon FROM ({C.latents_sql()}) l "
             f"JOIN ({DICT_LONG}) d USING (feature) GROUP BY l.vec_id, d.dim")


@query("mod9_decode", f"SELECT vec_id, dim, round(recon, 6) AS recon FROM ({RECON_SQL})")
def mod9(spark, sf):
    d = C.dictionary(spark, sf)
    rec = S.decode(C.latents(spark, sf), d, key_cols=["vec_id"])
    return rec.select("vec_id", "dim", r6("recon").alias("recon"))


@query("mod10_active_features", f"""
SELECT batch_id, expert, feature, round(max(value), 6) AS max_value, max(value) > 1e-3 AS active
FROM ({C.latents_sql()}) GROUP BY batch_id, expert, feature
""")
def mod10(spark, sf):
    a = S.active_features(C.latents(spark, sf))
    return a.select("batch_id", "expert", "feature", r6("max_value").alias("max_value"), "active")


_SHARE_SQL = f"""
WITH z AS (SELECT a.vec_id, r.expert, list_dot_product(a.x, r.r) AS z FROM ({AX}) a, ({C.ROUTER_SQL}) r),
e AS (SELECT vec_id, expert, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
q AS (SELECT vec_id, expert, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT vec_id, expert, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) = 1 AS chosen FROM q),
s AS (SELECT expert, avg(CAST(chosen AS DOUBLE)) AS share, avg(p) AS weighting FROM c GROUP BY expert)"""


def _expert_share(spark, sf):
    d, n_exp = C.expert_tables(spark, sf)
    routes = S.route(C.activations(spark, sf), d, key_cols=["vec_id"])
    share = routes.groupBy("expert").agg(F.avg(F.col("chosen").cast("double")).alias("share"),
                                         F.avg("p").alias("weighting"))
    return share, n_exp


@query("mod11_expert_share", f"{_SHARE_SQL} SELECT expert, round(share, 6) AS share, round(weighting, 6) AS weighting FROM s")
def mod11(spark, sf):
    share, _ = _expert_share(spark, sf)
    return share.select("expert", r6("share").alias("share"), r6("weighting").alias("weighting"))


@query("met6_expert_privilege", f"""
{_SHARE_SQL} SELECT round((SELECT count(DISTINCT label) FROM embeddings) * sum(weighting * share), 6) AS expert_privilege FROM s
""")
def met6(spark, sf):
    share, n_exp = _expert_share(spark, sf)
    return M.expert_privilege(share, n_exp).select(r6("expert_privilege").alias("expert_privilege"))


@query("fn6_fn7_softmax_argmax", f"""
WITH {_ROUTE_SQL} SELECT vec_id, expert, round(p, 6) AS p_max FROM w
""")
def fn6_fn7(spark, sf):
    d, n_exp = C.expert_tables(spark, sf)
    e = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    logits = F.array(*[FN.dot("x", F.array(*[F.lit(float(v)) for v in d.router[j]])) for j in range(n_exp)])
    sm = e.select("vec_id", FN.softmax(logits).alias("p"))
    am = sm.select("vec_id", FN.argmax("p").alias("expert"), F.array_max("p").alias("p_max"))
    return am.select("vec_id", "expert", r6("p_max").alias("p_max"))


@query("mod12_feature_extraction", f"""
SELECT vec_id, feature, round(value, 6) AS value, {C.PATH_SQL} AS path FROM ({C.latents_sql()})
""")
def mod12(spark, sf):
    """Encode, score, write in parts, read every part back."""
    import uuid

    from actlens.operators.encoder import at_location, encode_locations
    from actlens.session import checkpoint_dir
    from actlens.sources.sinks import extract_features

    def encode(batch, locations):
        x = np.stack(batch.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
        return {(layer, module): C.at_layer(x, layer) for layer, module in locations}

    rows = C.activations(spark, sf).withColumns({"path": C.image_path(F.col("vec_id")), "part": F.expr("batch_id div 2")})
    vectors = at_location(encode_locations(rows, encode, [(0, "resid")], key_cols=["vec_id", "path", "part"]), (0, "resid"))
    out = f"{checkpoint_dir(spark).rstrip('/')}/actlens-stage/latents-{uuid.uuid4().hex[:12]}"
    lat = extract_features(vectors, C.dictionary(spark, sf), "topk", k=C.TOPK, key_cols=["vec_id", "path", "part"],
                           out_path=out, part_col="part")
    return lat.select("vec_id", "feature", r6("value").alias("value"), "path")


@query("mod13_contrastive_loss", """
WITH e AS (SELECT vec_id, vec_id // 100 AS batch_id, embedding::DOUBLE[] AS a FROM embeddings),
p AS (SELECT e.vec_id, e.batch_id, e.a, f.a AS b FROM e JOIN e f ON f.vec_id = xor(e.vec_id, 1)),
z AS (SELECT i.batch_id, i.vec_id AS i, j.vec_id AS j, list_dot_product(i.a, j.b) AS z FROM p i JOIN p j USING (batch_id)),
rm AS (SELECT batch_id, i, max(z) AS mx FROM z GROUP BY 1, 2),
rc AS (SELECT z.batch_id, z.i, any_value(rm.mx) + ln(sum(exp(z.z - rm.mx))) - max(CASE WHEN z.i = z.j THEN z.z END) AS ce
       FROM z JOIN rm USING (batch_id, i) GROUP BY z.batch_id, z.i),
cm AS (SELECT batch_id, j, max(z) AS mx FROM z GROUP BY 1, 2),
cc AS (SELECT z.batch_id, z.j, any_value(cm.mx) + ln(sum(exp(z.z - cm.mx))) - max(CASE WHEN z.i = z.j THEN z.z END) AS ce
       FROM z JOIN cm USING (batch_id, j) GROUP BY z.batch_id, z.j),
ra AS (SELECT batch_id, avg(ce) AS r, count(*) AS n FROM rc GROUP BY 1),
ca AS (SELECT batch_id, avg(ce) AS c FROM cc GROUP BY 1)
SELECT batch_id, round((r + c) / 2, 6) AS loss, n FROM ra JOIN ca USING (batch_id)
""")
def mod13(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    a = e.select("vec_id", F.expr("vec_id div 100").alias("batch_id"), F.col("embedding").alias("a"))
    b = e.select(F.col("vec_id").bitwiseXOR(F.lit(1)).alias("vec_id"), F.col("embedding").alias("b"))
    pairs = a.join(b, on="vec_id", how="inner")
    loss = S.contrastive_loss(pairs, group_col="batch_id", a_col="a", b_col="b")
    return loss.select("batch_id", r6("loss").alias("loss"), "n")


# ---------------------------------------------------------------- column functions

@query("fn8_relu", f"""
SELECT vec_id, count(*) FILTER (WHERE greatest(x, 0) > 0) AS n_active, round(sum(greatest(x, 0)), 6) AS relu_sum
FROM ({ALONG}) GROUP BY vec_id
""")
def fn8(spark, sf):
    e = read_table(spark, sf, "embeddings")
    r = F.transform("embedding", lambda x: FN.relu(x.cast("double")))
    x = e.select("vec_id", r.alias("r"))
    return x.select("vec_id", F.size(F.filter("r", lambda v: v > 0)).cast("bigint").alias("n_active"),
                    r6(F.aggregate("r", F.lit(0.0), lambda a, v: a + v)).alias("relu_sum"))


@query("fn9_jump_relu", f"""
SELECT vec_id, count(*) FILTER (WHERE greatest(x, 0) > exp(ln(0.05 + 0.01 * (dim % 5)))) AS n_active,
       round(sum(CASE WHEN greatest(x, 0) > exp(ln(0.05 + 0.01 * (dim % 5))) THEN greatest(x, 0) ELSE 0 END), 6) AS jump_sum
FROM ({ALONG}) GROUP BY vec_id
""")
def fn9(spark, sf):
    e = read_table(spark, sf, "embeddings")
    thr = lambda i: F.log(F.lit(0.05) + F.lit(0.01) * (i % 5))
    j = F.transform("embedding", lambda x, i: FN.jump_relu(x.cast("double"), thr(i)))
    s = F.transform("embedding", lambda x, i: FN.jump_step(x.cast("double"), thr(i)))
    x = e.select("vec_id", j.alias("j"), s.alias("s"))
    return x.select("vec_id", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("n_active"),
                    r6(F.aggregate("j", F.lit(0.0), lambda a, v: a + v)).alias("jump_sum"))


@query("fn10_sparse_topk", f"""
SELECT vec_id, CAST(rank AS BIGINT) AS rank, dim AS idx, round(x, 6) AS value FROM (
 SELECT vec_id, dim, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS rank FROM ({ALONG})) WHERE rank <= 3
""")
def fn10(spark, sf):
    e = read_table(spark, sf, "embeddings")
    t = e.select("vec_id", F.posexplode(FN.sparse_topk("embedding", 3)).alias("r", "s"))
    return t.select("vec_id", (F.col("r") + 1).cast("bigint").alias("rank"), F.col("s.index").alias("idx"),
                    r6("s.value").alias("value"))


# ---------------------------------------------------------------- joins

@query("joi1_lookup_join", f"""
SELECT t.doc_id, count(*) AS n_tokens, round(sum(v.vec[1]), 6) AS sum_x0
FROM ({C.TOKEN_IDS_SQL}) t JOIN ({C.TOKEN_VEC_SQL}) v USING (token_id) GROUP BY t.doc_id
""")
def joi1(spark, sf):
    toks = C.token_ids(spark, sf).select("doc_id", "pos", "token_id")
    j = J.lookup_join(toks, C.token_vectors(spark, sf), "token_id")
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), r6(F.sum(F.col("vec")[0])).alias("sum_x0"))


@query("joi2_lookup_augment", f"""
WITH rc AS (SELECT l.vec_id, d.dim, sum(l.value * d.w * 0.5) AS recon FROM ({C.latents_sql()}) l
            JOIN ({DICT_LONG}) d USING (feature) GROUP BY l.vec_id, d.dim),
tok AS (SELECT vec_id AS token_id, CAST(u.i - 1 AS INTEGER) AS dim, CAST(e.embedding[u.i] AS DOUBLE) AS t
        FROM embeddings e, LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) u)
SELECT rc.vec_id, rc.dim, round(CASE WHEN rc.vec_id % 2 = 0 THEN rc.recon + 0.5 * tok.t ELSE rc.recon END, 6) AS recon
FROM rc LEFT JOIN tok ON tok.token_id = rc.vec_id % 50 AND tok.dim = rc.dim
""")
def joi2(spark, sf):
    d = C.dictionary(spark, sf)
    d.dec = d.dec * (1 - 0.5)
    rows = S.reconstruct(C.activations(spark, sf), d, "topk", k=C.TOPK, key_cols=["vec_id"]).select("vec_id", "recon")
    rows = rows.withColumn("token_id", F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 50))
    table = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("token_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    out = J.lookup_augment(rows, table, scale=0.5)
    return out.select("vec_id", F.posexplode("recon").alias("dim", "recon")) \
              .select("vec_id", "dim", r6("recon").alias("recon"))


@query("joi7_sparse_dense_matmul", f"""
SELECT l.vec_id, d.dim, round(sum(l.value * d.w), 6) AS out FROM ({C.latents_sql()}) l
JOIN ({DICT_LONG}) d USING (feature) WHERE l.value <> 0 GROUP BY l.vec_id, d.dim
""")
def joi7(spark, sf):
    lat = C.latents(spark, sf).select(F.col("vec_id").alias("a"), F.col("feature").alias("index"), "value")
    e = read_table(spark, sf, "embeddings").where(F.col("vec_id") < C.N_FEATURES)
    out = TI.sparse_dense_product(lat, e.select(F.col("vec_id").alias("row"), F.col("embedding").alias("vec")))
    return out.select(F.col("row").alias("vec_id"), F.posexplode("out").alias("dim", "out")) \
              .select("vec_id", "dim", r6("out").alias("out"))


@query("joi8_sparse_t_dense_matmul", f"""
WITH s AS (SELECT l.feature, a.dim, sum(l.value * a.x) AS out FROM ({C.latents_sql()}) l
           JOIN ({ALONG}) a USING (vec_id) GROUP BY l.feature, a.dim),
g AS (SELECT CAST(f AS INTEGER) AS feature, dim FROM range(0, 32) t(f), (SELECT DISTINCT dim FROM ({ALONG})))
SELECT g.feature, g.dim, round(coalesce(s.out, 0), 6) AS out FROM g LEFT JOIN s USING (feature, dim)
""")
def joi8(spark, sf):
    lat = C.latents(spark, sf).select(F.col("vec_id").alias("a"), F.col("feature").alias("index"), "value")
    dense = C.activations(spark, sf).select(F.col("vec_id").alias("row"), "vec")
    out = TI.sparse_t_dense_product(lat, dense, C.N_FEATURES)
    return out.select(F.col("row").cast("int").alias("feature"), F.posexplode("out").alias("dim", "out")) \
              .select("feature", "dim", r6("out").alias("out"))


@query("joi9_sampled_matmul", f"""
SELECT l.vec_id AS i, l.feature AS j, round(list_dot_product(a.x, d.w), 6) AS value
FROM ({C.latents_sql()}) l JOIN ({AX}) a USING (vec_id) JOIN ({DICT}) d USING (feature)
""")
def joi9(spark, sf):
    at = C.latents(spark, sf).select(F.col("vec_id").alias("i"), F.col("feature").alias("j"))
    e = read_table(spark, sf, "embeddings")
    left = e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("vec"))
    right = e.where(F.col("vec_id") < C.N_FEATURES).select(F.col("vec_id").cast("int").alias("j"),
                                                          F.col("embedding").alias("vec"))
    out = TI.sampled_product(left, right, at)
    return out.select("i", F.col("j").cast("int").alias("j"), r6("value").alias("value"))


# ---------------------------------------------------------------- metrics

_DELTA = f"""
rc AS ({RECON_SQL}),
j AS (SELECT l.batch_id, l.vec_id, l.pos, l.dim, l.x, rc.recon, l.x - rc.recon AS d FROM ({ALONG}) l JOIN rc USING (vec_id, dim)),
rw AS (SELECT batch_id, vec_id, pos, sum(d * d) AS se, count(*) AS n, sqrt(sum(x * x)) AS norm, avg(x) AS mx
       FROM j GROUP BY batch_id, vec_id, pos),
rv AS (SELECT j.vec_id, sum((j.x - rw.mx) * (j.x - rw.mx)) AS var_row FROM j JOIN rw USING (vec_id) GROUP BY j.vec_id),
lt AS (SELECT vec_id, count(*) FILTER (WHERE value > 0) AS l0, sum(abs(value)) AS l1 FROM ({C.latents_sql()}) GROUP BY vec_id),
bm AS (SELECT rw.batch_id, avg(se / n) AS mse, avg(se) AS sum_mse, avg(se / norm / n + 1e-9) AS variance_prop_mse,
       avg(1 - se / var_row) AS explained_variance, avg(coalesce(l0, 0)) AS l0, avg(coalesce(l1, 0)) AS l1
       FROM rw JOIN rv USING (vec_id) LEFT JOIN lt USING (vec_id) GROUP BY rw.batch_id),
im AS (SELECT batch_id, avg(x) AS input_mean, stddev_samp(x) AS input_std FROM ({ALONG}) GROUP BY batch_id)"""


def _rows(spark, sf, arch="topk", k=C.TOPK, d=None):
    d = d or C.dictionary(spark, sf)
    return S.reconstruct(C.activations(spark, sf), d, arch, k=k, key_cols=KEYS)


@query("met1_mse", f"WITH {_DELTA} SELECT batch_id, round(mse, 6) AS mse, round(sum_mse, 6) AS sum_mse FROM bm")
def met1(spark, sf):
    b = M.batch_metrics(_rows(spark, sf))
    return b.select("batch_id", r6("mse").alias("mse"), r6("sum_mse").alias("sum_mse"))


@query("met2_variance_prop_mse", f"WITH {_DELTA} SELECT batch_id, round(variance_prop_mse, 6) AS variance_prop_mse FROM bm")
def met2(spark, sf):
    b = M.batch_metrics(_rows(spark, sf))
    return b.select("batch_id", r6("variance_prop_mse").alias("variance_prop_mse"))


@query("met3_explained_variance", f"WITH {_DELTA} SELECT batch_id, round(explained_variance, 6) AS explained_variance FROM bm")
def met3(spark, sf):
    b = M.batch_metrics(_rows(spark, sf))
    return b.select("batch_id", r6("explained_variance").alias("explained_variance"))


@query("met4_position_mse", f"""
WITH {_DELTA}, pm AS (SELECT batch_id, pos, avg(se / n) AS m FROM rw GROUP BY 1, 2),
g AS (SELECT b.batch_id, CAST(p AS INTEGER) AS pos FROM (SELECT DISTINCT batch_id FROM rw) b, range(0, 10) t(p))
SELECT g.batch_id, g.pos, round(coalesce(pm.m, 0), 6) AS position_mse FROM g LEFT JOIN pm USING (batch_id, pos)
""")
def met4(spark, sf):
    p = M.position_mse(_rows(spark, sf), C.SEQ_LEN)
    return p.select("batch_id", "pos", r6("position_mse").alias("position_mse"))


@query("met5_l0_l1", f"WITH {_DELTA} SELECT batch_id, round(l0, 6) AS l0, round(l1, 6) AS l1 FROM bm")
def met5(spark, sf):
    b = M.batch_metrics(_rows(spark, sf))
    return b.select("batch_id", r6("l0").alias("l0"), r6("l1").alias("l1"))


@query("met7_dead_pct", f"""
WITH lat AS ({C.latents_sql()}), cur AS (SELECT max(batch_id) AS c FROM ({ACT})),
last AS (SELECT feature, max(batch_id) AS la FROM lat WHERE value > 0 GROUP BY feature),
f AS (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS feature)
SELECT round(avg(CAST((c - coalesce(la, 0) + 1) * 100 >= 200 AS DOUBLE)), 6) AS dead_feature_prop
FROM f CROSS JOIN cur LEFT JOIN last USING (feature)
""")
def met7(spark, sf):
    cur = C.activations(spark, sf).agg(F.max("batch_id")).first()[0]
    dead = W.dead_features(C.latents(spark, sf), C.N_FEATURES, cur, 100, 200)
    return M.dead_pct(dead).select(r6("dead_feature_prop").alias("dead_feature_prop"))


@query("met8_normalised_l2", f"""
WITH rc AS ({RECON_SQL}),
j AS (SELECT l.batch_id, l.dim, l.x, rc.recon FROM ({ALONG}) l JOIN rc USING (vec_id, dim)),
pd AS (SELECT batch_id, dim, sum((x - recon) * (x - recon)) AS se, sum(x * x) - sum(x) * sum(x) / count(*) AS sv, count(*) AS n
       FROM j GROUP BY 1, 2)
SELECT batch_id, round(sum(se) / sum(n), 6) AS l2, round(sum(sv) / sum(n), 6) AS variance,
       round((sum(se) / sum(n)) / (sum(sv) / sum(n)), 6) AS l2_scaled FROM pd GROUP BY batch_id
""")
def met8(spark, sf):
    n = M.normalised_l2(_rows(spark, sf))
    return n.select("batch_id", r6("l2").alias("l2"), r6("variance").alias("variance"), r6("l2_scaled").alias("l2_scaled"))


def _dead_for_aux(spark, sf):
    lat = C.latents(spark, sf)
    cur = C.activations(spark, sf).agg(F.max("batch_id")).first()[0]
    dead = W.inactive_batches(lat, C.N_FEATURES, cur, 1).where(F.col("dead_for_aux"))
    return [r["feature"] for r in dead.select("feature").collect()]  # feature ids: model-sized


@query("met9_aux_loss", f"""
WITH lat AS ({C.latents_sql()}),
cur AS (SELECT max(batch_id) AS c FROM ({ACT})),
s AS (SELECT feature, batch_id, sum(value) AS s FROM lat GROUP BY 1, 2),
last AS (SELECT feature, max(batch_id) AS last_active FROM s WHERE s > 0 GROUP BY feature),
f AS (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS feature),
dead AS (SELECT feature FROM f LEFT JOIN last USING (feature), cur WHERE c - coalesce(last_active, -1) >= 1),
act AS (SELECT a.vec_id, CAST(d.feature AS INTEGER) AS feature, greatest(list_dot_product(a.x, d.w), 0) AS v FROM ({AX}) a, ({DICT}) d),
main AS (SELECT vec_id, feature, v FROM (
 SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, feature) AS r FROM act) WHERE r <= {C.TOPK}),
aux AS (SELECT vec_id, feature, v FROM (
 SELECT act.*, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, feature) AS r FROM act JOIN dead USING (feature)) WHERE r <= 8),
tot AS (SELECT p.vec_id, dl.dim, sum(p.v * dl.w) AS t
        FROM (SELECT * FROM main UNION ALL SELECT * FROM aux) p JOIN ({DICT_LONG}) dl USING (feature) GROUP BY 1, 2)
SELECT batch_id, round(CASE WHEN (SELECT count(*) FROM dead) = 0 THEN 0
       ELSE sum((coalesce(t, 0) - x) * (coalesce(t, 0) - x)) / 32.0 / count(*) END, 6) AS aux_loss
FROM ({ALONG}) l LEFT JOIN tot USING (vec_id, dim) GROUP BY batch_id
""")
def met9(spark, sf):
    d = C.dictionary(spark, sf)
    dead = _dead_for_aux(spark, sf)
    a = S.aux_loss(C.activations(spark, sf), d, dead, k=C.TOPK, k_aux=8, penalty=1 / 32)
    return a.select("batch_id", r6("aux_loss").alias("aux_loss"))


@query("met10_loss_relu", f"""
WITH lat AS (SELECT a.vec_id, a.batch_id, d.feature, list_dot_product(a.x, d.w) AS v FROM ({AX}) a, ({DICT}) d),
pos AS (SELECT * FROM lat WHERE v > 0),
rc AS (SELECT p.vec_id, dl.dim, sum(p.v * dl.w) AS recon FROM pos p JOIN ({DICT_LONG}) dl USING (feature) GROUP BY 1, 2),
j AS (SELECT l.batch_id, l.vec_id, l.x, coalesce(rc.recon, 0) AS recon, l.x - coalesce(rc.recon, 0) AS d
      FROM ({ALONG}) l LEFT JOIN rc USING (vec_id, dim)),
rw AS (SELECT batch_id, vec_id, sum(d * d) AS se, count(*) AS n, sqrt(sum(x * x)) AS norm FROM j GROUP BY 1, 2),
l1 AS (SELECT vec_id, sum(abs(v)) AS l1 FROM pos GROUP BY vec_id)
SELECT batch_id, round(avg(se / norm / n + 1e-9) + 0.01 * avg(coalesce(l1, 0)), 6) AS loss
FROM rw LEFT JOIN l1 USING (vec_id) GROUP BY batch_id
""")
def met10(spark, sf):
    b = M.batch_metrics(_rows(spark, sf, arch="relu", k=None))
    return M.loss_combination(b, "relu", l1_coefficient=0.01).select("batch_id", r6("loss").alias("loss"))


@query("met11_training_events", f"""
WITH {_DELTA}
SELECT 'training_batch' AS event, batch_id, round(mse, 6) AS mse, round(sum_mse, 6) AS sum_mse,
       round(variance_prop_mse, 6) AS variance_proportional_mse, round(variance_prop_mse, 6) AS loss,
       round(explained_variance, 6) AS explained_variance, round(l0, 6) AS L0,
       round(input_mean, 6) AS input_mean, round(input_std, 6) AS input_std
FROM bm JOIN im USING (batch_id)
""")
def met11(spark, sf):
    b = M.loss_combination(M.batch_metrics(_rows(spark, sf)), "topk")
    return b.select(F.lit("training_batch").alias("event"), "batch_id", r6("mse").alias("mse"),
                    r6("sum_mse").alias("sum_mse"), r6("variance_prop_mse").alias("variance_proportional_mse"),
                    r6("loss").alias("loss"), r6("explained_variance").alias("explained_variance"),
                    r6("l0").alias("L0"), r6("input_mean").alias("input_mean"), r6("input_std").alias("input_std"))


# ---------------------------------------------------------------- fitting: one step over the whole table

FIT_L1 = 0.01          # fixed values of the fitting fixtures
FIT_BANDWIDTH = 0.08

_FIT_BASE = f"""
L AS (SELECT vec_id, dim, x FROM ({ALONG})),
A AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM ({AX})),
D AS ({DICT_LONG})"""
# every feature x dimension, and the sums that meet there
_FIT_MATRICES = """
SELECT g.param, D.feature AS row, D.dim, coalesce(g.s, 0) AS grad FROM D JOIN (
 SELECT 'dec' AS param, D.feature, D.dim, s.s FROM D LEFT JOIN (
  SELECT feature, dim, sum(a * g) AS s FROM lat JOIN gr USING (vec_id) GROUP BY 1, 2) s USING (feature, dim)
 UNION ALL SELECT 'enc', D.feature, D.dim, s.s FROM D LEFT JOIN (
  SELECT feature, dim, sum(dz * x) AS s FROM dz JOIN L USING (vec_id) GROUP BY 1, 2) s USING (feature, dim)) g USING (feature, dim)"""
_FIT_OUT = "SELECT param, CAST(row AS INTEGER) AS row, CAST(dim AS INTEGER) AS dim, round(grad, 6) AS grad FROM "


def _fit1_sql(active: str, l1: float, base: str = _FIT_BASE) -> str:
    return f"""
WITH {base},
z AS (SELECT a.vec_id, d.feature, list_dot_product(a.x, d.w) AS z FROM A a, ({DICT}) d),
lat AS ({active}),
rc AS (SELECT vec_id, dim, sum(a * w) AS r FROM lat JOIN D USING (feature) GROUP BY 1, 2),
gr AS (SELECT L.vec_id, L.dim, -2 * (L.x - coalesce(r, 0)) / A.norm / len(A.x) AS g
       FROM L JOIN A USING (vec_id) LEFT JOIN rc USING (vec_id, dim)),
dz AS (SELECT lat.vec_id, lat.feature, sum(gr.g * D.w) + {l1} * sign(lat.a) AS dz
       FROM lat JOIN gr USING (vec_id) JOIN D USING (feature, dim) GROUP BY lat.vec_id, lat.feature, lat.a),
back AS (SELECT dim, sum(dz * w) AS s FROM dz JOIN D USING (feature) GROUP BY dim)
{_FIT_OUT} ({_FIT_MATRICES}
 UNION ALL SELECT 'pre_b', 0, dim, t.s - back.s FROM (SELECT dim, sum(g) AS s FROM gr GROUP BY dim) t JOIN back USING (dim))"""


def _fit2_sql(active: str, l1: float, *, centred: bool = True, more: str = "", base: str = _FIT_BASE) -> str:
    back = " - back.s" if centred else ""
    return f"""
WITH {base},
z AS (SELECT a.vec_id, d.feature, greatest(list_dot_product(a.x, d.w) + {BIAS}, 0) AS z FROM A a, ({DICT}) d),
lat AS (SELECT * FROM ({active}) WHERE a > 0),
rc AS (SELECT vec_id, dim, sum(a * w) AS r FROM lat JOIN D USING (feature) GROUP BY 1, 2),
gr AS (SELECT L.vec_id, L.dim, 2 * (coalesce(r, 0) - L.x) / len(A.x) AS g
       FROM L JOIN A USING (vec_id) LEFT JOIN rc USING (vec_id, dim)),
dz AS (SELECT lat.vec_id, lat.feature, sum(gr.g * D.w) + {l1} AS dz
       FROM lat JOIN gr USING (vec_id) JOIN D USING (feature, dim) GROUP BY lat.vec_id, lat.feature),
back AS (SELECT dim, sum(dz * w) AS s FROM dz JOIN D USING (feature) GROUP BY dim)
{_FIT_OUT} ({_FIT_MATRICES}
 UNION ALL SELECT 'b_dec', 0, dim, t.s{back} FROM (SELECT dim, sum(g) AS s FROM gr GROUP BY dim) t JOIN back USING (dim)
 UNION ALL SELECT 'b_enc', 0, d.feature, coalesce(sum(dz), 0) FROM ({DICT}) d LEFT JOIN dz USING (feature) GROUP BY d.feature
 {more})"""


_SWITCH_FIT_SQL = f"""
WITH {_FIT_BASE},
{_ROUTE_SQL},
EF AS ({C.EXPERT_FEATURES_SQL}),
X AS (SELECT expert, feature, u.i - 1 AS dim, EF.w[u.i] AS w FROM EF, LATERAL (SELECT unnest(range(1, len(EF.w) + 1)) AS i) u),
R AS (SELECT expert, u.i - 1 AS dim, r[u.i] AS w FROM ({C.ROUTER_SQL}) t, LATERAL (SELECT unnest(range(1, len(t.r) + 1)) AS i) u),
lat AS (SELECT vec_id, feature, a, p FROM (
 SELECT A.vec_id, EF.feature, w.p, list_dot_product(A.x, EF.w) AS a,
        row_number() OVER (PARTITION BY A.vec_id ORDER BY list_dot_product(A.x, EF.w) DESC, EF.feature) AS rn
 FROM A JOIN w USING (vec_id) JOIN EF USING (expert)) WHERE rn <= 2),
rc AS (SELECT vec_id, dim, sum(a * X.w) AS r FROM lat JOIN X USING (feature) GROUP BY 1, 2),
gr AS (SELECT L.vec_id, L.dim, rc.r, w.p, -2 * (L.x - w.p * rc.r) / A.norm / len(A.x) AS g
       FROM L JOIN A USING (vec_id) JOIN rc USING (vec_id, dim) JOIN w USING (vec_id)),
dz AS (SELECT lat.vec_id, lat.feature, sum(gr.g * gr.p * X.w) AS dz
       FROM lat JOIN gr USING (vec_id) JOIN X USING (feature, dim) GROUP BY 1, 2),
dp AS (SELECT vec_id, sum(g * r) AS dp FROM gr GROUP BY vec_id),
dl AS (SELECT q.vec_id, q.expert, q.p * dp.dp * (CASE WHEN q.expert = w.expert THEN 1 ELSE 0 END - w.p) AS dl
       FROM q JOIN w USING (vec_id) JOIN dp USING (vec_id)),
back AS (SELECT dim, sum(dz * X.w) AS s FROM dz JOIN X USING (feature) GROUP BY dim)
{_FIT_OUT} (
 SELECT 'dec' AS param, feature AS row, dim, coalesce(s, 0) AS grad FROM X LEFT JOIN (
  SELECT feature, dim, sum(a * g * gr.p) AS s FROM lat JOIN gr USING (vec_id) GROUP BY 1, 2) USING (feature, dim)
 UNION ALL SELECT 'enc', feature, dim, coalesce(s, 0) FROM X LEFT JOIN (
  SELECT feature, dim, sum(dz * x) AS s FROM dz JOIN L USING (vec_id) GROUP BY 1, 2) USING (feature, dim)
 UNION ALL SELECT 'pre_b', 0, dim, t.s - back.s FROM (SELECT dim, sum(g) AS s FROM gr GROUP BY dim) t JOIN back USING (dim)
 UNION ALL SELECT 'router', expert, dim, sum(dl * x) FROM dl JOIN L USING (vec_id) GROUP BY 1, 2, 3
 UNION ALL SELECT 'router_b', 0, dim, -sum(dl * R.w) FROM dl JOIN R USING (expert) GROUP BY dim)"""


def _fit_step(spark, sf, arch, params, k=None, l1=0.0):
    """Row sums (batch size x gradient) of one step over the whole table from the fixture parameters."""
    from actlens.operators import fit as FT
    a = C.activations(spark, sf).select("vec")
    n = a.count()
    blocks = FT.gradient_blocks(a, params, arch, k=k, l1_coefficient=l1, n_total=n, bandwidth=FIT_BANDWIDTH)
    return FT.gradient_table(blocks, params, float(n)).select("param", "row", "dim", r6("grad").alias("grad"))


def _fit1_params(spark, sf):
    d = C.dictionary(spark, sf)
    return {"enc": d.enc, "dec": d.dec, "pre_b": d.pre_b}


def _fit2_params(spark, sf, jump=False):
    d = C.dictionary(spark, sf, with_bias=True, with_threshold=jump)
    p = {"enc": d.enc, "dec": d.dec, "b_dec": d.pre_b, "b_enc": d.b_enc}
    return {**p, "log_threshold": d.log_threshold} if jump else p


def _best(per: str) -> str:
    return (f"SELECT vec_id, feature, z AS a FROM (SELECT *, row_number() OVER ({per} ORDER BY z DESC, feature) AS rn FROM z) "
            f"WHERE rn <= {C.TOPK}")


@query("fit1_relu", _fit1_sql("SELECT vec_id, feature, z AS a FROM z WHERE z > 0", FIT_L1))
def fit1_relu(spark, sf):
    return _fit_step(spark, sf, "relu", _fit1_params(spark, sf), l1=FIT_L1)


@query("fit1_topk", _fit1_sql(_best("PARTITION BY vec_id"), 0.0))
def fit1_topk(spark, sf):
    return _fit_step(spark, sf, "topk", _fit1_params(spark, sf), k=C.TOPK)


@query("fit1_switch_topk", _SWITCH_FIT_SQL)
def fit1_switch(spark, sf):
    d, _ = C.expert_tables(spark, sf)
    return _fit_step(spark, sf, "switch_topk", {"enc": d.enc, "dec": d.dec, "pre_b": d.pre_b, "router": d.router,
                                                "router_b": d.router_b}, k=2)


@query("fit2_batch_topk", _fit2_sql(f"""
SELECT vec_id, feature, z AS a FROM z WHERE z >= (
 SELECT z FROM (SELECT z, row_number() OVER (ORDER BY z DESC) AS rn FROM z)
 WHERE rn = {C.TOPK} * (SELECT count(*) FROM A))""", FIT_L1))
def fit2_btk(spark, sf):
    return _fit_step(spark, sf, "batch_topk", _fit2_params(spark, sf), k=C.TOPK, l1=FIT_L1)


@query("fit2_topk_relu", _fit2_sql(_best("PARTITION BY vec_id"), FIT_L1))
def fit2_topk_relu(spark, sf):
    return _fit_step(spark, sf, "topk_relu", _fit2_params(spark, sf), k=C.TOPK, l1=FIT_L1)


@query("fit2_vanilla", _fit2_sql("SELECT vec_id, feature, z AS a FROM z", FIT_L1))
def fit2_vanilla(spark, sf):
    return _fit_step(spark, sf, "vanilla", _fit2_params(spark, sf), l1=FIT_L1)


_THETA = "(0.05 + 0.01 * (z.feature % 5))::DOUBLE"


@query("fit2_jumprelu", _fit2_sql(f"SELECT vec_id, feature, z AS a FROM z WHERE z > {_THETA}", 0.0, centred=False, more=f"""
 UNION ALL SELECT 'log_threshold', 0, feature, -sum(da * t / {FIT_BANDWIDTH} * r) - {FIT_L1} / {FIT_BANDWIDTH} * sum(r0) FROM (
  SELECT z.vec_id, z.feature, {_THETA} AS t, sum(gr.g * D.w) AS da,
         CASE WHEN abs(z.z - {_THETA}) / {FIT_BANDWIDTH} < 0.5 THEN 1 ELSE 0 END AS r,
         CASE WHEN z.z > {_THETA} AND (z.z - {_THETA}) / {FIT_BANDWIDTH} < 0.5 THEN 1 ELSE 0 END AS r0
  FROM z JOIN gr USING (vec_id) JOIN D USING (feature, dim) GROUP BY z.vec_id, z.feature, z.z) GROUP BY feature"""))
def fit2_jump(spark, sf):
    return _fit_step(spark, sf, "jumprelu", _fit2_params(spark, sf, jump=True), l1=FIT_L1)
