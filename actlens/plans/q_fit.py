"""Queries of the fits' further parts: normalised input, the lookup model, the
auxiliary loss, and one step with the parameters as a table.

Each is one step over the whole table from fixture parameters. Gradients are row
sums (batch size x gradient), as in ``q_models``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from actlens.operators import fit as FT
from actlens.operators import fit_tables as TB
from actlens.plans import canonical as C
from actlens.plans import q_models as Q
from actlens.plans.registry import query

# fixed values of the fixtures
LOOKUP_TOKENS, KNOWN_TOKENS = 50, 40      # token of a vector = vec_id % 50; ids below 40 have a lookup vector
DEAD_EVERY, AUX_K, AUX_PENALTY = 4, 2, 0.25   # every fourth feature counts as dead
STEP_LR, STEP_EPS, STEP_SLICES = 0.05, 1e-3, 8

_BATCH_BASE = f"""
L AS (SELECT vec_id, dim, (x - avg(x) OVER (PARTITION BY dim)) / (stddev_samp(x) OVER (PARTITION BY dim) + 1e-6) AS x
      FROM ({Q.ALONG})),
A AS (SELECT vec_id, list(x ORDER BY dim) AS x, sqrt(sum(x * x)) AS norm FROM L GROUP BY vec_id),
D AS ({Q.DICT_LONG})"""
_UNIT_BASE = _BATCH_BASE.replace("PARTITION BY dim", "PARTITION BY vec_id").replace("1e-6", "1e-5")


def _sums(spark, batch, params, step, extra=None):
    """(param, row, dim, grad) of one step, and of the lookup's tokens."""
    source = FT.Held(spark, params)
    step = FT.prepared_step(batch, source, step)
    blocks, tokens = FT.step_gradients(batch, source, step)
    out = FT.gradient_table(blocks, params, float(step.n_total))
    if tokens is not None:
        out = out.unionByName(tokens.select(F.lit("lookup").alias("param"), F.col("token_id").cast("int").alias("row"),
                                            F.posexplode("g").alias("dim", "grad"))
                              .withColumn("grad", F.col("grad") * float(step.n_total)))
    return out.select("param", "row", "dim", Q.r6("grad").alias("grad"))


@query("fit1_batch_norm", Q._fit1_sql(Q._best("PARTITION BY vec_id"), 0.0, _BATCH_BASE))
def fit1_batch_norm(spark, sf):
    """topk over the batch normalised by its own moments."""
    a = C.activations(spark, sf).select("vec")
    return _sums(spark, a, Q._fit1_params(spark, sf), FT.Step("topk", a.count(), C.TOPK, norm="batch"))


@query("fit2_unit_norm", Q._fit2_sql(Q._best("PARTITION BY vec_id"), Q.FIT_L1, base=_UNIT_BASE))
def fit2_unit_norm(spark, sf):
    """topk-relu over rows normalised one by one."""
    a = C.activations(spark, sf).select("vec")
    return _sums(spark, a, Q._fit2_params(spark, sf), FT.Step("topk_relu", a.count(), C.TOPK, Q.FIT_L1, norm="unit"))


_LOOKUP_SQL = Q._SWITCH_FIT_SQL.replace("""
gr AS (SELECT L.vec_id, L.dim, rc.r, w.p, -2 * (L.x - w.p * rc.r) / A.norm / len(A.x) AS g
       FROM L JOIN A USING (vec_id) JOIN rc USING (vec_id, dim) JOIN w USING (vec_id)),""", f"""
LK AS (SELECT vec_id AS token, dim, x AS w FROM L WHERE vec_id < {KNOWN_TOKENS}),
gr AS (SELECT L.vec_id, L.dim, rc.r, w.p,
              -2 * (L.x - w.p * rc.r - 0.5 * coalesce(LK.w, 0)) / A.norm / len(A.x) AS g
       FROM L JOIN A USING (vec_id) JOIN rc USING (vec_id, dim) JOIN w USING (vec_id)
       LEFT JOIN LK ON LK.token = L.vec_id % {LOOKUP_TOKENS} AND LK.dim = L.dim),""").replace("""
 UNION ALL SELECT 'router_b',""", f"""
 UNION ALL SELECT 'lookup', vec_id % {LOOKUP_TOKENS}, dim, sum(0.5 * g) FROM gr
  WHERE vec_id % {LOOKUP_TOKENS} < {KNOWN_TOKENS} GROUP BY 1, 2, 3
 UNION ALL SELECT 'router_b',""")


@query("fit1_lookup", _LOOKUP_SQL)
def fit1_lookup(spark, sf):
    """Switch topk with a vector per token added to the reconstruction."""
    d, _ = C.expert_tables(spark, sf)
    a = C.activations(spark, sf).select("vec_id", "vec", (F.col("vec_id") % LOOKUP_TOKENS).alias("token_id"))
    table = a.where(F.col("vec_id") < KNOWN_TOKENS).select(F.col("vec_id").alias("token_id"),
                                                           F.col("vec").cast("array<double>").alias("vec"))
    batch = FT.with_token_vectors(a, table)
    params = {"enc": d.enc, "dec": d.dec, "pre_b": d.pre_b, "router": d.router, "router_b": d.router_b}
    return _sums(spark, batch, params, FT.Step("lookup_switch_topk", a.count(), 2, lookup_scale=0.5))


_AUX_SQL = f"""
WITH {Q._FIT_BASE},
z AS (SELECT a.vec_id, d.feature, greatest(list_dot_product(a.x, d.w) + {Q.BIAS}, 0) AS z FROM A a, ({Q.DICT}) d),
lat AS (SELECT * FROM ({Q._best("PARTITION BY vec_id")}) WHERE a > 0),
aux AS (SELECT vec_id, feature, z AS a FROM (
 SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, feature) AS rn FROM z
 WHERE feature % {DEAD_EVERY} = {DEAD_EVERY - 1}) WHERE rn <= {AUX_K} AND z > 0),
rc AS (SELECT vec_id, dim, sum(a * w) AS r FROM lat JOIN D USING (feature) GROUP BY 1, 2),
ra AS (SELECT vec_id, dim, sum(a * w) AS r FROM aux JOIN D USING (feature) GROUP BY 1, 2),
ga AS (SELECT L.vec_id, L.dim, 2 * (coalesce(rc.r, 0) - L.x) / len(A.x) AS g1,
              2 * {AUX_PENALTY} * (coalesce(ra.r, 0) + coalesce(rc.r, 0) - L.x) / len(A.x) AS g2
       FROM L JOIN A USING (vec_id) LEFT JOIN rc USING (vec_id, dim) LEFT JOIN ra USING (vec_id, dim)),
gr AS (SELECT vec_id, dim, g1 + g2 AS g FROM ga),
dz AS (SELECT vec_id, feature, sum(dz) AS dz FROM (
  SELECT lat.vec_id, lat.feature, sum(gr.g * D.w) + {Q.FIT_L1} AS dz
  FROM lat JOIN gr USING (vec_id) JOIN D USING (feature, dim) GROUP BY lat.vec_id, lat.feature
  UNION ALL SELECT aux.vec_id, aux.feature, sum(ga.g2 * D.w)
  FROM aux JOIN ga USING (vec_id) JOIN D USING (feature, dim) GROUP BY aux.vec_id, aux.feature) GROUP BY 1, 2),
back AS (SELECT dim, sum(dz * w) AS s FROM dz JOIN D USING (feature) GROUP BY dim)
{Q._FIT_OUT} (SELECT g.param, D.feature AS row, D.dim, coalesce(g.s, 0) AS grad FROM D JOIN (
 SELECT 'dec' AS param, D.feature, D.dim, s.s FROM D LEFT JOIN (SELECT feature, dim, sum(s) AS s FROM (
   SELECT feature, dim, sum(a * g) AS s FROM lat JOIN gr USING (vec_id) GROUP BY 1, 2
   UNION ALL SELECT feature, dim, sum(a * g2) FROM aux JOIN ga USING (vec_id) GROUP BY 1, 2) GROUP BY 1, 2) s USING (feature, dim)
 UNION ALL SELECT 'enc', D.feature, D.dim, s.s FROM D LEFT JOIN (
  SELECT feature, dim, sum(dz * x) AS s FROM dz JOIN L USING (vec_id) GROUP BY 1, 2) s USING (feature, dim)) g USING (feature, dim)
 UNION ALL SELECT 'b_dec', 0, dim, t.s - back.s FROM (SELECT dim, sum(g) AS s FROM gr GROUP BY dim) t JOIN back USING (dim)
 UNION ALL SELECT 'b_enc', 0, d.feature, coalesce(sum(dz), 0) FROM ({Q.DICT}) d LEFT JOIN dz USING (feature) GROUP BY d.feature)"""


@query("fit2_aux_loss", _AUX_SQL)
def fit2_aux_loss(spark, sf):
    """topk-relu with the auxiliary loss over a given set of dead features."""
    a = C.activations(spark, sf).select("vec")
    params = Q._fit2_params(spark, sf)
    dead = np.arange(C.N_FEATURES) % DEAD_EVERY == DEAD_EVERY - 1
    return _sums(spark, a, params, FT.Step("topk_relu", a.count(), C.TOPK, Q.FIT_L1, dead=dead, top_k_aux=AUX_K,
                                           aux_penalty=AUX_PENALTY))


_ACTIVITY_SQL = f"""
WITH {Q._FIT_BASE},
z AS (SELECT a.vec_id, d.feature, greatest(list_dot_product(a.x, d.w) + {Q.BIAS}, 0) AS z FROM A a, ({Q.DICT}) d)
SELECT d.feature, CAST(count(l.vec_id) AS BIGINT) AS n_rows FROM ({Q.DICT}) d
LEFT JOIN ({Q._best("PARTITION BY vec_id")}) l ON l.feature = d.feature AND l.a > 0 GROUP BY d.feature"""


@query("fit2_activity", _ACTIVITY_SQL)
def fit2_activity(spark, sf):
    """How many rows of the batch use each feature: what resets its idle counter."""
    a = C.activations(spark, sf).select("vec")
    step = FT.Step("topk_relu", a.count(), C.TOPK)
    used = FT.feature_activity(a, FT.Held(spark, Q._fit2_params(spark, sf)), step)
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(used)], "feature int, n_rows bigint")


_MOMENTS_SQL = f"""SELECT dim, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM ({Q.ALONG}) GROUP BY dim"""


@query("fit_moments", _MOMENTS_SQL)
def fit_moments(spark, sf):
    """Mean and deviation of every dimension by merged moments of the tasks' batches."""
    mean, std = FT.batch_moments(C.activations(spark, sf))
    rows = [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(mean, std))]
    return spark.createDataFrame(rows, "dim int, mean double, std double").select("dim", Q.r6("mean").alias("mean"), Q.r6("std").alias("std"))


_STEP_SQL = f"""
SELECT g.param, g.row, g.dim, round(coalesce(w.w, 0) - {STEP_LR} * g.grad / (abs(g.grad) + {STEP_EPS}), 6) AS value,
       round(0.1 * g.grad, 6) AS m
FROM (SELECT param, row, dim, grad / n AS grad FROM (
  {{sums}}), (SELECT count(*) AS n FROM embeddings)) g
LEFT JOIN ({Q.DICT_LONG}) w ON g.param IN ('enc', 'dec') AND w.feature = g.row AND w.dim = g.dim"""
_STEP_SQL = _STEP_SQL.replace("{sums}", Q._fit1_sql(Q._best("PARTITION BY vec_id"), 0.0).replace("round(grad, 6)", "grad"))


@query("fit_table_step", _STEP_SQL)
def fit_table_step(spark, sf):
    """One Adam step with parameters, moments and gradients as tables of blocks."""
    a = C.activations(spark, sf).select(F.lit(0).alias("batch_id"), "vec")
    est = TB.TableEstimator("topk", C.N_FEATURES, slices=STEP_SLICES, k=C.TOPK, lr=STEP_LR, eps=STEP_EPS)
    done = est.fit(a, init=TB.state_table(spark, Q._fit1_params(spark, sf)))
    value, m = TB.parameter_rows(done.state), TB.parameter_rows(done.state, "m").withColumnRenamed("value", "m")
    return value.join(m, ["param", "row", "dim"]).select("param", "row", "dim", Q.r6("value").alias("value"), Q.r6("m").alias("m"))
