"""Queries of aggregations, statistics and windows over vectors, logs and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.functions import columns as FN
from actlens.operators import ordering as O
from actlens.operators import moments as MO
from actlens.operators import stats as A
from actlens.operators import windows as W
from actlens.plans import canonical as C
from actlens.plans.registry import query

ACT = C.ACT_SQL
ALONG = C.ACT_LONG_SQL
LOG = C.RUN_LOG_SQL


def r6(c):
    return F.round(c, 6)


@query("agg1_batch_stats", f"""
SELECT batch_id, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max,
       round(stddev_samp(x), 6) AS std, count(*) AS n_values FROM ({ALONG}) GROUP BY batch_id
""")
def agg1(spark, sf):
    s = MO.batch_value_stats(C.activations(spark, sf))
    return s.select("batch_id", *[r6(c).alias(c) for c in ("mean", "min", "max", "std")], "n_values")


@query("agg2_sample_dim_stats", f"""
SELECT sample_id, dim, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(min(x), 6) AS min
FROM ({ALONG}) WHERE dim < 64 GROUP BY sample_id, dim
""")
def agg2(spark, sf):
    s = A.sample_dim_stats(C.activations_long(spark, sf), 64)
    return s.select("sample_id", "dim", r6("mean").alias("mean"), r6("max").alias("max"), r6("min").alias("min"))


def _hist_sql(src: str, bins: int, group: str | None) -> str:
    gsel = f"{group}, " if group else ""
    gby = f"GROUP BY {group}" if group else ""
    using = f"USING ({group}, bin)" if group else "USING (bin)"
    gjoin = f"USING ({group})" if group else "ON TRUE"
    return f"""
WITH v AS ({src}),
b AS (SELECT {gsel}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM v {gby}),
c AS (SELECT {gsel}CAST(least(floor((x - lo) * ({float(bins)} / (hi - lo))), {bins - 1}) + 1 AS INTEGER) AS bin,
             count(*) AS n FROM v JOIN b {gjoin} GROUP BY ALL),
g AS (SELECT CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin)
SELECT {gsel}g.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS count,
       round(lo + (g.bin - 1) * ((hi - lo) / {float(bins)}), 6) AS edge_lo,
       round(lo + g.bin * ((hi - lo) / {float(bins)}), 6) AS edge_hi
FROM b CROSS JOIN g LEFT JOIN c {using}
"""


@query("agg3_histogram", _hist_sql(f"SELECT x FROM ({ALONG})", 50, None))
def agg3(spark, sf):
    h = A.histogram(C.activations_long(spark, sf), "x", 50)
    return h.select("bin", "count", r6("edge_lo").alias("edge_lo"), r6("edge_hi").alias("edge_hi"))


PARAMS_LONG_SQL = f"""
SELECT 'enc' AS param, CAST(e.embedding[u.i] AS DOUBLE) AS x FROM embeddings e,
  LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) u WHERE e.vec_id < 32
UNION ALL
SELECT 'router' AS param, unnest(r) AS x FROM ({C.ROUTER_SQL})
UNION ALL
SELECT 'pre_b' AS param, unnest(mu) AS x FROM ({C.MEAN_SQL})
"""


def params_long(spark, sf):
    """(param, x) values of the fixture dictionary: enc rows, router rows, pre_b."""
    from actlens.sources.tables import read_table
    e = read_table(spark, sf, "embeddings")
    enc = e.where(F.col("vec_id") < C.N_FEATURES).select(
        F.lit("enc").alias("param"), F.explode("embedding").alias("x"))
    long = e.select("label", F.posexplode("embedding").alias("dim", "x"))
    router = long.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x")) \
                 .select(F.lit("router").alias("param"), "x")
    pre_b = long.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("x")) \
                .select(F.lit("pre_b").alias("param"), "x")
    return enc.withColumn("x", F.col("x").cast("double")).unionByName(router).unionByName(pre_b)


@query("agg4_weight_histograms", _hist_sql(PARAMS_LONG_SQL, 25, "param"))
def agg4(spark, sf):
    h = A.histogram(params_long(spark, sf), "x", 25, group_cols=["param"])
    return h.select("param", "bin", "count", r6("edge_lo").alias("edge_lo"), r6("edge_hi").alias("edge_hi"))


@query("agg5_batch_norm", f"""
SELECT vec_id, dim, round((x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6), 6) AS z
FROM ({ALONG}) WINDOW w AS (PARTITION BY batch_id, dim)
""")
def agg5(spark, sf):
    z = MO.batch_norm_vectors(C.activations(spark, sf))
    return z.select("vec_id", F.posexplode("normed").alias("dim", "z")).select("vec_id", "dim", r6("z").alias("z"))


@query("agg6_unit_norm", f"""
WITH s AS (SELECT vec_id, avg(x) AS mu, stddev_samp(x) AS sd FROM ({ALONG}) GROUP BY vec_id),
l AS (SELECT l.vec_id, l.dim, l.x, s.mu, s.sd, (l.x - s.mu) / (s.sd + 1e-5) AS y FROM ({ALONG}) l JOIN s USING (vec_id))
SELECT vec_id, round(any_value(mu), 6) AS mu, round(any_value(sd), 6) AS sd,
       round(max_by(y, -dim), 6) AS y0, round(max(abs((y * sd + mu) - x)), 6) AS restore_err
FROM l GROUP BY vec_id
""")
def agg6(spark, sf):
    from actlens.sources.tables import read_table
    e = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    u = A.unit_norm_undo(A.unit_norm(e))
    err = F.array_max(F.zip_with("restored", F.transform("vec", lambda x: x.cast("double")),
                                 lambda a, b: F.abs(a - b)))
    return u.select("vec_id", r6("mu").alias("mu"), r6("sd").alias("sd"),
                    r6(F.col("normed")[0]).alias("y0"), r6(err).alias("restore_err"))


@query("agg7_mean_std_over_batches", f"""
SELECT dim, round(avg(m), 6) AS mean, round(avg(s), 6) AS std FROM (
 SELECT batch_id, dim, avg(x) AS m, stddev_samp(x) AS s FROM ({ALONG}) GROUP BY batch_id, dim) GROUP BY dim
""")
def agg7(spark, sf):
    s = MO.mean_std_vectors(C.activations(spark, sf))
    return s.select("dim", r6("mean").alias("mean"), r6("std").alias("std"))


@query("agg8_spread_by_position", f"""
WITH a AS (SELECT pos, avg(s) AS std_over_dims FROM (SELECT sample_id, pos, stddev_samp(x) AS s FROM ({ALONG}) GROUP BY 1, 2) GROUP BY pos),
b AS (SELECT pos, avg(s) AS std_over_samples FROM (SELECT pos, dim, stddev_samp(x) AS s FROM ({ALONG}) GROUP BY 1, 2) GROUP BY pos),
c AS (SELECT pos, avg(x) AS mean FROM ({ALONG}) GROUP BY pos)
SELECT pos, round(std_over_dims, 6) AS std_over_dims, round(std_over_samples, 6) AS std_over_samples,
       round(mean, 6) AS mean FROM a JOIN b USING (pos) JOIN c USING (pos)
""")
def agg8(spark, sf):
    s = MO.spread_vectors(C.activations(spark, sf))
    return s.select("pos", *[r6(c).alias(c) for c in ("std_over_dims", "std_over_samples", "mean")])


@query("agg9_geometric_median", f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT vec_id, dim, CAST(x AS DOUBLE) AS x FROM ({ALONG})),
w(i, dim, m) AS (
 SELECT 0, dim, avg(x) FROM l GROUP BY dim
 UNION ALL
 SELECT q.i + 1, l.dim, sum(l.x * q.nw) / sum(q.nw)
 FROM l JOIN (SELECT s.i, l.vec_id, 1 / greatest(sqrt(sum((l.x - s.m) * (l.x - s.m))), 1e-6) AS nw
              FROM l JOIN w s USING (dim) WHERE s.i < 60 GROUP BY s.i, l.vec_id) q USING (vec_id)
 GROUP BY q.i, l.dim)
SELECT CAST(dim AS INTEGER) AS dim, round(m, 6) AS median FROM w WHERE i = 60
""")
def agg9(spark, sf):
    from actlens.operators.geometry import geometric_median
    from actlens.sources.tables import read_table
    e = read_table(spark, sf, "embeddings").select(F.col("embedding").alias("vec"))
    med = geometric_median(e, "vec")
    rows = [(i, round(float(v), 6)) for i, v in enumerate(med)]
    return spark.createDataFrame(rows, "dim INT, median DOUBLE")


@query("agg10_weighted_average", f"""
SELECT dim, round(sum((label + 1) * x) / sum(label + 1), 6) AS wavg FROM ({ALONG}) GROUP BY dim
""")
def agg10(spark, sf):
    long = C.activations_long(spark, sf).withColumn("w", F.col("label") + 1)
    return A.weighted_average(long, "w").select("dim", r6("wavg").alias("wavg"))


SIM = C.SIMILARITY_SQL


@query("agg11_cosine", f"""
SELECT doc_id, strategy, round(avg(cos), 6) AS mean_cos, count(*) AS n FROM ({SIM}) GROUP BY doc_id, strategy
""")
def agg11(spark, sf):
    s = C.similarity(spark, sf)
    return s.groupBy("doc_id", "strategy").agg(r6(F.avg("cos")).alias("mean_cos"), F.count(F.lit(1)).alias("n"))


def strategy_stats(sim):
    """AGG12: mean over texts per position, then mean / std_{n-1} over positions."""
    per_pos = sim.groupBy("layer", "strategy", "pos").agg(F.avg("cos").alias("m"))
    return per_pos.groupBy("layer", "strategy").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


_STRAT_SQL = f"""SELECT layer, strategy, avg(m) AS mean, stddev_samp(m) AS std FROM (
 SELECT layer, strategy, pos, avg(cos) AS m FROM ({SIM}) GROUP BY 1, 2, 3) GROUP BY layer, strategy"""


@query("agg12_strategy_stats", f"SELECT layer, strategy, round(mean, 6) AS mean, round(std, 6) AS std FROM ({_STRAT_SQL})")
def agg12(spark, sf):
    s = strategy_stats(C.similarity(spark, sf))
    return s.select("layer", "strategy", r6("mean").alias("mean"), r6("std").alias("std"))


@query("agg13_strategy_overall", f"""
SELECT strategy, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std FROM ({_STRAT_SQL}) GROUP BY strategy
""")
def agg13(spark, sf):
    s = strategy_stats(C.similarity(spark, sf))
    return s.groupBy("strategy").agg(r6(F.avg("mean")).alias("mean"), r6(F.stddev_samp("mean")).alias("std"))


@query("win3_rank_strategies", f"""
SELECT layer, strategy, round(mean, 6) AS mean,
       CAST(row_number() OVER (PARTITION BY layer ORDER BY mean DESC, strategy) AS BIGINT) AS rank
FROM ({_STRAT_SQL})
""")
def win3(spark, sf):
    s = strategy_stats(C.similarity(spark, sf))
    r = W.rank_within(s, ["layer"], [F.col("mean").desc(), F.col("strategy")])
    return r.select("layer", "strategy", r6("mean").alias("mean"), "rank")


@query("prj15_position_profile", f"""
SELECT strategy, pos, round(avg(cos), 6) AS mean_cos FROM ({SIM}) WHERE pos < 20 GROUP BY strategy, pos
""")
def prj15(spark, sf):
    from actlens.operators.shape import position_profile
    p = position_profile(C.similarity(spark, sf), ["strategy"], "pos", "cos", 20)
    return p.select("strategy", "pos", r6("mean_cos").alias("mean_cos"))


@query("agg23_position_range_mean", f"""
SELECT strategy, round(avg(CASE WHEN pos < 128 THEN cos END), 6) AS mean_below_128,
       round(avg(CASE WHEN pos >= 512 THEN cos END), 6) AS mean_from_512 FROM ({SIM}) GROUP BY strategy
""")
def agg23(spark, sf):
    p = A.position_range_mean(C.similarity(spark, sf), ["strategy"], "pos", "cos")
    return p.select("strategy", r6("mean_below_128").alias("mean_below_128"), r6("mean_from_512").alias("mean_from_512"))


@query("joi10_similarity_vs_loss", f"""
WITH s AS (SELECT strategy, mean FROM ({_STRAT_SQL}) WHERE layer = 1),
l AS (SELECT CASE run % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'next' ELSE 'const' END AS strategy, min(value) AS min_loss
      FROM ({LOG}) GROUP BY 1)
SELECT strategy, round(mean, 3) AS mean_cos, round(min_loss, 6) AS min_loss FROM s JOIN l USING (strategy)
""")
def joi10(spark, sf):
    from actlens.operators.joins import similarity_vs_loss
    s = strategy_stats(C.similarity(spark, sf))
    r = F.col("run") % 3
    strat = F.when(r == 0, "own").when(r == 1, "next").otherwise("const")
    losses = C.run_log(spark, sf).groupBy(strat.alias("strategy")).agg(F.min("value").alias("min_loss"))
    j = similarity_vs_loss(s, losses, layer=1)
    return j.select("strategy", "mean_cos", r6("min_loss").alias("min_loss"))


# ---------------------------------------------------------------- ratings

RAT = C.RATINGS_SQL


@query("agg14_cohen_kappa", f"""
WITH v AS (SELECT r1, r2 FROM ({RAT}) WHERE r1 IS NOT NULL AND r2 IS NOT NULL),
n AS (SELECT count(*) AS n, sum(CASE WHEN r1 = r2 THEN 1 ELSE 0 END) AS agree FROM v),
m AS (SELECT sum(m1 * m2) AS mm FROM (SELECT r1 AS label, count(*) AS m1 FROM v GROUP BY 1)
      JOIN (SELECT r2 AS label, count(*) AS m2 FROM v GROUP BY 1) USING (label))
SELECT n, round(agree / n, 6) AS p_o, round(mm / (n * n), 6) AS p_e,
       round((agree / n - mm / (n * n)) / (1 - mm / (n * n)), 6) AS kappa FROM n, m
""")
def agg14(spark, sf):
    k = A.cohen_kappa(C.ratings(spark, sf))
    return k.select("n", r6("p_o").alias("p_o"), r6("p_e").alias("p_e"), r6("kappa").alias("kappa"))


@query("agg15_rater_accuracy", f"""
SELECT 'r1' AS rater, round(coalesce(avg(CASE WHEN r1 IS NOT NULL THEN CAST(r1 = truth AS DOUBLE) END), 0), 6) AS accuracy,
       count(r1) AS n FROM ({RAT})
UNION ALL
SELECT 'r2' AS rater, round(coalesce(avg(CASE WHEN r2 IS NOT NULL THEN CAST(r2 = truth AS DOUBLE) END), 0), 6) AS accuracy,
       count(r2) AS n FROM ({RAT})
""")
def agg15(spark, sf):
    a = A.rater_accuracy(C.ratings(spark, sf), ["r1", "r2"], "truth")
    return a.select("rater", r6("accuracy").alias("accuracy"), "n")


@query("agg16_condition_stats", f"""
SELECT condition, round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, count(*) AS n FROM (
 SELECT idx1 % 3 AS condition, idx1 % 4 AS seed, avg(CAST(r1 = truth AS DOUBLE)) AS acc FROM ({RAT}) GROUP BY 1, 2)
GROUP BY condition
""")
def agg16(spark, sf):
    r = C.ratings(spark, sf)
    per = r.groupBy((F.col("idx1") % 3).alias("condition"), (F.col("idx1") % 4).alias("seed")) \
           .agg(F.avg((F.col("r1") == F.col("truth")).cast("double")).alias("acc"))
    s = A.condition_stats(per, ["condition"], "acc")
    return s.select("condition", r6("mean").alias("mean"), r6("std").alias("std"), "n")


ANSWERS_SQL = ("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'I think the Answer: ' ELSE 'final ANSWER: ' END "
               "|| CAST(1 + quality AS VARCHAR) AS reply, CAST(doc_id % 2 + 1 AS INTEGER) AS truth_index FROM labels")


def answers(spark, sf):
    from actlens.sources.tables import read_table
    lab = read_table(spark, sf, "labels")
    prefix = F.when(F.col("doc_id") % 2 == 0, F.lit("I think the Answer: ")).otherwise(F.lit("final ANSWER: "))
    return lab.select("doc_id", F.concat(prefix, (F.col("quality") + 1).cast("string")).alias("reply"),
                      (F.col("doc_id") % 2 + 1).cast("int").alias("truth_index"))


@query("agg17_mean_correctness", f"""
SELECT round(coalesce(avg(CAST(contains(upper(reply), 'ANSWER: ' || CAST(truth_index AS VARCHAR)) AS DOUBLE)), 0), 6)
       AS mean_correctness, count(*) AS n_evaluated FROM ({ANSWERS_SQL})
""")
def agg17(spark, sf):
    a = answers(spark, sf).withColumn("correct", FN.parse_answer("reply", F.col("truth_index")))
    m = A.mean_correctness(a)
    return m.select(r6("mean_correctness").alias("mean_correctness"), "n_evaluated")


@query("fn3_parse_answer", f"""
SELECT doc_id, contains(upper(reply), 'ANSWER: ' || CAST(truth_index AS VARCHAR)) AS correct FROM ({ANSWERS_SQL})
""")
def fn3(spark, sf):
    a = answers(spark, sf)
    return a.select("doc_id", FN.parse_answer("reply", F.col("truth_index")).alias("correct"))


# ---------------------------------------------------------------- logs

@query("agg18_settings_average", f"""
SELECT md5(CAST(k % 10 AS VARCHAR)) AS setting_hash, round(sum(value) / 4.0, 6) AS average FROM ({LOG}) GROUP BY 1
""")
def agg18(spark, sf):
    lg = C.run_log(spark, sf).withColumn("setting_hash", F.md5((F.col("k") % 10).cast("string")))
    return A.settings_average(lg, "setting_hash", "value").select("setting_hash", r6("average").alias("average"))


@query("agg19_run_summary", f"""
WITH m AS (SELECT run, max(timestamp) - min(timestamp) AS elapsed, avg(value) AS mean_value,
                  max_by(step, timestamp) AS last_step FROM ({LOG}) GROUP BY run),
h AS (SELECT run, avg(value) AS mean_first40, stddev_pop(value) AS std_first40 FROM ({LOG}) WHERE step <= 40 GROUP BY run)
SELECT run, round(elapsed, 3) AS elapsed, round(mean_value, 6) AS mean_value, last_step,
       round(mean_first40, 6) AS mean_first40, round(std_first40, 6) AS std_first40 FROM m LEFT JOIN h USING (run)
""")
def agg19(spark, sf):
    s = A.run_summary(C.run_log(spark, sf))
    return s.select("run", F.round("elapsed", 3).alias("elapsed"), r6("mean_value").alias("mean_value"),
                    "last_step", r6("mean_first40").alias("mean_first40"), r6("std_first40").alias("std_first40"))


@query("agg20_frontier", f"""
SELECT run, {C.RUN_CLASS_SQL} AS run_class, round(avg(k), 6) AS l0_last10, round(avg(value), 6) AS mse_last10 FROM (
 SELECT run, k, value, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM ({LOG})) WHERE rn <= 10
GROUP BY run
""")
def agg20(spark, sf):
    t = O.last_n_mean(C.run_log(spark, sf), ["run"], "step", ["k", "value"], 10)
    return t.select("run", C.run_class(F.col("run")).alias("run_class"), r6("k_last10").alias("l0_last10"),
                    r6("value_last10").alias("mse_last10"))


@query("agg21_throughput_by_setting", f"""
SELECT {C.N_EXPERTS_SQL} AS n_experts, (k % 3 + 1) * 128 AS inner_bs, round(avg(value), 6) AS tokens_per_s,
       round(avg(k), 6) AS memory FROM ({LOG}) GROUP BY ALL
""")
def agg21(spark, sf):
    lg = C.run_log(spark, sf)
    g = lg.groupBy(C.n_experts_of(F.col("run")).alias("n_experts"), ((F.col("k") % 3 + 1) * 128).alias("inner_bs"))
    return g.agg(r6(F.avg("value")).alias("tokens_per_s"), r6(F.avg("k")).alias("memory"))


@query("agg22_pivot_metrics", f"""
SELECT run, metric, CAST(row_number() OVER (PARTITION BY run, metric ORDER BY step) - 1 AS INTEGER) AS idx,
       step, round(v, 6) AS v FROM (
 SELECT run, step, 'value' AS metric, value AS v FROM ({LOG}) WHERE value IS NOT NULL
 UNION ALL SELECT run, step, 'k' AS metric, CAST(k AS DOUBLE) AS v FROM ({LOG}) WHERE k IS NOT NULL)
""")
def agg22(spark, sf):
    series = A.pivot_metrics(C.run_log(spark, sf), ["run"], "step", ["value", "k"])
    return series.select("run", "metric", F.col("idx").cast("int").alias("idx"), "step", r6("value").alias("v"))


@query("agg24_trial_stats", f"""
SELECT event, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std,
       round(sum(value * 1e6) / 1048576.0, 4) AS total_mib,
       round(sum(value * 1e6) / 1048576.0 / (max(timestamp + value) - min(timestamp)), 6) AS mib_per_s,
       round(avg(value), 6) AS mean_time FROM ({LOG}) GROUP BY event
""")
def agg24(spark, sf):
    lg = C.run_log(spark, sf).withColumn("bytes", F.col("value") * F.lit(1e6)) \
          .withColumn("end", F.col("timestamp") + F.col("value"))
    s = A.trial_stats(lg, ["event"], "value", bytes_col="bytes", start_col="timestamp", end_col="end")
    return s.select("event", "mean", "std", F.round("total_mib", 4).alias("total_mib"),
                    r6("mib_per_s").alias("mib_per_s"), r6("mean_time").alias("mean_time"))


@query("agg25_pivot_settings", f"""
WITH s AS (SELECT (k % 4) * 64 AS bs, CAST(pow(2, run % 4) AS INTEGER) AS n_experts, avg(value) AS v FROM ({LOG}) GROUP BY 1, 2)
SELECT bs, round(coalesce(max(v) FILTER (WHERE n_experts = 1), 0), 6) AS e1,
       round(coalesce(max(v) FILTER (WHERE n_experts = 2), 0), 6) AS e2,
       round(coalesce(max(v) FILTER (WHERE n_experts = 4), 0), 6) AS e4,
       round(coalesce(max(v) FILTER (WHERE n_experts = 8), 0), 6) AS e8 FROM s GROUP BY bs
""")
def agg25(spark, sf):
    lg = C.run_log(spark, sf)
    s = lg.groupBy(((F.col("k") % 4) * 64).alias("bs"),
                   F.pow(F.lit(2), F.col("run") % 4).cast("int").alias("n_experts")) \
          .agg(F.avg("value").alias("v"))
    p = A.pivot_settings(s, "bs", "n_experts", "v", [1, 2, 4, 8])
    return p.select("bs", *[r6(F.col(str(e))).alias(f"e{e}") for e in (1, 2, 4, 8)])


# ---------------------------------------------------------------- windows

@query("win2_activated_samples", f"SELECT feature, vec_id FROM ({C.latents_sql()}) WHERE value > 0")
def win2(spark, sf):
    return W.activated_samples(C.latents(spark, sf), sample_col="vec_id")


@query("win4_rate_between_logs", f"""
SELECT run, step, round(timestamp - lag(timestamp) OVER w, 6) AS elapsed,
       round(3200.0 / (timestamp - lag(timestamp) OVER w), 6) AS tokens_per_s
FROM ({LOG}) WINDOW w AS (PARTITION BY run ORDER BY timestamp)
""")
def win4(spark, sf):
    r = W.rate_between_logs(C.run_log(spark, sf), tokens_per_log=100 * 32 * 1)
    return r.select("run", "step", r6("elapsed").alias("elapsed"), r6("tokens_per_s").alias("tokens_per_s"))


@query("win5_moving_average", f"""
SELECT run, step, round(ma, 6) AS value_ma10 FROM (
 SELECT run, step, avg(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma,
        row_number() OVER (PARTITION BY run ORDER BY step) AS rn FROM ({LOG})) WHERE rn >= 10
""")
def win5(spark, sf):
    m = W.moving_average(C.run_log(spark, sf), "value", "step", 10, group_cols=["run"], index_col="step")
    return m.select("run", "step", r6("value_ma10").alias("value_ma10"))


@query("win6_dead_features", f"""
WITH lat AS ({C.latents_sql()}),
cur AS (SELECT max(batch_id) AS c FROM ({ACT})),
last AS (SELECT feature, max(batch_id) AS last_active FROM lat WHERE value > 0 GROUP BY feature),
f AS (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS feature)
SELECT f.feature, last_active, CAST((c - coalesce(last_active, 0) + 1) * 100 AS BIGINT) AS samples_since,
       (c - coalesce(last_active, 0) + 1) * 100 >= 200 AS dead FROM f CROSS JOIN cur LEFT JOIN last USING (feature)
""")
def win6(spark, sf):
    lat = C.latents(spark, sf)
    cur = C.activations(spark, sf).agg(F.max("batch_id")).first()[0]
    return W.dead_features(lat, C.N_FEATURES, cur, 100, 200)


@query("win6_dead_history", f"""
WITH lat AS ({C.latents_sql()}),
b AS (SELECT DISTINCT batch_id FROM lat),
f AS (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS feature),
a AS (SELECT DISTINCT feature, batch_id FROM lat WHERE value > 0),
g AS (SELECT f.feature, b.batch_id, max(CASE WHEN a.feature IS NOT NULL THEN b.batch_id END)
        OVER (PARTITION BY f.feature ORDER BY b.batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
      FROM f CROSS JOIN b LEFT JOIN a ON a.feature = f.feature AND a.batch_id = b.batch_id)
SELECT batch_id, round(avg(CAST((batch_id - coalesce(last, 0) + 1) * 100 >= 200 AS DOUBLE)), 6) AS dead_pct
FROM g GROUP BY batch_id
""")
def win6_hist(spark, sf):
    h = W.dead_history(C.latents(spark, sf), C.N_FEATURES, 100, 200)
    return h.select("batch_id", r6("dead_pct").alias("dead_pct"))


@query("win7_inactive_batches", f"""
WITH lat AS ({C.latents_sql()}),
cur AS (SELECT max(batch_id) AS c FROM ({ACT})),
s AS (SELECT feature, batch_id, sum(value) AS s FROM lat GROUP BY 1, 2),
last AS (SELECT feature, max(batch_id) AS last_active FROM s WHERE s > 0 GROUP BY feature),
f AS (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS feature)
SELECT f.feature, last_active, CAST(c - coalesce(last_active, -1) AS BIGINT) AS batches_since,
       c - coalesce(last_active, -1) > 1 AS dead, c - coalesce(last_active, -1) >= 1 AS dead_for_aux
FROM f CROSS JOIN cur LEFT JOIN last USING (feature)
""")
def win7(spark, sf):
    lat = C.latents(spark, sf)
    cur = C.activations(spark, sf).agg(F.max("batch_id")).first()[0]
    return W.inactive_batches(lat, C.N_FEATURES, cur, 1)


@query("win8_first_k_steps", f"SELECT run, step, round(value, 6) AS value FROM ({LOG}) WHERE step < 200 AND step % 5 = 0")
def win8(spark, sf):
    s = W.first_k_steps(C.run_log(spark, sf), pos_col=None)
    return s.select("run", "step", r6("value").alias("value"))


@query("fn14_json_shapes", f"""
WITH h AS ({_hist_sql(PARAMS_LONG_SQL, 25, "param")})
SELECT param, CAST(count(*) AS INTEGER) AS n_counts, CAST(count(*) + 1 AS INTEGER) AS n_edges,
       CAST(sum(count) AS DOUBLE) AS total, min(edge_lo) AS first_edge, max(edge_hi) AS last_edge FROM h GROUP BY param
""")
def fn14(spark, sf):
    """Histogram events as nested {counts, edges} structs, written as JSON text and parsed back."""
    from pyspark.sql import types as T
    h = A.histogram(params_long(spark, sf), "x", 25, group_cols=["param"])
    ev = A.histogram_event(h, ["param"]).select("param", F.to_json(F.struct(F.col("hist"))).alias("json"))
    schema = T.StructType([T.StructField("hist", T.StructType([
        T.StructField("counts", T.ArrayType(T.DoubleType())), T.StructField("edges", T.ArrayType(T.DoubleType()))]))])
    back = ev.select("param", F.from_json("json", schema).alias("j"))
    c, e = F.col("j.hist.counts"), F.col("j.hist.edges")
    return back.select("param", F.size(c).alias("n_counts"), F.size(e).alias("n_edges"),
                       F.aggregate(c, F.lit(0.0), lambda a, x: a + x).alias("total"),
                       r6(e[0]).alias("first_edge"), r6(F.element_at(e, -1)).alias("last_edge"))
