"""Queries of the interpretation chain: latents -> top samples -> pairs -> ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.operators import windows
from actlens.plans import canonical as C
from actlens.plans.registry import query
from actlens.sources.tables import read_table


def top9_per_feature(spark, sf):
    lat = C.latents(spark, sf)
    top = windows.top_k_per_feature(lat, 9, sample_col="vec_id")
    return top.select("feature", "rank", F.col("vec_id").alias("sample_index"),
                      F.round("value", 6).alias("value"), C.image_path(F.col("vec_id")).alias("path"))


query("win1_top_k_per_feature", f"""
WITH lat AS ({C.latents_sql()}),
r AS (SELECT feature, vec_id, value,
      row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS rank
      FROM lat WHERE value > 0),
t AS (SELECT * FROM r WHERE rank <= 9),
c AS (SELECT feature FROM t GROUP BY feature HAVING count(*) = 9)
SELECT t.feature, CAST(t.rank AS BIGINT) AS rank, t.vec_id AS sample_index,
       round(t.value, 6) AS value, {C.PATH_SQL} AS path
FROM t JOIN c USING (feature)
""")(top9_per_feature)


@query("win1_top_k_per_dim", f"""
WITH l AS ({C.ACT_LONG_SQL}),
r AS (SELECT dim, vec_id, x, row_number() OVER (PARTITION BY dim ORDER BY x DESC, vec_id) AS rank
      FROM l WHERE x > 0),
t AS (SELECT * FROM r WHERE rank <= 9),
c AS (SELECT dim FROM t GROUP BY dim HAVING count(*) = 9)
SELECT t.dim, CAST(t.rank AS BIGINT) AS rank, t.vec_id AS sample_index, round(t.x, 6) AS value
FROM t JOIN c USING (dim)
""")
def top9_per_dim(spark, sf):
    long = C.activations_long(spark, sf)
    top = windows.top_k_per_feature(long, 9, feature_cols=["dim"], sample_col="vec_id", value_col="x")
    return top.select("dim", "rank", F.col("vec_id").alias("sample_index"), F.round("x", 6).alias("value"))


# ---------------------------------------------------------------- evaluation chain

from actlens.functions import columns as FN  # noqa: E402
from actlens.operators import joins as J  # noqa: E402
from actlens.operators.ordering import seeded_key  # noqa: E402

_LAT = C.latents_sql()
_TOP_SQL = f"""
r AS (SELECT feature, vec_id, value, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS rank
      FROM ({_LAT}) WHERE value > 0),
t AS (SELECT * FROM r WHERE rank <= 9),
full_f AS (SELECT feature FROM t GROUP BY feature HAVING count(*) = 9)"""
_PAIRS_SQL = f"""
perm AS (SELECT feature, row_number() OVER (ORDER BY md5('0:' || CAST(feature AS VARCHAR)), feature) - 1 AS i FROM full_f),
mm AS (SELECT count(*) AS m FROM perm),
pairs AS (SELECT least(a.feature, b.feature) AS f1, greatest(a.feature, b.feature) AS f2
          FROM perm a CROSS JOIN mm CROSS JOIN range(1, 100) r(j) JOIN perm b ON b.i = (a.i + r.j) % mm.m
          WHERE 2 * r.j <= mm.m AND NOT (2 * r.j = mm.m AND a.i >= r.j)
          ORDER BY r.j, a.i LIMIT 20)"""


def _reports(spark, sf):
    lat = C.latents(spark, sf)
    top = windows.top_k_per_feature(lat, 9, sample_col="vec_id")
    return lat, top


def _pairs(spark, sf):
    lat, top = _reports(spark, sf)
    return lat, top, J.feature_pairs(top.select("feature"), 20, 0)


@query("joi5_feature_pairs", f"WITH {_TOP_SQL}, {_PAIRS_SQL} SELECT f1, f2 FROM pairs")
def joi5(spark, sf):
    return _pairs(spark, sf)[2]


@query("joi4_exclude_join", f"""
WITH {_TOP_SQL}, {_PAIRS_SQL},
act AS (SELECT DISTINCT feature, vec_id FROM ({_LAT}) WHERE value > 0)
SELECT p.f1, p.f2, a.vec_id FROM pairs p JOIN act a ON a.feature = p.f1
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.feature = p.f1 AND t.vec_id = a.vec_id)
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.feature = p.f2 AND t.vec_id = a.vec_id)
  AND NOT EXISTS (SELECT 1 FROM act o WHERE o.feature = p.f2 AND o.vec_id = a.vec_id)
""")
def joi4(spark, sf):
    lat, top, pairs = _pairs(spark, sf)
    act = lat.where(F.col("value") > 0).select("feature", "vec_id").distinct()
    cand = pairs.join(act.withColumnRenamed("feature", "f1"), on="f1")
    top_sel = top.select(F.col("feature").alias("f1"), "vec_id")
    top_oth = top.select(F.col("feature").alias("f2"), "vec_id")
    act_oth = act.select(F.col("feature").alias("f2"), "vec_id")
    return J.exclude_join(cand, top_sel, keys=["f1", "vec_id"]) \
            .transform(lambda x: J.exclude_join(x, top_oth, keys=["f2", "vec_id"])) \
            .transform(lambda x: J.exclude_join(x, act_oth, keys=["f2", "vec_id"])) \
            .select("f1", "f2", "vec_id")


_PRED_SQL = (f"SELECT r.*, CASE WHEN r1 = 1 THEN idx1 WHEN r2 = 1 THEN idx2 ELSE -1 END AS prediction "
             f"FROM ({C.RATINGS_SQL}) r")


def _predictions(spark, sf):
    r = C.ratings(spark, sf)
    return r.withColumn("prediction", F.when(F.col("r1") == 1, F.col("idx1"))
                        .when(F.col("r2") == 1, F.col("idx2")).otherwise(F.lit(-1)))


@query("joi3_rater_join", f"""
SELECT p.idx1, p.idx2, p.r1, e.r2 FROM (SELECT idx1, idx2, r1 FROM ({C.RATINGS_SQL})
  WHERE idx1 IN (SELECT doc_id FROM documents WHERE lang = 'en')) p
JOIN (SELECT idx1, idx2, r2 FROM ({C.RATINGS_SQL})) e USING (idx1, idx2)
""")
def joi3(spark, sf):
    r = C.ratings(spark, sf)
    en = read_table(spark, sf, "documents").where(F.col("lang") == "en").select(F.col("doc_id").alias("idx1"))
    pred = r.select("idx1", "idx2", "r1").join(en, on="idx1", how="left_semi")
    ev = r.select("idx1", "idx2", "r2")
    return J.rater_join(pred, ev).select("idx1", "idx2", "r1", "r2")


@query("fn4_map_choice", f"""
SELECT idx1, idx2, CASE WHEN prediction = idx1 THEN 1 WHEN prediction = idx2 THEN 2 END AS selection,
       CASE WHEN r1 = truth THEN truth + 1 ELSE CASE WHEN truth + 1 = 1 THEN 2 ELSE 1 END END AS chosen_index
FROM ({_PRED_SQL})
""")
def fn4(spark, sf):
    p = _predictions(spark, sf)
    ci = F.col("truth") + 1
    return p.select("idx1", "idx2", FN.map_choice("prediction", "idx1", "idx2").alias("selection"),
                    FN.choice_from_correct(F.col("r1") == F.col("truth"), ci, F.lit(1), F.lit(2)).alias("chosen_index"))


@query("joi6_sweep_grid", """
SELECT l.layer, s.shuffle, e.n_experts FROM (SELECT DISTINCT label AS layer FROM embeddings) l,
 (SELECT unnest([true, false]) AS shuffle) s, (SELECT unnest([NULL, 8]) AS n_experts) e
""")
def joi6(spark, sf):
    base = read_table(spark, sf, "embeddings").select(F.col("label").alias("layer")).distinct()
    g = J.sweep_grid(base, {"shuffle": [True, False], "n_experts": [None, 8]})
    return g.withColumn("n_experts", F.col("n_experts").cast("int"))


@query("fn1_location_name", """
SELECT DISTINCT label, 'emb/' || CAST(label AS VARCHAR) || '_resid' AS location, 'emb/metadata.json' AS metadata_path
FROM embeddings
""")
def fn1(spark, sf):
    e = read_table(spark, sf, "embeddings").select("label").distinct()
    return e.select("label", FN.location_name(F.lit("emb"), F.col("label").cast("string"), F.lit("resid")).alias("location"),
                    FN.metadata_path(F.lit("emb")).alias("metadata_path"))


CKPT_PATH_SQL = ("'run_' || CAST(user_id AS VARCHAR) || '/' || CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END "
                 "|| CAST(event_id AS VARCHAR) || '.pt'")


def checkpoint_paths(spark, sf):
    ev = read_table(spark, sf, "events")
    stem = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))) \
            .otherwise(F.col("event_id").cast("string"))
    return ev.select("event_id", "user_id",
                     F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit("/"), stem, F.lit(".pt")).alias("path"))


@query("fn2_path_parts", f"""
SELECT event_id, regexp_extract(p, '[^/]*$') AS basename, ends_with(p, '.pt') AS is_pt,
       split_part(regexp_extract(p, '[^/]*$'), '.', 1) AS stem,
       CASE WHEN ends_with(p, '.pt') THEN substr(p, 1, length(p) - 3) || '.json' ELSE p END AS json_path
FROM (SELECT event_id, {CKPT_PATH_SQL} AS p FROM events)
""")
def fn2(spark, sf):
    p = checkpoint_paths(spark, sf)
    return p.select("event_id", FN.basename("path").alias("basename"), FN.has_suffix("path", ".pt").alias("is_pt"),
                    FN.stem("path").alias("stem"), FN.replace_suffix("path", ".pt", ".json").alias("json_path"))


@query("fn2_url_parts", """
SELECT page_id, split_part(url, '/', 3) AS bucket,
       array_to_string(list_slice(string_split(url, '/'), 4, len(string_split(url, '/'))), '/') AS key FROM pages
""")
def fn2_url(spark, sf):
    pg = read_table(spark, sf, "pages").select("page_id", "url")
    return pg.select("page_id", FN.url_bucket("url").alias("bucket"), FN.url_key("url").alias("key"))


@query("fn5_utc_string", f"""
SELECT run, step, strftime(make_timestamp(CAST(round(timestamp * 1e6) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS hr_timestamp
FROM ({C.RUN_LOG_SQL})
""")
def fn5(spark, sf):
    lg = C.run_log(spark, sf)
    return lg.select("run", "step", FN.utc_string("timestamp").alias("hr_timestamp"))
