"""Queries of projections, ordering, batching, shuffles, limits and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.operators import ordering as O
from actlens.operators import sets as S
from actlens.operators import shape as P
from actlens.plans import canonical as C
from actlens.plans.registry import query
from actlens.sources.tables import read_table

ACT = C.ACT_SQL
ALONG = C.ACT_LONG_SQL


@query("prj1_flatten_positions", f"""
SELECT sample_id, pos, dim, round(x, 6) AS x FROM ({ALONG}) WHERE dim < 32
""")
def prj1(spark, sf):
    seqs = P.to_sequences(C.activations(spark, sf))
    flat = P.flatten_positions(seqs, d_in=32)
    return flat.select("sample_id", "pos", F.posexplode("vec").alias("dim", "x")) \
               .select("sample_id", F.col("pos").cast("int").alias("pos"), "dim",
                       F.round(F.col("x").cast("double"), 6).alias("x"))


@query("prj2_skip_first", f"""
SELECT vec_id, sample_id, CAST(pos - 2 AS INTEGER) AS pos FROM ({ACT}) WHERE pos >= 2
""")
def prj2(spark, sf):
    return P.skip_first(C.activations(spark, sf), 2).select("vec_id", "sample_id", "pos")


@query("prj3_split_token_id", f"""
SELECT vec_id, CAST(vec_id % 50 AS BIGINT) AS token_id, CAST(len(vec) AS INTEGER) AS n_dims,
       round(CAST(vec[1] AS DOUBLE), 6) AS first_x FROM ({ACT})
""")
def prj3(spark, sf):
    a = C.activations(spark, sf)
    a = a.withColumn("vec", F.concat("vec", F.array((F.col("vec_id") % 50).cast("float"))))
    s = P.split_token_id(a)
    return s.select("vec_id", "token_id", F.size("vec").alias("n_dims"),
                    F.round(F.col("vec")[0].cast("double"), 6).alias("first_x"))


@query("prj4_cls_only", f"SELECT vec_id, sample_id FROM ({ACT}) WHERE pos = 0")
def prj4(spark, sf):
    return P.cls_only(C.activations(spark, sf)).select("vec_id", "sample_id")


@query("prj5_first_features", f"""
SELECT vec_id, feature, round(value, 6) AS value FROM ({C.latents_sql()}) WHERE feature < 16
""")
def prj5(spark, sf):
    return P.first_features(C.latents(spark, sf), 16).select(
        "vec_id", "feature", F.round("value", 6).alias("value"))


@query("prj6_to_long", f"SELECT vec_id, dim AS feature, round(x, 6) AS value FROM ({ALONG})")
def prj6(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return P.to_long(e, ["vec_id"], "embedding").select(
        "vec_id", "feature", F.round("value", 6).alias("value"))


@query("prj7_long_texts", """
SELECT doc_id, n_chars FROM documents WHERE length(text) > 6000 ORDER BY doc_id LIMIT 50
""")
def prj7(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    return P.long_texts(d, 6000, 50).select("doc_id", "n_chars")


@query("prj8_mask_rows", f"SELECT vec_id FROM ({ACT}) WHERE label <> 3")
def prj8(spark, sf):
    return P.mask_rows(C.activations(spark, sf), F.col("label") != 3).select("vec_id")


@query("prj9_events", f"""
SELECT run, step, round(value, 6) AS value FROM ({C.RUN_LOG_SQL}) WHERE event = 'purchase' AND value IS NOT NULL
""")
def prj9(spark, sf):
    return P.select_events(C.run_log(spark, sf), "purchase", "value").select(
        "run", "step", F.round("value", 6).alias("value"))


@query("prj10_text_contains", "SELECT doc_id FROM documents WHERE contains(text, 'ther')")
def prj10(spark, sf):
    return P.text_contains(read_table(spark, sf, "documents"), "ther").select("doc_id")


@query("prj11_threshold_report", f"""
SELECT run, step, round_even(value * k, 0) AS rate, round_even(value * 1e6 / 1048576, 2) AS bytes_mib
FROM ({C.RUN_LOG_SQL}) WHERE value * k > 800
""")
def prj11(spark, sf):
    lg = C.run_log(spark, sf).select("run", "step", (F.col("value") * F.col("k")).alias("rate"),
                                     (F.col("value") * F.lit(1e6)).alias("bytes"))
    r = P.threshold_report(lg, "rate", 800, ["bytes"])
    return r.select("run", "step", "rate", "bytes_mib")


@query("prj12_range_filter", f"""
SELECT run, step, k FROM ({C.RUN_LOG_SQL})
WHERE k > 3 AND k < 60 AND (k % 10) IS NOT NULL AND (k % 10) NOT IN (4, 2)
""")
def prj12(spark, sf):
    lg = C.run_log(spark, sf).withColumn("k_class", F.col("k") % 10)
    r = P.range_filter(lg, "k", 3, 60).where(P.not_in_nullsafe("k_class", [4, 2]))
    return r.select("run", "step", "k")


@query("prj13_pad_or_cut", f"""
WITH d AS (SELECT doc_id FROM documents WHERE length(text) > 6000 ORDER BY doc_id LIMIT 50),
t AS (SELECT * FROM ({C.DOC_TOKENS_SQL}) WHERE doc_id IN (SELECT doc_id FROM d) AND pos < 512)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_tokens, max_by(token, pos) AS last_token FROM t GROUP BY doc_id
""")
def prj13(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    longd = P.long_texts(d, 6000, 50)
    toks = longd.select("doc_id", F.filter(F.split("text", C.WHITESPACE), lambda t: t != "").alias("tokens"))
    cut = P.pad_or_cut(toks, 512)
    return cut.select("doc_id", F.size("tokens").alias("n_tokens"),
                      F.element_at("tokens", -1).alias("last_token"))


@query("prj14_sample_slice", f"""
SELECT vec_id, dim, round(x, 6) AS x FROM ({ALONG}) WHERE vec_id < 64 AND dim < 8
""")
def prj14(spark, sf):
    s = P.sample_slice(C.activations(spark, sf), 64, 8, ["sample_id", "pos"])
    return s.select("vec_id", F.posexplode("vec").alias("dim", "x")) \
            .select("vec_id", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


# ---------------------------------------------------------------- ordering

@query("pre1_global_index", """
SELECT l_orderkey, l_linenumber,
       CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS BIGINT) AS global_index
FROM lineitem
""")
def pre1(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return O.global_index(li, ["l_orderkey", "l_linenumber"])


@query("pre1_global_index_docs", """
SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY lang, doc_id) - 1 AS BIGINT) AS global_index
FROM documents
""")
def pre1_docs(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return O.global_index(d, ["lang", "doc_id"])


@query("bat1_rebatch", """
SELECT l_orderkey, l_linenumber, gi // 1000 AS batch_id, gi % 1000 AS row_in_batch FROM (
 SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS gi FROM lineitem)
""")
def bat1(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return O.rebatch(li, 1000, ["l_orderkey", "l_linenumber"])


@query("bat1_rebatch_vectors", f"""
SELECT vec_id, gi // 7 AS batch_id, gi % 7 AS row_in_batch FROM (
 SELECT vec_id, row_number() OVER (ORDER BY sample_id, pos) - 1 AS gi FROM ({ACT}))
""")
def bat1_vec(spark, sf):
    a = C.activations(spark, sf).select("vec_id", "sample_id", "pos")
    return O.rebatch(a, 7, ["sample_id", "pos"]).select("vec_id", "batch_id", "row_in_batch")


@query("bat2_rebatch_per_file", f"""
SELECT vec_id, batch_id AS file_id, (vec_id % 100) // 32 AS batch_in_file FROM (
 SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM ({ACT}))
WHERE (vec_id % 100) // 32 < n // 32
""")
def bat2(spark, sf):
    a = C.activations(spark, sf).withColumn("row_in_file", F.col("vec_id") % 100)
    r = O.rebatch_per_file(a, 32, "batch_id", "row_in_file")
    return r.select("vec_id", F.col("batch_id").alias("file_id"), "batch_in_file")


_BATCH32 = f"SELECT vec_id, (row_number() OVER (ORDER BY sample_id, pos) - 1) // 32 AS batch_id FROM ({ACT})"


@query("bat3_stop_after", f"SELECT vec_id, batch_id FROM ({_BATCH32}) WHERE batch_id < 8")
def bat3(spark, sf):
    a = C.activations(spark, sf).select("vec_id", "sample_id", "pos")
    b = O.rebatch(a, 32, ["sample_id", "pos"])
    return O.stop_after(b, 250, 32).select("vec_id", "batch_id")


@query("bat4_sample_cap", f"SELECT vec_id, batch_id FROM ({_BATCH32}) WHERE batch_id <= 8")
def bat4(spark, sf):
    a = C.activations(spark, sf).select("vec_id", "sample_id", "pos")
    b = O.rebatch(a, 32, ["sample_id", "pos"])
    return O.sample_cap(b, 250, 32).select("vec_id", "batch_id")


@query("bat5_row_cap", f"""
WITH c AS (SELECT batch_id, count(*) AS n FROM ({ACT}) GROUP BY batch_id),
k AS (SELECT batch_id FROM (SELECT batch_id, coalesce(sum(n) OVER (ORDER BY batch_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) WHERE before <= 200)
SELECT vec_id, batch_id FROM ({ACT}) WHERE batch_id IN (SELECT batch_id FROM k)
""")
def bat5(spark, sf):
    return O.row_cap(C.activations(spark, sf), 200).select("vec_id", "batch_id")


_SHUF_KEY = "md5('42:' || CAST(vec_id AS VARCHAR))"


@query("shf1_shuffle_write", f"""
SELECT vec_id, shuffle_key, gi // 32 AS batch_id FROM (
 SELECT vec_id, {_SHUF_KEY} AS shuffle_key,
        row_number() OVER (ORDER BY {_SHUF_KEY}, vec_id) - 1 AS gi FROM ({ACT}))
""")
def shf1(spark, sf):
    a = C.activations(spark, sf).select("vec_id")
    b = O.shuffle_batches(a, ["vec_id"], 42, 32, keep_tail=True)
    return b.select("vec_id", "shuffle_key", "batch_id")


@query("shf2_shuffle_read_bounded", f"""
WITH s AS (SELECT vec_id, (row_number() OVER (ORDER BY sample_id, pos) - 1) // 128 AS win,
           {_SHUF_KEY} AS shuffle_key FROM ({ACT})),
g AS (SELECT vec_id, row_number() OVER (ORDER BY win, shuffle_key, vec_id) - 1 AS gi FROM s)
SELECT vec_id, gi // 32 AS batch_id FROM g WHERE gi // 32 < (SELECT count(*) FROM s) // 32
""")
def shf2(spark, sf):
    a = C.activations(spark, sf).select("vec_id", "sample_id", "pos")
    b = O.shuffle_batches(a, ["vec_id"], 42, 32, keep_tail=False, buffer_rows=128,
                          index_cols=["sample_id", "pos"])
    return b.select("vec_id", "batch_id")


@query("shf3_seeded_key", f"""
SELECT vec_id, md5('0:' || CAST(vec_id AS VARCHAR)) AS key0, md5('3:' || CAST(vec_id AS VARCHAR)) AS key3
FROM embeddings
""")
def shf3(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id")
    return e.select("vec_id", O.seeded_key(["vec_id"], 0).alias("key0"),
                    O.seeded_key(["vec_id"], 3).alias("key3"))


@query("shf4_hash_shard", f"""
SELECT vec_id, CAST(list_reduce(list_transform(string_split(sha1({C.PATH_SQL}), ''),
       lambda d: strpos('0123456789abcdef', d) - 1), lambda a, d: (a * 16 + d) % 7) AS INTEGER) AS shard
FROM embeddings
""")
def shf4(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id")
    return e.select("vec_id", O.hash_shard(C.image_path(F.col("vec_id")), 7).alias("shard"))


@query("src12_take_first", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def src12(spark, sf):
    return O.take_first(read_table(spark, sf, "documents").select("doc_id", "lang"), 100, ["doc_id"])


@query("srt1_sort_by", f"""
SELECT run, round(mean_value, 6) AS mean_value,
       CAST(row_number() OVER (ORDER BY mean_value DESC, run) AS BIGINT) AS sort_rank
FROM (SELECT run, avg(value) AS mean_value FROM ({C.RUN_LOG_SQL}) GROUP BY run)
""")
def srt1(spark, sf):
    s = C.run_log(spark, sf).groupBy("run").agg(F.avg("value").alias("mean_value"))
    s = s.withColumn("_neg", -F.col("mean_value"))
    r = O.running_index(s, ["_neg", "run"], name="sort_rank", base=1)
    return r.select("run", F.round("mean_value", 6).alias("mean_value"), "sort_rank")


@query("top1_topk_dims", f"""
WITH l AS ({ALONG}),
hi AS (SELECT vec_id, 'largest' AS which, dim, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) AS rank FROM l),
lo AS (SELECT vec_id, 'smallest' AS which, dim, x, row_number() OVER (PARTITION BY vec_id ORDER BY x, dim) AS rank FROM l)
SELECT vec_id, which, CAST(rank AS BIGINT) AS rank, dim, round(x, 6) AS x FROM hi WHERE rank <= 3
UNION ALL
SELECT vec_id, which, CAST(rank AS BIGINT) AS rank, dim, round(x, 6) AS x FROM lo WHERE rank <= 3
""")
def top1(spark, sf):
    from actlens.operators.stats import topk_dims
    rows = C.activations(spark, sf)
    hi = topk_dims(rows, 3, largest=True, key_cols=["vec_id"]).withColumn("which", F.lit("largest"))
    lo = topk_dims(rows, 3, largest=False, key_cols=["vec_id"]).withColumn("which", F.lit("smallest"))
    return hi.unionByName(lo).select("vec_id", "which", "rank", "dim", F.round("x", 6).alias("x"))


@query("top2_topn_groups", f"""
SELECT k % 20 AS setting, round(avg(value), 6) AS mean_value FROM ({C.RUN_LOG_SQL})
GROUP BY k % 20 ORDER BY avg(value) DESC, setting LIMIT 8
""")
def top2(spark, sf):
    g = C.run_log(spark, sf).groupBy((F.col("k") % 20).alias("setting")).agg(F.avg("value").alias("m"))
    t = O.top_n(g, 8, [F.col("m").desc(), F.col("setting")])
    return t.select("setting", F.round("m", 6).alias("mean_value"))


@query("tail1_last_n", f"""
SELECT run, round(avg(value), 6) AS value_last10 FROM (
 SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM ({C.RUN_LOG_SQL}))
WHERE rn <= 10 GROUP BY run
""")
def tail1(spark, sf):
    t = O.last_n_mean(C.run_log(spark, sf), ["run"], "step", ["value"], 10)
    return t.select("run", F.round("value_last10", 6).alias("value_last10"))


# --------------------------------------------------------------------- sets

@query("set1_vocabulary", f"SELECT token, token_id FROM ({C.VOCAB_SQL})")
def set1(spark, sf):
    return C.vocabulary(spark, sf)


@query("set2_common_keys", """
SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'
""")
def set2(spark, sf):
    lab = read_table(spark, sf, "labels")
    docs = read_table(spark, sf, "documents").where(F.col("lang") == "en")
    return S.common_keys(lab, docs, ["doc_id"])


@query("set3_except_ids", f"""
WITH lat AS ({C.latents_sql()}),
top AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS r
        FROM lat WHERE value > 0) WHERE r <= 9)
SELECT DISTINCT vec_id FROM lat WHERE value > 0 AND vec_id NOT IN (SELECT vec_id FROM top)
""")
def set3(spark, sf):
    from actlens.operators import windows
    lat = C.latents(spark, sf)
    act = lat.where(F.col("value") > 0)
    top = windows.top_k_per_feature(lat, 9, sample_col="vec_id", require_full=False)
    return S.except_ids(act, top, ["vec_id"])


@query("set4_append_batches", "SELECT doc_id, lang FROM documents")
def set4(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return S.append_batches(d.where(F.col("lang") == "en"), d.where(F.col("lang") != "en"))
