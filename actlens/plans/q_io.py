"""Queries of sources and sinks: each writes derived data under the session's
checkpoint folder with a sink and reads it back with the matching source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.functions import columns as FN
from actlens.operators import ordering as O
from actlens.operators import stats as A
from actlens.operators import windows as W
from actlens.plans import canonical as C
from actlens.plans.registry import query
from actlens.sources import block_source as BS
from actlens.sources import blocks as B
from actlens.sources import checkpoints as K
from actlens.sources import logs as L
from actlens.sources import media as MD
from actlens.sources import reports as R
from actlens.sources import sinks as SK
from actlens.session import materialize
from actlens.sources.files import io_dir, remove_folder, write_bytes
from actlens.sources.tables import read_table

ACT = C.ACT_SQL
ALONG = C.ACT_LONG_SQL
LOG = C.RUN_LOG_SQL

# similarity tables on disk at a time: texts of so many tokens, or one of so many parts
SIMILARITY_PART_TOKENS, SIMILARITY_PARTS = 8_000_000, 12


def _run_meta(a, rows_per_block=100):
    meta = B.metadata_of(a)
    meta["batch_size"] = rows_per_block // meta["shape"][1]
    meta["shape"] = [meta["batch_size"], meta["shape"][1], meta["shape"][2]]
    meta["bytes_per_file"] = 4 * meta["batch_size"] * meta["shape"][1] * meta["shape"][2]
    return meta


def _write_run(spark, sf, name, rows_per_block=100):
    a = C.activations(spark, sf)
    run = io_dir(spark, name)
    meta = _run_meta(a, rows_per_block)
    B.write_metadata(spark, run, meta)
    B.write_blocks(a, run, rows_per_block, order_cols=["sample_id", "pos"])
    return run, meta


@query("src1_read_activation_blocks", f"SELECT sample_id, pos, dim, round(x, 6) AS x FROM ({ALONG})")
def src1(spark, sf):
    run, _ = _write_run(spark, sf, "src1")
    rows = B.read_activation_blocks(spark, run)
    return rows.select("sample_id", "pos", F.posexplode("vec").alias("dim", "x")) \
               .select("sample_id", "pos", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("src2_snk3_run_metadata", """
SELECT CAST(10 AS BIGINT) AS batch_size, 'float32' AS dtype, CAST(4 * 10 * 10 * len(any_value(embedding)) AS BIGINT) AS bytes_per_file,
       CAST(1 AS BIGINT) AS batches_per_file, '10,10,' || CAST(len(any_value(embedding)) AS VARCHAR) AS shape,
       CAST(10 AS BIGINT) AS sequence_length, CAST(len(any_value(embedding)) AS BIGINT) AS d_in,
       CAST(10 AS BIGINT) AS samples_per_file FROM embeddings
""")
def src2(spark, sf):
    run, _ = _write_run(spark, sf, "src2")
    m = B.read_run_metadata(spark, run)
    return m.select("batch_size", "dtype", "bytes_per_file", "batches_per_file",
                    F.array_join("shape", ",").alias("shape"), "sequence_length", "d_in", "samples_per_file")


@query("src3_resume_from", f"""
SELECT sample_id, pos FROM ({ACT}) WHERE batch_id >= CAST(ceil(234 / 100.0) AS BIGINT)
""")
def src3(spark, sf):
    run, _ = _write_run(spark, sf, "src3")
    rows = B.read_activation_blocks(spark, run, start_at_token=234)
    return rows.select("sample_id", "pos")


@query("src16_read_block", f"""
SELECT sample_id, pos, dim, round(x, 6) AS x FROM ({ALONG})
WHERE batch_id = (SELECT max(batch_id) // 2 FROM ({ACT}))
""")
def src16(spark, sf):
    run, _ = _write_run(spark, sf, "src16")
    middle = C.activations(spark, sf).agg(F.max("batch_id")).first()[0] // 2
    rows = B.read_activation_blocks(spark, run, block_ids=[middle])
    return rows.select("sample_id", "pos", F.posexplode("vec").alias("dim", "x")) \
               .select("sample_id", "pos", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


def _write_run_as_source(spark, sf, name):
    """The run of ``_write_run``, written through the block data source."""
    a = C.activations(spark, sf)
    run = io_dir(spark, name)
    BS.write_run(a, run, 100, _run_meta(a), order_cols=["sample_id", "pos"])
    return run


@query("src1_block_source", f"SELECT sample_id, pos, dim, round(x, 6) AS x FROM ({ALONG})")
def src1_block_source(spark, sf):
    rows = BS.read_run(spark, _write_run_as_source(spark, sf, "src1s"))
    return rows.select("sample_id", "pos", F.posexplode("vec").alias("dim", "x")) \
               .select("sample_id", "pos", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("src16_block_source", f"""
SELECT sample_id, pos, dim, round(x, 6) AS x FROM ({ALONG})
WHERE batch_id >= (SELECT max(batch_id) // 2 FROM ({ACT}))
""")
def src16_block_source(spark, sf):
    """Blocks from the middle one on; the source opens no other."""
    run = _write_run_as_source(spark, sf, "src16s")
    middle = C.activations(spark, sf).agg(F.max("batch_id")).first()[0] // 2
    rows = BS.read_run(spark, run).where(F.col("block_index") >= F.lit(middle).cast("bigint"))
    return rows.select("sample_id", "pos", F.posexplode("vec").alias("dim", "x")) \
               .select("sample_id", "pos", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("src17_block_count", """
SELECT CAST(label AS VARCHAR) AS layer, CAST(ceil(count(*) / 64.0) AS BIGINT) AS n_blocks FROM embeddings GROUP BY label
""")
def src17(spark, sf):
    a = C.activations(spark, sf)
    base = io_dir(spark, "src17")
    B.write_blocks(a, base, 64, order_cols=["vec_id"], location_cols=["label"])
    listing = spark.read.format("binaryFile").option("pathGlobFilter", B.BLOCK_GLOB) \
                   .option("recursiveFileLookup", "true").load(base).select("path")
    listing = listing.withColumn("layer", F.regexp_extract("path", r"label=([^/]+)/", 1))
    return B.block_count(listing.withColumn("block_id", F.col("path")), ["layer"], "block_id")


@query("snk4_shape_report", f"""
SELECT vec_id // 64 AS batch_id, 'batch_size' AS field, CAST(64 AS BIGINT) AS expected, count(*) AS got
FROM ({ACT}) GROUP BY 1 HAVING count(*) <> 64
""")
def snk4(spark, sf):
    a = C.activations(spark, sf).withColumn("b64", F.expr("vec_id div 64")).withColumn("row", F.col("vec_id"))
    meta = {"batch_size": 64, "d_in": 64}
    rep = B.shape_report(a, meta, batch_col="b64", sample_col="row", pos_col=None)
    return rep.select(F.col("b64").alias("batch_id"), "field", "expected", "got")


@query("snk5_save_mean_std", f"""
SELECT dim, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM ({ALONG}) GROUP BY dim
""")
def snk5(spark, sf):
    a = C.activations(spark, sf)
    run = io_dir(spark, "snk5")
    stats = A.batch_stats(C.activations_long(spark, sf), ["dim"])
    meta = B.save_mean_std(B.metadata_of(a), stats)
    B.write_metadata(spark, run, meta)
    m = B.read_run_metadata(spark, run)
    z = m.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s"))
    return z.select("dim", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"))


@query("snk1_write_activations", f"""
SELECT 'emb' AS run, CAST(label AS VARCHAR) AS layer, 'resid' AS module, count(*) AS n_rows,
       CAST(max(len(embedding)) AS INTEGER) AS d_in FROM embeddings GROUP BY label
""")
def snk1(spark, sf):
    a = C.activations(spark, sf).select(F.lit("emb").alias("run"), F.col("label").cast("string").alias("layer"),
                                        F.lit("resid").alias("module"), "sample_id", "pos", "vec")
    path = io_dir(spark, "snk1")
    SK.write_activations(a, path)
    back = spark.read.parquet(path)
    return back.groupBy("run", F.col("layer").cast("string").alias("layer"), "module").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("vec")).alias("d_in"))


@query("snk11_save_sequence_activations", f"SELECT vec_id, pos FROM ({ACT}) WHERE pos >= 3")
def snk11(spark, sf):
    path = io_dir(spark, "snk11")
    SK.save_sequence_activations(C.activations(spark, sf).select("vec_id", "pos", "vec"), path, 3)
    return spark.read.parquet(path).select("vec_id", "pos")


@query("snk12_discard", "SELECT count(*) AS n_rows FROM lineitem")
def snk12(spark, sf):
    li = read_table(spark, sf, "lineitem")
    SK.discard(li)
    return li.agg(F.count(F.lit(1)).alias("n_rows"))


@query("snk13_skip_existing", "SELECT label, count(*) AS n_rows FROM embeddings GROUP BY label")
def snk13(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    path = io_dir(spark, "snk13")
    SK.skip_existing(e.where(F.col("label") < 5), path, ["label"])   # first job: some locations
    SK.skip_existing(e, path, ["label"])                              # second job: only the missing ones
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- logs

def _write_logs(spark, sf, name):
    path = io_dir(spark, name)
    lg = C.run_log(spark, sf).select("run", "step", "event", "value", "k", "timestamp")
    L.append_lines(lg, L.json_line(lg), path)
    write_bytes(f"{path}/run=-1/broken.json", b'{"event": "x", "value": \n')
    return path


@query("src7_read_run_logs", f"SELECT CAST(run AS VARCHAR) AS run, step, event, round(value, 6) AS value, k FROM ({LOG})")
def src7(spark, sf):
    good, _ = L.read_run_logs(spark, _write_logs(spark, sf, "src7"))
    return good.select("run", "step", "event", F.round("value", 6).alias("value"), "k")


@query("src7_rejects", f"""
SELECT CAST(run AS VARCHAR) AS run, CAST(count(*) AS BIGINT) AS n_bad FROM ({LOG}) WHERE step % 3 = 0 GROUP BY run
UNION ALL SELECT '-1', 1
""")
def src7_rejects(spark, sf):
    path = _write_logs(spark, sf, "src7r")
    # every third row of the log once more, cut off before its end
    cut = C.run_log(spark, sf).where("step % 3 = 0")
    L.append_lines(cut, F.concat(F.lit('{"step": '), F.col("step").cast("string"), F.lit(', "event": "')), path, suffix="txt")
    _, bad = L.read_run_logs(spark, path)
    return bad.groupBy("run").agg(F.count(F.lit(1)).alias("n_bad"))


@query("src8_run_params", f"""
WITH l AS ({LOG}), f AS (SELECT run, event AS param_event, k AS param_k FROM (
 SELECT *, row_number() OVER (PARTITION BY run ORDER BY timestamp, step) AS rn FROM l) WHERE rn = 1)
SELECT CAST(l.run AS VARCHAR) AS run, l.step, round(l.value, 6) AS value, f.param_event, f.param_k FROM l JOIN f USING (run)
""")
def src8(spark, sf):
    good, _ = L.read_run_logs(spark, _write_logs(spark, sf, "src8"))
    p = L.run_params(good, ["event", "k"], metric_cols=["value"])
    return p.select("run", "step", F.round("value", 6).alias("value"), "param_event", "param_k")


@query("src18_runs_by_prefix", f"""
SELECT DISTINCT 'run_' || CAST(run AS VARCHAR) AS run_name FROM ({LOG})
WHERE (starts_with('run_' || CAST(run AS VARCHAR), 'run_1') OR starts_with('run_' || CAST(run AS VARCHAR), 'run_2'))
  AND run IN (SELECT run FROM ({LOG}) WHERE k IS NOT NULL)
""")
def src18(spark, sf):
    lg = C.run_log(spark, sf).withColumn("run_name", F.concat(F.lit("run_"), F.col("run").cast("string")))
    return L.runs_by_prefix(lg, "run_", ["1", "2"], metric="k").select("run_name").distinct()


@query("snk6_append_log", f"""
WITH l AS ({LOG}), n AS (SELECT max(timestamp) + 1 AS now FROM l)
SELECT CAST(run AS VARCHAR) AS run, step, round(CASE WHEN step % 10 = 0 THEN now ELSE timestamp END, 3) AS timestamp,
       strftime(make_timestamp(CAST(round(CASE WHEN step % 10 = 0 THEN now ELSE timestamp END * 1e6) AS BIGINT)),
                '%Y-%m-%d %H:%M:%S') AS hr_timestamp FROM l, n
""")
def snk6(spark, sf):
    lg = C.run_log(spark, sf).select("run", "step", "event", "value",
                                     F.when(F.col("step") % 10 != 0, F.col("timestamp")).alias("timestamp"),
                                     F.lit(None).cast("string").alias("hr_timestamp"))
    now = C.run_log(spark, sf).agg(F.max("timestamp")).first()[0] + 1
    path = io_dir(spark, "snk6")
    L.append_log(lg.where(F.col("step") <= 10), path, now=now)      # first session
    L.append_log(lg.where(F.col("step") > 10), path, now=now)       # the run re-opened: lines appended
    back, _ = L.read_run_logs(spark, path)
    return back.select("run", "step", F.round("timestamp", 3).alias("timestamp"), "hr_timestamp")


@query("snk7_scalar_metrics", f"""
SELECT run, step, metric, round(v, 6) AS value FROM (
 SELECT run, step, 'value' AS metric, value AS v FROM ({LOG}) UNION ALL
 SELECT run, step, 'k' AS metric, CAST(k AS DOUBLE) AS v FROM ({LOG})) WHERE v IS NOT NULL
""")
def snk7(spark, sf):
    m = A.unpivot_metrics(C.run_log(spark, sf), ["run", "step"], ["value", "k"])
    return m.select("run", "step", "metric", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- reports

_TOP = f"""
r AS (SELECT feature, vec_id, value, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS rank
      FROM ({C.latents_sql()}) WHERE value > 0),
t AS (SELECT * FROM r WHERE rank <= 9),
c AS (SELECT feature FROM t GROUP BY feature HAVING count(*) = 9)"""


@query("snk8_src10_feature_reports", f"""
WITH {_TOP} SELECT t.feature, CAST(t.rank AS BIGINT) AS rank, t.vec_id AS index, round(t.value, 6) AS value,
       {C.PATH_SQL} AS path FROM t JOIN c USING (feature)
""")
def snk8(spark, sf):
    lat = C.latents(spark, sf)
    top = W.top_k_per_feature(lat, 9, sample_col="vec_id")
    top = top.select("feature", "rank", F.col("vec_id").alias("sample_index"), "value",
                     C.image_path(F.col("vec_id")).alias("path"))
    path = io_dir(spark, "snk8")
    R.write_feature_reports(top, path, activated=W.activated_samples(lat, sample_col="vec_id"))
    rep = R.read_feature_reports(spark, path, k=9)
    return rep.select("feature", "rank", "index", F.round("value", 6).alias("value"), "path")


@query("src9_read_predictions", f"""
SELECT idx1, idx2, CASE WHEN r1 = 1 THEN idx1 ELSE idx2 END AS prediction FROM ({C.RATINGS_SQL})
""")
def src9(spark, sf):
    r = C.ratings(spark, sf)
    path = io_dir(spark, "src9")
    first = r.select("idx1", "idx2", F.lit(-1).cast("bigint").alias("prediction"), F.lit(0).cast("bigint").alias("seq"))
    last = r.select("idx1", "idx2", F.when(F.col("r1") == 1, F.col("idx1")).otherwise(F.col("idx2")).alias("prediction"),
                    F.lit(1).cast("bigint").alias("seq"))
    first.write.mode("append").json(path)
    last.write.mode("append").json(path)   # a second write of the same keys wins
    return R.read_predictions(spark, path).select("idx1", "idx2", "prediction")


_ANS = ("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'I think the Answer: ' ELSE 'final ANSWER: ' END "
        "|| CAST(1 + quality AS VARCHAR) AS reply, CAST(doc_id % 2 + 1 AS BIGINT) AS truth_index FROM labels")


@query("snk10_src9_evaluations", f"""
SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(doc_id + 1 AS VARCHAR) AS pair_key, doc_id AS idx1, doc_id + 1 AS idx2,
       contains(upper(reply), 'ANSWER: ' || CAST(truth_index AS VARCHAR)) AS correct, truth_index AS selected_index,
       truth_index AS correct_index FROM ({_ANS})
""")
def snk10(spark, sf):
    from actlens.plans.q_statistics import answers
    a = answers(spark, sf)
    detail = a.select(F.col("doc_id").alias("idx1"), (F.col("doc_id") + 1).alias("idx2"),
                      FN.parse_answer("reply", F.col("truth_index")).alias("correct"),
                      F.col("truth_index").cast("bigint").alias("selected_index"),
                      F.col("truth_index").cast("bigint").alias("correct_index"), F.lit(0).cast("bigint").alias("seq"))
    path = io_dir(spark, "snk10")
    R.write_evaluations(detail, path, total_time=0.0)
    return R.read_evaluations(spark, path).select("pair_key", "idx1", "idx2", "correct", "selected_index", "correct_index")


@query("snk10_summary", f"""
SELECT round(avg(CAST(contains(upper(reply), 'ANSWER: ' || CAST(truth_index AS VARCHAR)) AS DOUBLE)), 6) AS mean_correctness,
       count(*) AS all_pairs FROM ({_ANS})
""")
def snk10_summary(spark, sf):
    from actlens.plans.q_statistics import answers
    a = answers(spark, sf)
    detail = a.select(F.col("doc_id").alias("idx1"), (F.col("doc_id") + 1).alias("idx2"),
                      FN.parse_answer("reply", F.col("truth_index")).alias("correct"),
                      F.col("truth_index").cast("bigint").alias("selected_index"),
                      F.col("truth_index").cast("bigint").alias("correct_index"), F.lit(0).cast("bigint").alias("seq"))
    path = io_dir(spark, "snk10s")
    R.write_evaluations(detail, path)
    s = spark.read.json(f"{path}/summary")
    return s.select(F.round("mean_correctness", 6).alias("mean_correctness"), F.col("all_pairs").cast("bigint"))


@query("src11_zip_sidecars", f"SELECT vec_id, feature, round(value, 6) AS value, {C.PATH_SQL} AS path FROM ({C.latents_sql()})")
def src11(spark, sf):
    lat = C.latents(spark, sf)
    a = C.activations(spark, sf)
    base = io_dir(spark, "src11")
    # value parts and path parts are written as separate files per batch (one write each,
    # partitioned by batch); the pairing only uses the batch number in the file path
    lat.select("batch_id", (F.col("vec_id") % 100).alias("row_in_file"), "feature", "value") \
       .write.partitionBy("batch_id").parquet(f"{base}/latents")
    a.select("batch_id", (F.col("vec_id") % 100).alias("row_in_file"), C.image_path(F.col("vec_id")).alias("path")) \
     .write.partitionBy("batch_id").json(f"{base}/file_paths")
    values = spark.read.parquet(f"{base}/latents").drop("batch_id").withColumn("_file", F.col("_metadata.file_path"))
    names = spark.read.json(f"{base}/file_paths").drop("batch_id").withColumn("_file", F.col("_metadata.file_path"))
    z = R.zip_sidecars(values, names, key_pattern=r"batch_id=(\d+)/")
    return z.select((F.col("batch_key") * 100 + F.col("row_in_file")).alias("vec_id"), "feature",
                    F.round("value", 6).alias("value"), "path")


@query("src15_read_cosine_tables", f"""
SELECT layer, strategy, count(*) AS n, round(sum(cos), 4) AS cos_sum FROM ({C.SIMILARITY_SQL}) GROUP BY layer, strategy
""")
def src15(spark, sf):
    # the tables of all texts take several times the input (three cosines a token and strategy), so
    # they are written and read in parts, and those of a part removed when its sums are stored
    parts = C.similarity_series(spark, sf, SIMILARITY_PART_TOKENS, SIMILARITY_PARTS)
    sums = []
    for sim in parts:
        # one line per (layer, text): {layer, text, cos: {strategy: [cos by position]}}; a line is one document
        lines = sim.select("layer", F.col("doc_id").alias("text"), F.create_map(
            F.lit("own"), F.col("own"), F.lit("next"), F.col("next"), F.lit("const"), F.col("const")).alias("cos"))
        path = io_dir(spark, "src15")
        lines.write.json(path, compression="gzip")
        t = R.read_cosine_tables(spark, path).groupBy("layer", "strategy") \
            .agg(F.count(F.lit(1)).alias("n"), F.sum("cos").alias("cos_sum"))
        if len(parts) > 1:
            t = materialize(t, "cosine-sums")
            remove_folder(spark, path)
        sums.append(t)
    t = sums[0] if len(parts) == 1 else reduce(DataFrame.unionByName, sums).groupBy("layer", "strategy") \
        .agg(F.sum("n").alias("n"), F.sum("cos_sum").alias("cos_sum"))
    return t.select("layer", "strategy", "n", F.round("cos_sum", 4).alias("cos_sum"))


# ---------------------------------------------------------------- media

@query("src4_src5_read_image_folder", """
SELECT 'img/' || CAST(vec_id % 10 AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.jpg' AS rel_path,
       CAST(3 + 4 * len(embedding) AS BIGINT) AS length FROM embeddings WHERE label <> 3
""")
def src4(spark, sf):
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    root = io_dir(spark, "src4")
    e = read_table(spark, sf, "embeddings").select("vec_id", "label", "embedding")

    def write(batches):
        for b in batches:
            for vid, lab, emb in zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(),
                                     b.column("embedding").to_pylist()):
                head = b"\x00\x00\x00" if lab == 3 else MD.JPEG_MAGIC   # label 3: not a JPEG
                write_bytes(f"{root}/{vid % 10}/{vid}.jpg", head + np.asarray(emb, "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    e.mapInArrow(write, T.StructType([T.StructField("n", T.LongType())])).count()
    good, _ = MD.read_image_folder(spark, root)
    return good.select(F.regexp_extract("path", r"(\d+/\d+\.jpg)$", 1).alias("p"), "length") \
               .select(F.concat(F.lit("img/"), F.col("p")).alias("rel_path"), F.col("length").cast("bigint"))


@query("src6_read_url_list", "SELECT url, min(substr(html, 1, 80)) AS caption FROM pages GROUP BY url")
def src6(spark, sf):
    pg = read_table(spark, sf, "pages").select(F.col("url").alias("URL"), F.substring("html", 1, 80).alias("TEXT"))
    path = io_dir(spark, "src6")
    pg.write.parquet(path)
    return MD.read_url_list(spark, path)


# ---------------------------------------------------------------- checkpoints

@query("src13_checkpoint_catalogue", f"""
SELECT run, max_by(p, n) AS best_path, max(n) AS token_count FROM (
 SELECT 'run_' || CAST(user_id AS VARCHAR) AS run, {__import__('actlens.plans.q_interpret', fromlist=['x']).CKPT_PATH_SQL} AS p,
        TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END || CAST(event_id AS VARCHAR) AS BIGINT) AS n FROM events)
WHERE n > 0 GROUP BY run
""")
def src13(spark, sf):
    from actlens.plans.q_interpret import checkpoint_paths
    p = checkpoint_paths(spark, sf).select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run"), "path")
    return K.checkpoint_catalogue(p, group_cols=["run"])


@query("snk9_src14_checkpoint_roundtrip", f"""
SELECT 'enc' AS param, CAST(vec_id AS INTEGER) AS row, CAST(u.i - 1 AS INTEGER) AS dim, round(CAST(e.embedding[u.i] AS DOUBLE), 6) AS x
FROM embeddings e, LATERAL (SELECT unnest(range(1, len(e.embedding) + 1)) AS i) u WHERE e.vec_id < 32
""")
def snk9(spark, sf):
    d = C.dictionary(spark, sf)
    params = K.params_frame(spark, {"enc": d.enc, "pre_b": d.pre_b})
    base = io_dir(spark, "snk9")
    path = K.save_checkpoint(spark, base, "fixture", 1000, params, {"token_count": 1000, "dead_latents": [0] * 32})
    back, state = K.load_checkpoint(spark, path)
    if state["token_count"] != 1000:
        raise ValueError("state did not round-trip")
    return back.where(F.col("param") == "enc").select("param", "row", F.posexplode("vec").alias("dim", "x")) \
               .select("param", "row", "dim", F.round("x", 6).alias("x"))
