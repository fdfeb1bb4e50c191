from pyspark.sql import functions as F

from actlens.streaming import logs as SL
from actlens.streaming import state as SS
from actlens.streaming.keyed_table import KeyedTable


def test_stream_topk_and_recut(spark, tmp_path):
    base = str(tmp_path)
    schema = "sample_id BIGINT, batch_id BIGINT, feature INT, value DOUBLE"
    rows = [(s, s // 10, s % 3, float((s * 37) % 11) - 2) for s in range(40)]
    df = spark.createDataFrame(rows, schema)
    stream = None
    for b in range(4):
        df.where(F.col("batch_id") == b).write.parquet(f"{base}/src/round_{b:04d}")
        if stream is None:
            stream = SS.stream_topk(SL.stream_files(spark, f"{base}/src/*", df.schema, max_files_per_trigger=None), 3)
        SL.run_available(stream, f"{base}/ck", sink=KeyedTable(spark, f"{base}/sink", ["feature"]), output_mode="update")
    out = KeyedTable(spark, f"{base}/sink", ["feature"]).read()
    got = sorted(tuple(r) for r in out.select("feature", "rank", "sample_id").collect())
    expect = []
    for f in range(3):
        cand = sorted([(-v, s) for s, _, ff, v in rows if ff == f and v > 0])[:3]
        expect += [(f, i + 1, s) for i, (_, s) in enumerate(cand)]
    assert got == sorted(expect)


def test_recutter_exactly_once(spark, tmp_path):
    base = str(tmp_path)
    df = spark.range(95).select(F.col("id").alias("k"), (F.col("id") / 20).cast("long").alias("batch_id"))

    def emit(units):
        units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("unit_id").parquet(f"{base}/units")

    r = SS.Recutter(spark, f"{base}/state", 30, ["k"], emit)
    stream = None
    for b in range(5):
        df.where(F.col("batch_id") == b).write.parquet(f"{base}/src/round_{b:04d}")
        if stream is None:
            stream = SL.stream_files(spark, f"{base}/src/*", df.schema, max_files_per_trigger=None)
        SL.run_available(stream, f"{base}/ck", sink=r)
    r(df.where(F.col("batch_id") == 4), 4)          # a replayed micro-batch rewrites the same files
    r.flush()
    u = spark.read.parquet(f"{base}/units").toPandas()
    assert sorted(u.k) == list(range(95))
    assert list(u.groupby("unit_id").size().sort_index()) == [30, 30, 30, 5]
    assert all(u.k == u.unit_id * 30 + u.row_in_unit)
