"""Streaming queries. Input arrives in rounds (one folder per source batch);
after each round the stream runs with AvailableNow from the same checkpoint,
i.e. every round is a restart that must continue exactly where it stopped."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.plans import canonical as C
from actlens.plans.registry import query
from actlens.sources import block_source as BS
from actlens.sources import blocks as B
from actlens.sources.files import io_dir
from actlens.sources.tables import read_table
from actlens.streaming import logs as SL
from actlens.streaming import state as SS
from actlens.streaming.keyed_table import KeyedTable

ACT = C.ACT_SQL


MAX_ROUNDS = 8


def _rounds(df, round_col, base, fmt="parquet"):
    """Deliver the data in at most MAX_ROUNDS arrivals: contiguous ranges of
    ``round_col`` values, in order, one folder each (nothing is dropped)."""
    lo, hi = df.agg(F.min(round_col), F.max(round_col)).first()
    if lo is None:
        return
    span = int(hi) - int(lo) + 1
    rounds = min(MAX_ROUNDS, span)
    r = F.floor((F.col(round_col) - F.lit(int(lo))) * F.lit(rounds) / F.lit(span))
    for i in range(rounds):
        w = df.where(r == i).write.mode("overwrite")
        getattr(w, fmt)(f"{base}/src/round_{i:08d}")
        yield i


def _drive(spark, df, round_col, name, make_stream, *, sink=None, out=None, fmt="parquet", mode="append"):
    base = io_dir(spark, name)
    ckpt = f"{base}/_checkpoint"
    stream = None
    for _ in _rounds(df, round_col, base, fmt):
        if stream is None:
            stream = make_stream(SL.stream_files(spark, f"{base}/src/*", df.schema, fmt=fmt, max_files_per_trigger=None))
        SL.run_available(stream, ckpt, sink=sink(base) if sink else None, path=out(base) if out else None,
                         output_mode=mode, name=f"{name}-{base[-6:]}")
    return base


@query("str1_stream_logs", f"SELECT run, step, event, round(value, 6) AS value, k FROM ({C.RUN_LOG_SQL})")
def str1(spark, sf):
    lg = C.run_log(spark, sf).select("run", "step", "event", "value", "k", "timestamp") \
          .withColumn("part", (F.col("step") > 30).cast("int"))
    base = _drive(spark, lg, "part", "str1", lambda s: s, out=lambda b: f"{b}/sink", fmt="json")
    return spark.read.parquet(f"{base}/sink").select("run", "step", "event", F.round("value", 6).alias("value"), "k")


@query("str2_usage_windows", """
SELECT strftime(make_timestamp((epoch_us(ts) // 30000000) * 30000000), '%Y-%m-%d %H:%M:%S') AS window_start,
       round(avg(value), 6) AS avg_value, round(max(value), 6) AS max_value, count(*) AS n
FROM events GROUP BY 1
""")
def str2(spark, sf):
    ev = read_table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value") \
         .withColumn("week", F.floor(F.unix_date(F.to_date("ts")) / 7))
    base = _drive(spark, ev, "week", "str2", lambda s: SL.usage_windows(s, "ts", ["value"]),
                  sink=lambda b: KeyedTable(spark, f"{b}/sink", ["window"]), mode="update")
    w = KeyedTable(spark, f"{base}/sink", ["window"]).read()
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.round("avg_value", 6).alias("avg_value"), F.round("max_value", 6).alias("max_value"), "n")


def _recut(spark, sf, name, rows):
    a = C.activations(spark, sf).select("vec_id", "sample_id", "pos", "batch_id", "vec")
    holder = {}

    def make_sink(base):
        def emit(units):
            units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
                 .partitionBy("unit_id").parquet(f"{base}/units")
        holder["r"] = holder.get("r") or SS.Recutter(spark, f"{base}/_state", rows, ["sample_id", "pos"], emit)
        holder["base"] = base
        return holder["r"]

    _drive(spark, a, "batch_id", name, lambda s: s, sink=make_sink)
    holder["r"].flush()   # the stream is closed: the short last unit is kept
    return spark.read.parquet(f"{holder['base']}/units")


_UNITS_SQL = """SELECT vec_id, gi // {n} AS unit_id, gi % {n} AS row_in_unit FROM (
 SELECT vec_id, row_number() OVER (ORDER BY batch_id, sample_id, pos) - 1 AS gi FROM ({act}))"""


@query("str3_stream_blocks", _UNITS_SQL.format(n=64, act=ACT))
def str3(spark, sf):
    u = _recut(spark, sf, "str3", 64)
    return u.select("vec_id", F.col("unit_id").cast("bigint"), "row_in_unit")


@query("str3_block_stream", f"SELECT sample_id, pos, dim, round(x, 6) AS x FROM ({C.ACT_LONG_SQL})")
def str3_block_stream(spark, sf):
    """Blocks written in two arrivals through the block source and streamed from it after each."""
    a = C.activations(spark, sf)
    base = io_dir(spark, "str3s")
    meta = {**B.metadata_of(a), "batch_size": 10}
    lo, hi = a.agg(F.min("sample_id"), F.max("sample_id")).first()
    cut = lo + (hi - lo + 1) // 20 * 10                       # whole blocks of ten samples before it
    first = a.where(F.col("sample_id") < cut)
    for rows, block in [(first, 0), (a.where(F.col("sample_id") >= cut), (cut - lo) // 10)]:
        BS.write_run(rows, f"{base}/run", 10 * meta["shape"][1], meta, order_cols=["sample_id", "pos"],
                     first_block=block)
        SL.run_available(BS.stream_run(spark, f"{base}/run"), f"{base}/_checkpoint", path=f"{base}/rows",
                         name=f"str3s-{base[-6:]}")
    return spark.read.parquet(f"{base}/rows") \
                .select("sample_id", "pos", F.posexplode("vec").alias("dim", "x")) \
                .select("sample_id", "pos", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))


@query("str7_stream_rebatch", _UNITS_SQL.format(n=48, act=ACT))
def str7(spark, sf):
    u = _recut(spark, sf, "str7", 48)
    return u.select("vec_id", F.col("unit_id").cast("bigint"), "row_in_unit")


@query("str6_stream_resume", f"SELECT vec_id, batch_id FROM ({ACT})")
def str6(spark, sf):
    a = C.activations(spark, sf).select("vec_id", "batch_id")
    base = _drive(spark, a, "batch_id", "str6", lambda s: s, out=lambda b: f"{b}/sink")
    return spark.read.parquet(f"{base}/sink")


def _latent_rounds(spark, sf):
    return C.latents(spark, sf).select(F.col("vec_id").alias("sample_id"), "batch_id", "feature", "value")


@query("str4_stream_topk", f"""
SELECT feature, CAST(rank AS BIGINT) AS rank, vec_id AS sample_id, round(value, 6) AS value FROM (
 SELECT feature, vec_id, value, row_number() OVER (PARTITION BY feature ORDER BY value DESC, vec_id) AS rank
 FROM ({C.latents_sql()}) WHERE value > 0) WHERE rank <= 9
""")
def str4(spark, sf):
    lat = _latent_rounds(spark, sf)
    base = _drive(spark, lat, "batch_id", "str4", lambda s: SS.stream_topk(s, 9),
                  sink=lambda b: KeyedTable(spark, f"{b}/sink", ["feature"]), mode="update")
    return KeyedTable(spark, f"{base}/sink", ["feature"]).read().select("feature", "rank", "sample_id", F.round("value", 6).alias("value"))


@query("str5_stream_dead", f"""
SELECT feature, max(batch_id) AS last_active FROM ({C.latents_sql()}) WHERE value > 0 GROUP BY feature
""")
def str5(spark, sf):
    lat = _latent_rounds(spark, sf)
    base = _drive(spark, lat, "batch_id", "str5", lambda s: SS.stream_last_active(s),
                  sink=lambda b: KeyedTable(spark, f"{b}/sink", ["feature"]), mode="update")
    return KeyedTable(spark, f"{base}/sink", ["feature"]).read().select("feature", "last_active")
