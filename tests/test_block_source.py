import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.sources import block_source as S
from actlens.sources import blocks as B
from actlens.streaming.logs import run_available

META = {"batch_size": 4, "sequence_length": 5, "d_in": 3, "batches_per_file": 1, "dtype": "float32",
        "shape": [4, 5, 3], "bytes_per_file": 4 * 60}


def _rows(spark, n, first=0):
    vec = F.array(*[(F.col("id") + j).cast("float") for j in range(3)])
    return spark.range(first, first + n).select(F.col("id").alias("k"), vec.alias("vec"))


def _keys(df):
    return sorted((r.block_index, r.sample_id, r.pos, tuple(r.vec)) for r in df.collect())


def test_round_trip_equals_the_reader_of_blocks(spark, tmp_path):
    run = str(tmp_path / "run")
    S.write_run(_rows(spark, 95), run, 20, META, order_cols=["k"])
    assert sorted(os.listdir(run)) == [f"{b:010d}.saved.pt" for b in range(5)] + ["metadata.json"]
    got = S.read_run(spark, run, rangeBytes=50, taskBytes=100)
    assert _keys(got) == _keys(B.read_activation_blocks(spark, run))
    assert [int(v[3][0]) for v in _keys(got)] == list(range(95))
    assert got.rdd.getNumPartitions() > 5                      # ranges of a block go to several tasks
    assert S.read_run(spark, run, startAtToken=41).select("block_index").distinct().count() == 2


def test_filters_on_blocks_prune_tasks(spark, tmp_path):
    run = str(tmp_path / "run")
    S.write_run(_rows(spark, 100), run, 20, META, order_cols=["k"])
    df = S.read_run(spark, run, taskBytes=1)
    assert df.rdd.getNumPartitions() == 5
    for cond, blocks in [("block_index = 3", [3]), ("block_index IN (1, 4, 9)", [1, 4]),
                         ("block_index > 1 AND block_index <= 3 AND pos = 2", [2, 3]),
                         ("block_index >= 4", [4]), ("block_index < 1", [0]), ("block_index = 99", []),
                         ("block_index <> 2", [0, 1, 3, 4]), ("block_index = 1 OR pos = 0", [0, 1, 2, 3, 4])]:
        part = df.where(cond)
        assert sorted({r.block_index for r in part.collect()}) == blocks, cond
    assert df.where("block_index IN (1, 4)").rdd.getNumPartitions() == 2


def test_stream_reads_each_block_once(spark, tmp_path):
    run, base = str(tmp_path / "run"), str(tmp_path)
    for k in range(3):
        S.write_run(_rows(spark, 40, 40 * k), run, 20, META, order_cols=["k"], first_block=2 * k)
        run_available(S.stream_run(spark, run), f"{base}/ck", path=f"{base}/out")
    run_available(S.stream_run(spark, run), f"{base}/ck", path=f"{base}/out")     # nothing new
    assert _keys(spark.read.parquet(f"{base}/out")) == _keys(S.read_run(spark, run))
    os.remove(f"{run}/0000000001.saved.pt")
    S.write_run(_rows(spark, 20), run, 20, META, order_cols=["k"], first_block=9)
    with pytest.raises(Exception, match="must arrive in order and stay"):
        run_available(S.stream_run(spark, run), f"{base}/ck", path=f"{base}/out")


def test_writer_refuses_and_leaves_nothing(spark, tmp_path):
    run = str(tmp_path / "run")
    S.write_run(_rows(spark, 40), run, 20, META, order_cols=["k"])
    before = sorted(os.listdir(run))
    with pytest.raises(Exception, match="written twice or exist"):
        S.write_run(_rows(spark, 20), run, 20, META, order_cols=["k"], first_block=1)
    mixed = spark.createDataFrame([(7, [1.0, 2.0, 3.0]), (7, [1.0])], "block_id LONG, vec ARRAY<FLOAT>").coalesce(1)
    apart = spark.createDataFrame([(7, [1.0]), (8, [1.0]), (7, [1.0])], "block_id LONG, vec ARRAY<FLOAT>").coalesce(1)
    for bad, why in [(mixed, "differ in length"), (apart, "not adjacent")]:
        with pytest.raises(Exception, match=why):
            bad.write.format(S.FORMAT).mode("append").save(run)
    assert [n for n in sorted(os.listdir(run)) if not n.startswith("_")] == before
    S.write_run(_rows(spark, 20), run, 20, META, order_cols=["k"], mode="overwrite")
    assert S.read_run(spark, run).count() == 20


def test_empty_and_odd_runs(spark, tmp_path):
    run = tmp_path / "run"
    run.mkdir()
    (run / "metadata.json").write_text(json.dumps(META))
    assert S.read_run(spark, str(run)).count() == 0
    (run / "0000000000.saved.pt").write_bytes(b"")
    (run / "0000000001.saved.pt").write_bytes(np.arange(60, dtype="<f4").tobytes())
    assert {r.block_index for r in S.read_run(spark, str(run)).collect()} == {1}
    (run / "0000000002.saved.pt").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole rows"):
        S.read_run(spark, str(run)).count()
