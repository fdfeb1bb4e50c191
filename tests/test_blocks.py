import json
import math
import os

import numpy as np
import pytest

from actlens.sources import blocks as B


def _write_run(root, blocks, meta):
    os.makedirs(root, exist_ok=True)
    with open(os.path.join(root, "metadata.json"), "w") as f:
        json.dump(meta, f)
    for i, arr in enumerate(blocks):
        with open(os.path.join(root, f"file_{i:04d}.saved.pt"), "wb") as f:
            f.write(np.ascontiguousarray(arr, dtype="<f4").tobytes())


META = {"batch_size": 32, "sequence_length": 16, "d_in": 9, "batches_per_file": 1,
        "dtype": "torch.float32", "shape": [32, 16, 9], "bytes_per_file": 32 * 16 * 9 * 4}


def test_block_round_trip_bits(spark, tmp_path):
    arr = np.random.default_rng(0).standard_normal((2, 16, 16)).astype("<f4")
    meta = {"batch_size": 2, "sequence_length": 16, "d_in": 16, "batches_per_file": 1,
            "dtype": "float32", "shape": [2, 16, 16], "bytes_per_file": arr.nbytes}
    _write_run(str(tmp_path), [arr], meta)
    rows = B.read_activation_blocks(spark, str(tmp_path)).orderBy("sample_id", "pos").collect()
    got = np.array([r.vec for r in rows], dtype="<f4").reshape(2, 16, 16)
    assert got.tobytes() == arr.tobytes()


def test_resume_skips_whole_files(spark, tmp_path):
    blocks = [np.full((32, 16, 9), i, dtype="<f4") for i in range(3)]
    _write_run(str(tmp_path), blocks, META)
    rows = B.read_activation_blocks(spark, str(tmp_path), start_at_token=2 * 512)
    vals = {float(r.vec[0]) for r in rows.collect()}
    assert vals == {2.0}
    assert rows.count() == 32 * 16


def test_empty_run_and_listing(spark, tmp_path):
    _write_run(str(tmp_path), [], META)
    assert B.list_blocks(spark, str(tmp_path)).count() == 0


def test_many_tiny_blocks_all_listed(spark, tmp_path):
    meta = {"batch_size": 1, "sequence_length": 1, "d_in": 1, "batches_per_file": 1, "dtype": "float32",
            "shape": [1, 1, 1], "bytes_per_file": 4}
    _write_run(str(tmp_path), [np.full((1, 1, 1), i, dtype="<f4") for i in range(1050)], meta)
    rows = B.read_activation_blocks(spark, str(tmp_path)).collect()
    assert len(rows) == 1050
    assert sorted(float(r.vec[0]) for r in rows) == [float(i) for i in range(1050)]


def test_write_blocks_exact_size_and_values(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.range(100).select(F.col("id").alias("k"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    res = B.write_blocks(df, str(tmp_path), 30, order_cols=["k"], keep_partial=False).collect()
    assert sorted(r.n_rows for r in res) == [30, 30, 30]
    res2 = B.write_blocks(df, str(tmp_path / "p"), 30, order_cols=["k"], keep_partial=True).collect()
    assert sorted(r.n_rows for r in res2) == [10, 30, 30, 30]
    data = open(str(tmp_path / "0000000001.saved.pt"), "rb").read()
    arr = np.frombuffer(data, "<f4").reshape(-1, 2)
    assert arr[0, 0] == 30.0 and arr.shape == (30, 2)


def test_metadata_of_and_rank_error(spark):
    from pyspark.sql import functions as F
    df = spark.range(64).select((F.col("id") / 16).cast("long").alias("sample_id"), (F.col("id") % 16).cast("int").alias("pos"),
                                F.lit(0).alias("batch_id"), F.array_repeat(F.lit(1.0).cast("float"), 9).alias("vec"))
    m = B.metadata_of(df)
    assert m["shape"] == [4, 16, 9] and m["sequence_length"] == 16 and m["bytes_per_file"] == 4 * 4 * 16 * 9
    m2 = B.metadata_of(df, pos_col=None)
    assert m2["shape"] == [4, 9] and "sequence_length" not in m2


def test_metadata_without_sequence_length_defaults(spark, tmp_path):
    meta = {"batch_size": 4, "d_in": 3, "batches_per_file": 2, "dtype": "float32", "shape": [4, 3], "bytes_per_file": 96}
    B.write_metadata(spark, str(tmp_path), meta)
    r = B.read_run_metadata(spark, str(tmp_path)).first()
    assert r.sequence_length == 1 and r.samples_per_file == 8


def test_unsupported_dtype(spark):
    with pytest.raises(ValueError):
        B.metadata_of(spark.range(1).selectExpr("0 as batch_id", "0 as sample_id", "0 as pos", "array(1.0) as vec"),
                      dtype="int8")


def test_read_single_block_by_id(spark, tmp_path):
    blocks = [np.full((32, 16, 9), i, dtype="<f4") for i in range(3)]
    _write_run(str(tmp_path), blocks, META)
    rows = B.read_activation_blocks(spark, str(tmp_path), block_ids=[1]).collect()
    assert len(rows) == 32 * 16 and {float(r.vec[0]) for r in rows} == {1.0}
    assert min(r.sample_id for r in rows) == 32


def test_ranges_read_the_same_rows(spark, tmp_path):
    """Ranges of a few rows, several locations, a partial last block; nothing but ranges is shuffled."""
    v = np.arange(100 * 3, dtype=np.float32).reshape(100, 3)
    df = spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(v)], "k BIGINT, loc INT, vec ARRAY<FLOAT>")
    res = B.write_blocks(df, str(tmp_path), 16, order_cols=["k"], location_cols=["loc"])
    assert sorted(r.n_rows for r in res.collect()) == [2, 2] + [16] * 6
    meta = {"dtype": "float32", "shape": [16, 3], "batches_per_file": 1, "batch_size": 16}
    whole = sorted(tuple(map(str, r)) for r in B.read_activation_blocks(spark, str(tmp_path), meta=meta).collect())
    parts = B.read_activation_blocks(spark, str(tmp_path), meta=meta, range_bytes=60)
    assert sorted(tuple(map(str, r)) for r in parts.collect()) == whole
    got = sorted((r.block_index, r.sample_id, tuple(r.vec)) for r in parts.collect())
    order = list(range(0, 100, 2)) + list(range(1, 100, 2))
    assert [g[2] for g in got] == [tuple(v[i]) for i in order]
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "content" not in plan
    with pytest.raises(Exception, match="no whole rows"):
        B.read_activation_blocks(spark, str(tmp_path), meta={**meta, "shape": [16, 5]}).collect()


def test_shape_report_short_vector_and_dtype(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [1.0]), (1, 0, [1.0, 2.0]), (1, 1, [3.0, 4.0])],
                               "batch_id INT, sample_id INT, vec ARRAY<DOUBLE>")
    meta = {"batch_size": 2, "d_in": 2, "dtype": "float32"}
    got = sorted(tuple(r) for r in B.shape_report(df, meta, pos_col=None).collect())
    assert got == [(0, "d_in", 2, 1), (0, "element_bytes", 4, 8), (1, "element_bytes", 4, 8)]
