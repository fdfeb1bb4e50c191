import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.functions import columns as FN
from actlens.sources import checkpoints as K
from actlens.sources import logs as L


def test_checkpoint_choice(spark):
    rows = [("a/100.pt",), ("a/200.pt",), ("a/x.pt",), ("b/150.pt",), ("a/0.pt",)]
    df = spark.createDataFrame(rows, "path STRING")
    best = K.checkpoint_catalogue(df).first()
    assert best.best_path == "a/200.pt" and best.token_count == 200
    none = K.checkpoint_catalogue(spark.createDataFrame([("a/x.pt",)], "path STRING")).first()
    assert none.best_path is None


def test_checkpoint_save_load_and_errors(spark, tmp_path):
    rng = np.random.default_rng(0)
    params = {"enc": rng.standard_normal((10, 5)), "pre_b": rng.standard_normal(5),
              "router": rng.standard_normal((2, 3, 5))}
    path = K.save_checkpoint(spark, str(tmp_path), "test_log_id", 100, K.params_frame(spark, params),
                             {"token_count": 100, "dead_latents": [0] * 10})
    back, state = K.load_checkpoint(spark, path)
    arrays = K.params_to_arrays(back)
    for k, v in params.items():
        assert np.allclose(arrays[k], v)
    assert state["token_count"] == 100 and state["log_id"] == "test_log_id"
    with pytest.raises(FileNotFoundError):
        K.load_checkpoint(spark, str(tmp_path / "missing"))
    bad = tmp_path / "bad.ckpt"
    bad.mkdir()
    (bad / "state.json").write_text("this is not json")
    with pytest.raises(ValueError):
        K.load_checkpoint(spark, str(bad))


def test_log_append_keeps_old_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    ev = spark.createDataFrame([("r1", "test_event", 42.0)], "run STRING, event STRING, value DOUBLE") \
              .withColumn("timestamp", F.lit(None).cast("double")).withColumn("hr_timestamp", F.lit(None).cast("string"))
    L.append_log(ev, path, now=0.0)
    L.append_log(ev.withColumn("value", F.lit(43.0)), path, now=1.0)
    good, bad = L.read_run_logs(spark, path)
    rows = sorted((r.value, r.timestamp, r.hr_timestamp) for r in good.collect())
    assert rows == [(42.0, 0.0, "1970-01-01 00:00:00"), (43.0, 1.0, "1970-01-01 00:00:01")]
    assert bad.count() == 0


def test_bad_log_line_is_kept_aside(spark, tmp_path):
    d = tmp_path / "run=7"
    d.mkdir()
    (d / "log.json").write_text(json.dumps({"event": "a", "value": 1}) + "\n{broken\n")
    good, bad = L.read_run_logs(spark, str(tmp_path))
    assert good.count() == 1 and bad.first()._corrupt_record == "{broken"


def test_run_params_clash(spark):
    df = spark.createDataFrame([("r", 1.0, 1)], "run STRING, value DOUBLE, k LONG")
    with pytest.raises(ValueError):
        L.run_params(df, ["value"], metric_cols=["value"], order_cols=["k"])


def test_image_folder_rejects(spark, tmp_path):
    from actlens.sources.media import read_image_folder
    for i, head in enumerate([b"\xff\xd8\xff", b"GIF8"]):
        p = tmp_path / str(i)
        p.mkdir()
        (p / f"{i}.jpg").write_bytes(head + b"rest")
    good, bad = read_image_folder(spark, str(tmp_path))
    assert good.count() == 1 and bad.count() == 1


def test_append_batches_column_check(spark):
    from actlens.operators.sets import append_batches
    a = spark.range(2)
    with pytest.raises(ValueError):
        append_batches(a, a.withColumnRenamed("id", "x"))


def test_url_list_size_filter_and_dedupe(spark, tmp_path):
    from actlens.sources.media import read_url_list
    df = spark.createDataFrame([("u1", "a", 100, 100), ("u1", "b", 100, 100), ("u2", "c", 10, 300), (None, "d", 99, 99)],
                               "URL STRING, TEXT STRING, WIDTH INT, HEIGHT INT")
    df.write.parquet(str(tmp_path / "urls"))
    got = sorted(tuple(r) for r in read_url_list(spark, str(tmp_path / "urls")).collect())
    assert got == [("u1", "a")]


def test_predictions_json_array_last_write_wins(spark, tmp_path):
    from actlens.sources.reports import read_predictions
    p = tmp_path / "preds.json"
    p.write_text(json.dumps([{"idx1": 1, "idx2": 2, "prediction": 1, "seq": 0},
                             {"idx1": 1, "idx2": 2, "prediction": 2, "seq": 1},
                             {"idx1": 3, "idx2": 4, "prediction": 3, "seq": 0}]))
    got = sorted(tuple(r) for r in read_predictions(spark, str(p), multiline=True).select("idx1", "idx2", "prediction").collect())
    assert got == [(1, 2, 2), (3, 4, 3)]


def test_legacy_cosine_table(spark, tmp_path):
    from actlens.sources.reports import read_legacy_cosine_table
    p = tmp_path / "layer_3.json"
    p.write_text(json.dumps({"own": [[0.5, 0.25], [1.0]], "next": [[0.1]]}))
    got = sorted(tuple(r) for r in read_legacy_cosine_table(spark, str(p), 3).collect())
    assert got == [(3, "next", 0, 0, 0.1), (3, "own", 0, 0, 0.5), (3, "own", 0, 1, 0.25), (3, "own", 1, 0, 1.0)]


def test_activated_samples_in_ranges(spark, tmp_path):
    from actlens.sources import reports as R
    top = spark.createDataFrame([(1, 1, 5, 0.5, "p")], "feature INT, rank INT, sample_index LONG, value DOUBLE, path STRING")
    act = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 50).cast("int")).alias("feature"),
                                   F.col("id").alias("sample_index"))
    R.write_feature_reports(top, str(tmp_path), activated=act)
    folder = tmp_path / "indices_gt_zero"
    assert not [n for n in os.listdir(folder) if "=" in n]    # no folder per feature
    back = spark.read.parquet(str(folder))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, act.collect()))


def test_sample_slice_keeps_first_rows(spark):
    from actlens.operators import shape as P
    df = spark.range(500).select((499 - F.col("id")).alias("k"), F.array(*[F.col("id") + j for j in range(4)]).alias("vec"))
    got = [(r.k, list(r.vec)) for r in P.sample_slice(df, 3, 2, ["k"]).collect()]
    assert got == [(0, [499, 500]), (1, [498, 499]), (2, [497, 498])]


def test_append_log_adds_one_file_to_a_run(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(f"r{i % 3}", i, "train") for i in range(90)]
    df = spark.createDataFrame(rows, "run string, step long, event string").withColumn("timestamp", F.lit(1.0)) \
        .withColumn("hr_timestamp", F.lit(None).cast("string")).repartition(8)
    for session in (1, 2):
        L.append_log(df, path)
        assert [len(list((tmp_path / "log" / f"run=r{i}").glob("*.json"))) for i in range(3)] == [session] * 3
    good, bad = L.read_run_logs(spark, path)
    assert (good.count(), bad.count()) == (180, 0)


def test_softmax_computes_its_argument_once(spark):
    assert str(FN.softmax(F.col("logits"))).count("logits") == 1
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([],), (None,)], "logits array<double>")
    got = [r[0] for r in df.select(FN.softmax("logits")).collect()]
    e = [math.exp(x) for x in (-2.0, 0.0, -1.0)]
    assert got[0] == [x / sum([e[0], e[1], e[2]]) for x in e] and got[1:] == [[], None]


ODD_RUNS = ["7", None, "a b", "x/y:z", "50%", "q=1", "[é]", "it's", "#{^}"]


def test_log_folders_are_named_as_by_spark(spark, tmp_path):
    rows = [(r, i, f"line {i}") for i, r in enumerate(ODD_RUNS * 3)]
    df = spark.createDataFrame(rows, "run string, step long, event string")
    df.write.partitionBy("run").json(str(tmp_path / "spark"))
    L.append_lines(df.repartition(5), L.json_line(df), str(tmp_path / "own"))
    assert sorted(os.listdir(tmp_path / "own")) == sorted(n for n in os.listdir(tmp_path / "spark") if "=" in n)
    for folder in (tmp_path / "own").iterdir():
        assert len(os.listdir(folder)) == 1          # one file, no side file or leftover
    want = spark.read.text(str(tmp_path / "spark")).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)/", 1).alias("run"), "value")
    for made in ("own", "spark"):
        got = L.run_lines(spark, str(tmp_path / made), r"run=([^/]+)/")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_run_lines_reads_what_sparks_reader_reads(spark, tmp_path, monkeypatch):
    import gzip
    base = tmp_path / "log"
    for run, name, data in [("1", "a.json", b"x\ny\r\n\nz"), ("1", "b.json", b"p\rq\n"), ("2", "c.json", b""), ("3", "_tmp", b"no\n"),
                            ("3", ".d.json", b"no\n"), ("3", "e [1].json", "é {\n".encode() * 50), ("4", "f.json.gz", gzip.compress(b"g\nh\n"))]:
        (base / f"run={run}").mkdir(parents=True, exist_ok=True)
        (base / f"run={run}" / name).write_bytes(data)
    monkeypatch.setattr(L, "HELD_BYTES", 16)
    for run in (1, 2):
        (tmp_path / "deep" / f"run={run}" / "day=1").mkdir(parents=True)
        (tmp_path / "deep" / f"run={run}" / "day=1" / "k.json").write_bytes(b"deep\n")
    (tmp_path / "flat" / "other").mkdir(parents=True)
    (tmp_path / "flat" / "other" / "n.json").write_bytes(b"no\n")
    (tmp_path / "flat" / "m.json").write_bytes(b"yes\n")
    places = [str(base), str(tmp_path / "flat"), str(tmp_path / "deep"), str(base / "run=1" / "a.json"), [str(base / "run=1"), str(base / "run=3")], str(base / "run=[13]")]
    for large in (L.LARGE_FILE, 100):
        monkeypatch.setattr(L, "LARGE_FILE", large)
        for place in places:
            want = spark.read.text(place).select(F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)/", 1).alias("run"), "value")
            got = L.run_lines(spark, place, r"run=([^/]+)/")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), place
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        L.run_lines(spark, str(tmp_path / "missing"), "x")


def test_many_runs_make_no_scan_of_files_on_the_driver(spark, tmp_path):
    df = spark.range(1200).select((F.col("id") % 400).cast("string").alias("run"), F.col("id").alias("step"), F.lit("e").alias("event"),
                                  F.lit(1.0).alias("timestamp"), F.lit(None).cast("string").alias("hr_timestamp")).repartition(7)
    for _ in range(2):
        L.append_log(df, str(tmp_path / "log"))
    assert [len(os.listdir(f)) for f in (tmp_path / "log").iterdir()] == [2] * 400
    good, bad = L.read_run_logs(spark, str(tmp_path / "log"))
    assert "FileScan text" not in good._jdf.queryExecution().toString()
    assert (good.count(), bad.count(), good.select("run").distinct().count()) == (2400, 0, 400)


def test_similarity_tables_are_removed_part_by_part(spark, monkeypatch):
    from actlens.plans import q_io, registry
    registry.load_all()
    places = []
    io_dir = q_io.io_dir
    monkeypatch.setattr(q_io, "io_dir", lambda *a: places.append(io_dir(*a)) or places[-1])
    data = os.path.join(os.path.dirname(__file__), "..")
    sims = spark.createDataFrame([(1, 0, [0, 1], [0.5, 0.25], [0.1, 0.2], [0.3, 0.3]), (2, 1, [0], [1.0], [0.5], [0.25])],
                                 "doc_id long, layer int, pos array<int>, own array<double>, next array<double>, const array<double>")
    parts = [sims.where("doc_id = 1"), sims.where("doc_id = 2"), sims.where("doc_id = 1")]
    monkeypatch.setattr(q_io.C, "similarity_series", lambda *a: parts)
    got = sorted(map(tuple, registry.QUERIES["src15_read_cosine_tables"](spark, data).collect()))
    assert got == [(0, "const", 4, 1.2), (0, "next", 4, 0.6), (0, "own", 4, 1.5), (1, "const", 1, 0.25), (1, "next", 1, 0.5), (1, "own", 1, 1.0)]
    assert len(places) == 3 and not any(os.path.exists(p.removeprefix("file:")) for p in places)
