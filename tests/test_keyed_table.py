import pytest

from actlens.streaming.keyed_table import KeyedTable


def _batch(spark, rows):
    return spark.createDataFrame(rows, "k STRING, rank INT, v DOUBLE")


def _state(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def _expected(batches):
    state = {}
    for rows in batches:
        fresh = {}
        for r in rows:
            fresh.setdefault(r[0], []).append(r)
        state.update(fresh)
    return sorted((r for rows in state.values() for r in rows), key=str)


def test_versions_merge_and_files_stay_bounded(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], merge_every=3, ranges=4)
    batches, opened = [], []
    for b in range(11):
        batches.append([(f"k{(b * 3 + i) % 7}", r, float(b)) for i in range(3) for r in range(2)])
        table(_batch(spark, batches[-1]), b)
        assert _state(table) == _expected(batches)
        opened.append(len(table.folders(table.manifest())))
    assert max(opened) <= 4 * 3                       # each range: its base and at most merge_every - 1 deltas
    assert len(table.versions()) == 2
    named = {f for v in table.versions() for m in [table.manifest(v)] for f in [*m["base"].values(), *m["deltas"]]}
    assert set(table._names("data")) == named         # old folders are gone


def test_untouched_ranges_are_not_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], merge_every=1, ranges=8)
    table(_batch(spark, [(f"k{i}", 0, 0.0) for i in range(40)]), 0)
    before = table.manifest()["base"]
    table(_batch(spark, [("k5", 0, 1.0)]), 1)
    after = table.manifest()["base"]
    assert sum(before[r] != after[r] for r in before) == 1


def test_replayed_and_failed_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], merge_every=2)
    table(_batch(spark, [("a", 0, 1.0)]), 0)
    table(_batch(spark, [("a", 0, 99.0)]), 0)         # replayed: the commit stands
    assert _state(table) == [("a", 0, 1.0)]
    real, table._commit = table._commit, lambda m: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        table(_batch(spark, [("a", 0, 2.0), ("b", 0, 2.0)]), 1)
    assert _state(table) == [("a", 0, 1.0)]           # nothing of the failed batch is seen
    table._commit = real
    table(_batch(spark, [("a", 0, 2.0), ("b", 0, 2.0)]), 1)
    assert _state(table) == [("a", 0, 2.0), ("b", 0, 2.0)]


def test_ranges_double_and_odd_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], merge_every=1, range_rows=10)
    with pytest.raises(FileNotFoundError):
        table.read()
    table(_batch(spark, []), 0)                       # an empty batch is a version without rows
    assert _state(table) == []
    batches = [[(f"k{i}", 0, 0.0) for i in range(35)], [("k1", 0, 1.0)], [(None, 0, 2.0), ("k2", 1, None)],
               [(None, 0, 3.0)]]
    for b, rows in enumerate(batches):
        table(_batch(spark, rows), b + 1)
    assert table.manifest()["ranges"] == 4
    assert _state(table) == _expected(batches)
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "u"), [])
