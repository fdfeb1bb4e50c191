"""A table of the newest rows of each key, fed by update-mode streams (STR2, STR4, STR5).

A micro-batch replaces all rows of the keys it carries. It is written as one
delta, cut by the hash of the key into ranges; after ``merge_every`` deltas the
ranges they touch are merged with their present base and written anew, the
others stay as they are. A manifest names the folders of one version and is
written last: a reader opens the newest manifest and only the folders in it, so
the number of files read depends on the table and never on the count of batches.

A replayed micro-batch (its id is not above the manifest's) changes nothing; a
batch that failed before its manifest left folders that no manifest names, and
the same batch overwrites them. Ranges double when their mean exceeds
``range_rows`` rows, so none of them grows with the table.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Sequence

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.sources.files import filesystem, qualified, write_bytes

RANGE_ROWS = 1_000_000
VERSION, RANGE = "_version", "_range"


class KeyedTable:
    """``foreachBatch`` function and reader of one keyed table.

    ``keys``: columns whose rows are replaced together. ``keep_versions``: manifests
    kept for readers that opened an older one; folders that none of them names are
    removed after a commit.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], *, merge_every: int = 4,
                 ranges: int = 1, range_rows: int = RANGE_ROWS, keep_versions: int = 2):
        if not keys or merge_every < 1 or ranges < 1 or range_rows < 1 or keep_versions < 1:
            raise ValueError("a keyed table needs keys and positive settings")
        self.spark, self.path, self.keys = spark, qualified(spark, path), list(keys)
        self.merge_every, self.first_ranges = merge_every, ranges
        self.range_rows, self.keep = range_rows, keep_versions

    # ------------------------------------------------------------ manifests

    def _names(self, folder: str) -> list[str]:
        fsys, p = filesystem(f"{self.path}/{folder}")
        infos = fsys.get_file_info(pafs.FileSelector(p, allow_not_found=True))
        return sorted(i.base_name for i in infos)

    def versions(self) -> list[int]:
        return [int(n[:-len(".json")]) for n in self._names("manifest") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version (the newest one by default); None of an empty table."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        fsys, p = filesystem(f"{self.path}/manifest/{version:010d}.json")
        with fsys.open_input_stream(p) as f:
            return json.loads(f.read().decode())

    def _commit(self, manifest: dict) -> None:
        body = json.dumps(manifest, sort_keys=True).encode()
        write_bytes(f"{self.path}/manifest/{manifest['version']:010d}.json", body)
        fsys, root = filesystem(self.path)
        known = self.versions()
        for old in known[:-self.keep]:
            fsys.delete_file(f"{root}/manifest/{old:010d}.json")
        named = set()
        for v in known[-self.keep:]:
            m = self.manifest(v)
            named.update(m["base"].values(), m["deltas"])
        for folder in self._names("data"):
            if folder not in named:
                fsys.delete_dir(f"{root}/data/{folder}")

    # ------------------------------------------------------------ writing

    def _range(self, ranges: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(ranges)).cast("int")

    def _write(self, rows: DataFrame, folder: str, ranges: int) -> list[int]:
        """Rows by range under ``data/folder``; returns the ranges that have rows."""
        parts = min(ranges, self.spark.sparkContext.defaultParallelism * 4)
        rows.withColumn(RANGE, self._range(ranges)).repartition(parts, RANGE) \
            .write.mode("overwrite").partitionBy(RANGE).parquet(f"{self.path}/data/{folder}")
        return [int(n.split("=", 1)[1]) for n in self._names(f"data/{folder}") if n.startswith(f"{RANGE}=")]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self.manifest()
        if now and batch_id <= now["batch_id"]:
            return
        if now is None:
            schema = T.StructType(batch.schema.fields + [T.StructField(VERSION, T.LongType())])
            now = {"version": -1, "batch_id": -1, "ranges": self.first_ranges, "base": {}, "deltas": {},
                   "rows": 0, "schema": json.loads(schema.json())}
        version = now["version"] + 1
        delta = f"delta-{version:010d}"
        touched = self._write(batch.withColumn(VERSION, F.lit(version).cast("bigint")), delta, now["ranges"])
        new = dict(now, version=version, batch_id=batch_id)
        if touched:
            new["deltas"] = {**now["deltas"], delta: touched}
        if len(new["deltas"]) >= self.merge_every:
            new = self._merged(new)
        self._commit(new)

    def _merged(self, m: dict) -> dict:
        """The manifest with its deltas merged into the ranges they touch."""
        ranges, touched = m["ranges"], {r for some in m["deltas"].values() for r in some}
        rows = self._newest(m, touched)
        if m["rows"] > ranges * self.range_rows:          # rows counted by the merge before
            while m["rows"] > ranges * self.range_rows:
                ranges *= 2
            rows = self._newest(m, None)
            touched = None
        folder = f"base-{m['version']:010d}"
        written = self._write(rows, folder, ranges)
        base = {} if touched is None else {r: f for r, f in m["base"].items() if int(r) not in touched}
        base.update({str(r): folder for r in written})
        out = dict(m, ranges=ranges, base=base, deltas={})
        out["rows"] = self._scan(out, None).count()       # from the file footers
        return out

    # ------------------------------------------------------------ reading

    def folders(self, m: dict, only: Collection[int] | None = None) -> list[str]:
        """What a reader of this version opens (``only``: of these ranges)."""
        parts = [(f, int(r)) for r, f in sorted(m["base"].items())]
        parts += [(d, r) for d, some in sorted(m["deltas"].items()) for r in some]
        return [f"{self.path}/data/{f}/{RANGE}={r}" for f, r in parts if only is None or r in only]

    def _scan(self, m: dict, only: Collection[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        folders = self.folders(m, only)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders).select(*schema.fieldNames())

    def _newest(self, m: dict, only: Collection[int] | None) -> DataFrame:
        w = Window.partitionBy(*self.keys)
        rows = self._scan(m, only).withColumn("_newest", F.max(VERSION).over(w))
        return rows.where(F.col(VERSION) == F.col("_newest")).drop("_newest")

    def read(self) -> DataFrame:
        """The newest rows of every key; without deltas a plain scan of the ranges."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no version of {self.path}")
        rows = self._newest(m, None) if m["deltas"] else self._scan(m, None)
        return rows.drop(VERSION)
