"""A table with a key, in files by hash bucket: an upsert rewrites the buckets that it touches, and becomes visible in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.sources.tables import upsert

_BUCKET = "__bucket"


class KeyedStore:
    """Versions of a table under a folder that all executors see.

    A manifest names, for each bucket of a version, the folder that holds its rows; it is a small file, written beside the others and moved to
    its name when the folders are complete. Readers take the manifest with the highest number. So a writer that
    fails leaves the version before it as it was, and of two writers of one version the second fails. Buckets are as
    many as the first write says; a bucket should be some hundred megabytes, so that few keys rewrite little.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets = (self._manifest() or {"buckets": buckets})["buckets"]

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The number of the newest version; -1: nothing was written yet."""
        fs, folder = self._fs("")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=-1)

    def _manifest(self, version: int | None = None) -> dict | None:
        version = self.version() if version is None else version
        if version < 0:
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifest-{version:08d}.json", wholetext=True).collect()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        folders = sorted({f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets})
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is named."""
        manifest = self._manifest(version)
        if manifest is None:
            raise ValueError(f"no version in {self.path}")
        rows = self._folders(manifest)
        return self.spark.createDataFrame([], T.StructType.fromJson(manifest["schema"])) if rows is None else rows

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        manifest = self._manifest()
        asked = keys.select(self.key).distinct()
        rows = self._folders(manifest, [r["b"] for r in asked.select(self._bucket().alias("b")).distinct().collect()])
        return self.read().limit(0) if rows is None else rows.join(asked, self.key, "left_semi")

    def _write(self, rows: DataFrame, touched: list[int], before: dict | None, version: int) -> None:
        folder, schema = f"data/{version:08d}-{uuid.uuid4().hex}", rows.schema
        rows.withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        fs, root = self._fs(folder)
        there = {int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(root) if s.getPath().getName().startswith(_BUCKET)}
        folders = {b: f for b, f in (before or {"folders": {}})["folders"].items() if int(b) not in touched}
        folders |= {str(b): f"{folder}/{_BUCKET}={b}" for b in there}
        manifest = json.dumps({"buckets": self.buckets, "folders": folders, "schema": schema.jsonValue()})
        _, staged = self._fs(f"staged-{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(manifest.encode())
        out.close()
        _, name = self._fs(f"manifest-{version:08d}.json")
        if fs.exists(name) or not fs.rename(staged, name):
            raise RuntimeError(f"version {version} of {self.path} was written by another")

    def upsert(self, new: DataFrame, updated: tuple[str, ...]) -> int:
        """Merges new in by key, as ``tables.upsert`` does, and says how many buckets were written. The keys of new are unique and not null."""
        version = self.version()
        before = self._manifest(version)
        touched = sorted(r["b"] for r in new.select(self._bucket().alias("b")).distinct().collect())  # no more than there are buckets
        old = self._folders(before, touched) if before else None
        if before and old is None:
            old = self.read(version).limit(0)
        whole = new if old is None else upsert(old, new.select(*old.columns), self.key, updated)
        if touched or before is None:
            self._write(whole, touched, before, version + 1)
        return len(touched)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the folders that none of the newest ``keep`` versions names, with older manifests, and says how many folders that were. No reader of them and no writer may be at work."""
        newest = self.version()
        kept = {f for v in range(max(0, newest - keep + 1), newest + 1) for f in (self._manifest(v) or {"folders": {}})["folders"].values()}
        fs, data = self._fs("data")
        gone = 0
        for job in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(job.getPath()):
                name = part.getPath().getName()
                if name.startswith(_BUCKET) and f"data/{job.getPath().getName()}/{name}" not in kept:
                    gone += fs.delete(part.getPath(), True)
        for v in range(max(0, newest - keep + 1)):
            fs.delete(self._fs(f"manifest-{v:08d}.json")[1], False)
        return gone
