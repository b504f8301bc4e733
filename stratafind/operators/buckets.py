"""Keyed tables in buckets under a manifest: a merge rewrites the buckets of its keys and renames one file.

A table is a folder. Rows are dealt into a fixed number of buckets by a hash of their key; a manifest, `manifest/<version>`,
names the live folder of each bucket. A merge writes the new state of the buckets that its keys fall into to a folder of its
own, then renames a manifest of the next version into place: readers see the old state or the new one, nothing between. A
writer that fails before that leaves only files that no manifest names, which vacuum() removes. Of two writers that start from
one version the second finds the name taken and raises. A stream passes its name and batch, and a batch that is on record is
not merged again.

The bucket of a key is the number of the first eight hexadecimal digits of its MD5, modulo the number of buckets; choose as
many buckets as leave one within a task's memory. Rows without key are left out; of new rows under one key the last by the
columns `order` stays.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..common import cut_lineage

BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


class Conflict(RuntimeError):
    """Another writer has published this version."""


@dataclass(frozen=True)
class Change:
    version: int
    rewritten: list[int]


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # ---- the manifest

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._files()
        held = fs.listStatus(self._at("manifest")) if fs.exists(self._at("manifest")) else []
        return sorted(int(s.getPath().getName()) for s in held if s.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """Of a version, the newest by default: version, schema, buckets, live (bucket -> [version, folder]), tokens."""
        known = self.versions()
        if not known:
            return None
        stream = self._files().open(self._at(f"manifest/{version or known[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Write beside, then rename; a name that is taken is another writer's."""
        fs, jvm = self._files(), self.spark._jvm
        beside = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, self._at(f"manifest/{manifest['version']}"), how)
        except Exception as e:
            fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.path} is taken") from None
            raise

    # ---- reading and writing

    def _read(self, manifest: dict, buckets=None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for b, (_, folder) in manifest["live"].items() if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None before the first merge."""
        manifest = self.manifest(version)
        return self._read(manifest) if manifest else None

    def written(self) -> DataFrame:
        """bucket, version: which version wrote a bucket's live files."""
        live = (self.manifest() or {"live": {}})["live"]
        return self.spark.createDataFrame([(int(b), v) for b, (v, _) in live.items()], "bucket int, version int")

    def merge(self, new: DataFrame, order: tuple[str, ...] = (), token: tuple[str, int] | None = None) -> Change:
        """New rows replace old ones of their key."""
        return self._change(new, order, token, add=True)

    def remove(self, keys: DataFrame) -> Change:
        return self._change(keys.select(self.key), (), None, add=False)

    def _change(self, new: DataFrame, order, token, add: bool) -> Change:
        old = self.manifest()
        version, buckets = (old["version"], old["buckets"]) if old else (0, self.buckets)
        if token and old and old["tokens"].get(token[0], -1) >= token[1]:
            return Change(version, [])
        last = Window.partitionBy(self.key).orderBy(*[F.col(c).desc() for c in order]) if order else None
        new = new.where(F.col(self.key).isNotNull())
        new = new.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last") if order else new.dropDuplicates([self.key])
        new = cut_lineage(new.withColumn("_bucket", bucket_of(F.col(self.key), buckets)))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # no more than there are buckets
        live = dict(old["live"]) if old else {}
        rows, schema = new, new.drop("_bucket").schema
        if old:
            kept = self._read(old, set(touched)).withColumn("_bucket", bucket_of(F.col(self.key), buckets)).join(new.select(self.key), self.key, "left_anti")
            rows = kept.unionByName(new, allowMissingColumns=True) if add else kept
            schema = rows.drop("_bucket").schema
        elif not add:
            rows = new.limit(0)
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            fs = self._files()
            for b in touched:
                at = f"{folder}/_bucket={b}"
                live.pop(str(b), None)
                if fs.exists(self._at(at)):
                    live[str(b)] = [version + 1, at]
        tokens = (old["tokens"] if old else {}) | (dict([token]) if token else {})
        self._publish({"version": version + 1, "key": self.key, "buckets": buckets, "schema": json.loads(schema.json()), "live": live, "tokens": tokens})
        return Change(version + 1, touched)

    def vacuum(self, keep: int = 1) -> int:
        """Remove what the newest `keep` versions do not name; how many folders that were. No writer may be at work."""
        fs, known = self._files(), self.versions()
        named = {folder for v in known[-keep:] for _, folder in self.manifest(v)["live"].values()}
        gone = 0
        for run in fs.listStatus(self._at("data")) if fs.exists(self._at("data")) else []:
            for part in fs.listStatus(run.getPath()):
                name = f"data/{run.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in named:
                    fs.delete(part.getPath(), True)
                    gone += 1
        for v in known[:-keep]:
            fs.delete(self._at(f"manifest/{v}"), False)
        return gone
