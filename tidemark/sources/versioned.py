"""Keyed tables that survive two writers and a lost job: files first, then one new manifest that names them.

A table is a folder with ``files`` (Parquet, a folder for every write, partitioned by bucket) and ``manifests`` (numbered JSON: for
every bucket its folder). Keys are dealt to buckets by a hash, so a merge reads and rewrites only the buckets that its rows
touch. It takes effect when manifest n + 1 is created, which succeeds for one writer only. A writer that comes too late
looks at the new manifest: if none of its buckets have changed, its files are good and it tries the next number; else it
merges again. A job that is lost before its manifest leaves files that no manifest names; ``vacuum`` removes them.

Readers take one manifest and see the whole of one version. Only manifests pass the driver, a line a bucket.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import merged

BUCKETS = 16
TRIES = 50
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Other writers were faster, every time."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext
        self._no_options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)

    # Manifests.

    def version(self) -> int:
        """The number of the newest manifest, 0 for a table without any."""
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return 0
        return max([0, *(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())])

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """bucket to the folder of its files."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{version}", wholetext=True).first()[0])

    def _publish(self, version: int, content: dict[str, str]) -> bool:
        """Create the manifest unless it exists: written aside, then moved to its name, which never replaces another one."""
        aside, name = f"{self.folder}/manifests/.{uuid.uuid4().hex}", f"{self.folder}/manifests/{version}"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a local rename would replace; a link does not
                os.link(self._path(aside).toUri().getPath(), self._path(name).toUri().getPath())
            else:
                self._context.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._path(aside), self._path(name), self._no_options)
            return True
        except Exception:
            if self._fs.exists(self._path(name)):
                return False
            raise
        finally:
            self._fs.delete(self._path(aside), False)

    # Rows.

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame | None:
        """The rows of a version (the newest, if none is named); None for a table without rows."""
        named = self.manifest(version)
        paths = sorted(p for b, p in named.items() if buckets is None or b in buckets)
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else None

    def merge(self, rows: DataFrame) -> int:
        """Rows replace those with the same keys, and the rest is added; the version that has them."""
        touched = [str(r[0]) for r in rows.select(self._bucket().alias(_BUCKET)).distinct().collect()]  # BUCKETS at most
        if not touched:
            return self.version()
        based, written = None, {}
        for _ in range(TRIES):
            now = self.version()
            named = self.manifest(now)
            if based is None or any(named.get(b) != based.get(b) for b in touched):
                based, written = named, self._write(rows, now, touched)
            if self._publish(now + 1, named | written):
                return now + 1
        raise Conflict(f"{self.folder}: {TRIES} times another writer was faster")

    def _write(self, rows: DataFrame, version: int, touched: list[str]) -> dict[str, str]:
        old = self.read(version, touched)
        out = rows if old is None else merged(old, rows, self.keys)
        name = f"files/{uuid.uuid4().hex}"
        out.withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
        return {b: f"{name}/{_BUCKET}={b}" for b in touched}

    def vacuum(self, keep_versions: int = 1) -> int:
        """Remove what none of the newest manifests names; not while writers are at work. How many folders went."""
        newest = self.version()
        kept = range(max(1, newest - keep_versions + 1), newest + 1)
        used = {p.split("/")[1] for v in kept for p in self.manifest(v).values()}
        files, gone = self._path(f"{self.folder}/files"), 0
        for s in self._fs.listStatus(files) if self._fs.exists(files) else []:
            if s.getPath().getName() not in used:
                gone += self._fs.delete(s.getPath(), True)
        for v in range(1, kept[0] if len(kept) else 1):
            self._fs.delete(self._path(f"{self.folder}/manifests/{v}"), False)
        return gone
