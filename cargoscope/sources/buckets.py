"""Tables that are rewritten bucket by bucket.

A row's bucket is a number computed from its key (a hash, a day, a month).
A merge reads and rewrites the buckets that its updates touch and no others;
the version's manifest then names, per bucket, the files that make it up, old
ones of untouched buckets among them. Readers follow the newest manifest, so
they see a merge whole or not at all; dropping buckets (retention) is a new
manifest, too.

``progress`` in the manifest records what has been applied, by source: a merge
that is tried again after its manifest was published does nothing.
A table has one writer. Files of older versions go after ``KEEP`` versions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cargoscope.sources import storage

KEEP = 2  # versions whose files stay, for readers that opened them
MANIFEST = "bucket long, file string, schema string, progress string"


def hashed(*key: str, buckets: int) -> Column:
    """Bucket of a key by hash; choose ``buckets`` for files of about 128 MB."""
    return F.pmod(F.xxhash64(*key), F.lit(int(buckets)))


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, bucket: Column):
        self.spark, self.path, self.bucket = spark, path.rstrip("/"), bucket

    # ------------------------------------------------------------- reading
    def version(self) -> int:
        return storage.newest_version(self.spark, self.path)

    def _manifest(self, version: int) -> DataFrame | None:
        return self.spark.read.schema(MANIFEST).json(
            f"{self.path}/manifest-{version}") if version else None

    def files(self, version: int | None = None) -> dict[int, list[str]]:
        """Bucket -> its files, by the newest (or a given) manifest."""
        manifest = self._manifest(self.version() if version is None else version)
        found: dict[int, list[str]] = {}
        for r in ([] if manifest is None else manifest.filter("file IS NOT NULL").collect()):
            found.setdefault(r["bucket"], []).append(r["file"])
        return found

    def progress(self) -> dict[str, int]:
        manifest = self._manifest(self.version())
        return json.loads(manifest.select("progress").first()[0]) if manifest is not None else {}

    def _schema(self) -> StructType | None:
        manifest = self._manifest(self.version())
        return None if manifest is None else StructType.fromJson(json.loads(
            manifest.select("schema").first()[0]))

    def _load(self, schema: StructType, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, buckets: Collection[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets (whose files alone are opened)."""
        schema = self._schema()
        if schema is None:
            raise FileNotFoundError(f"nothing has been merged into {self.path}")
        files = self.files()
        return self._load(schema, [f for b, names in files.items() if buckets is None or b in buckets
                                   for f in names])

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that hold the given keys: at most as many as there are
        buckets, however many keys."""
        return sorted(r["bucket"] for r in keys.select(self.bucket.alias("bucket")).distinct().collect())

    # ------------------------------------------------------------- writing
    def merge(self, updates: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame],
              progress: dict[str, int] | None = None) -> list[int]:
        """Rewrites the buckets of ``updates`` as ``combine(their rows, updates)``
        (rows are None before the first merge). ``combine`` keeps every row in
        its bucket. Returns the buckets rewritten."""
        before = self.progress()
        ahead = {k: v for k, v in (progress or {}).items() if v > before.get(k, -1)}
        if progress and not ahead:
            return []  # applied before
        version, schema, files = self.version(), self._schema(), self.files()
        touched = self.buckets_of(updates)
        current = None if schema is None else self._load(
            schema, [f for b in touched for f in files.get(b, ())])
        rows = combine(current, updates)
        if schema is not None:
            rows = rows.select([F.col(f.name).cast(f.dataType) for f in schema])
        folder = f"data/version={version + 1}-{uuid.uuid4().hex}"
        (rows.withColumn("bucket", self.bucket).hint("rebalance", "bucket").write.partitionBy("bucket")
         .parquet(f"{self.path}/{folder}"))
        written = self.spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(
            f"{self.path}/{folder}").inputFiles()
        fresh: dict[int, list[str]] = {b: [] for b in touched}
        for file in written:
            tail = file.split(folder + "/", 1)[1]
            fresh.setdefault(int(tail.split("/")[0].removeprefix("bucket=")), []).append(f"{folder}/{tail}")
        self._publish(version + 1, {**files, **fresh}, rows.schema, {**before, **ahead})
        return touched

    def drop_buckets(self, gone: Callable[[int], bool]) -> list[int]:
        """Takes buckets out of the table without reading or writing a row."""
        schema, files = self._schema(), self.files()
        dropped = [b for b in files if gone(b)]
        if dropped:
            self._publish(self.version() + 1, {b: f for b, f in files.items() if b not in dropped},
                          schema, self.progress())
        return dropped

    def _publish(self, version: int, files: dict[int, list[str]], schema: StructType,
                 progress: dict[str, int]) -> None:
        said = (schema.json(), json.dumps(progress))
        rows = [(b, f, *said) for b, names in files.items() for f in names] + [(None, None, *said)]
        manifest = f"{self.path}/manifest-{version}"
        storage.remove(self.spark, manifest)  # left by a run that did not get to name it
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.json(manifest)
        storage.publish_version(self.spark, self.path, version)
        self._forget(version)

    def _forget(self, version: int) -> None:
        """Removes the manifest that falls out of ``KEEP``, and its files that
        no later manifest names."""
        old = version - KEEP
        if old < 1 or not storage.exists(self.spark, f"{self.path}/manifest-{old}"):
            return
        used = {f for v in range(old + 1, version + 1) for names in self.files(v).values() for f in names}
        for names in self.files(old).values():
            for file in names:
                if file not in used:
                    storage.remove(self.spark, f"{self.path}/{file}")
        storage.remove(self.spark, f"{self.path}/manifest-{old}")
