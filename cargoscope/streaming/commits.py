"""Commit log of a stream's sinks (G4): which files each batch put where.

A batch may be tried several times, at different times of day and with
different results. Every attempt writes to folders of its own
(``<sink>/batch=<id>-<attempt>``), and a batch counts once its entry is in the
log: one appended file that names the exact files of all its sinks. Readers
follow the log (:meth:`CommitLog.read`), so they see a batch in all sinks or
in none, and never files of an attempt that did not finish. A batch whose
entry exists is not processed again, whatever the clock says by then.

Batches are known by (stream, id); ``stream`` is the identity that Spark
stores with a checkpoint, so a new checkpoint, whose ids start at 0 again,
is not mistaken for a replay. A log has one writer: the stream's driver.

``compact`` folds the entries into one snapshot; ``vacuum`` removes what
failed attempts left behind. ``expire`` drops whole partitions of a sink: the
files are named in the log first, from when on no reader sees them, and
removed then; what a run that died in between left goes with the next one.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cargoscope.sources import storage

ENTRY = ("seq long, stream string, batch long, attempt string, sink string, fmt string, "
         "schema string, file string")
DROP = "sink string, file string"
VACUUM_AFTER_H = 48


def stream_identity(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id that Spark keeps in a streaming checkpoint."""
    text = spark.read.text(f"{checkpoint_dir}/metadata").first()
    return json.loads(text["value"])["id"] if text else ""


class Batch:
    """One attempt at a batch: writes to folders of its own, then commits."""

    def __init__(self, log: "CommitLog", stream: str, batch_id: int):
        self.log, self.stream, self.batch_id = log, stream, int(batch_id)
        self.attempt = f"{self.batch_id:020d}-{uuid.uuid4().hex}"
        self.written: dict[str, tuple[str, str]] = {}
        self._staged: list[str] = []

    def stage(self, df: DataFrame) -> DataFrame:
        """A table that the attempt's sinks share; gone after the attempt."""
        path = f"{self.log.root}/staging/{self.attempt}-{len(self._staged)}"
        self._staged.append(path)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def write(self, sink: str, df: DataFrame, fmt: str = "parquet", by: Sequence[str] = ()) -> None:
        (df.write.format(fmt).partitionBy(*by).save(f"{self.log.root}/{sink}/batch={self.attempt}"))
        plain = StructType([f for f in df.schema.fields if f.name not in by])
        self.written[sink] = (fmt, plain.json())

    def close(self, commit: bool) -> None:
        if commit:
            self.log._commit(self)
        for path in self._staged:
            storage.remove(self.log.spark, path)

    def __enter__(self) -> "Batch":
        return self

    def __exit__(self, kind, *_) -> None:
        self.close(commit=kind is None)


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: set[tuple[str, int]] | None = None
        self._folded: dict[str, int] = {}
        self._seq = 0

    # ------------------------------------------------------------- writing
    def committed(self, stream: str, batch_id: int) -> bool:
        """True if the batch's entry exists. The log is read once per object,
        then kept up with the object's own commits."""
        if self._seen is None:
            self._load()
        return (stream, int(batch_id)) in self._seen or int(batch_id) <= self._folded.get(stream, -1)

    def batch(self, stream: str, batch_id: int) -> Batch:
        """To be used in a ``with`` block: commits at its end, unless it raises."""
        if self._seen is None:
            self._load()
        return Batch(self, stream, batch_id)

    def _load(self) -> None:
        rows = self.entries().groupBy("stream", "batch").agg(F.max("seq").alias("seq"))
        folded = self._snapshot()
        self._folded = {} if folded is None else {
            r["stream"]: r["b"] for r in folded.groupBy("stream").agg(F.max("batch").alias("b")).collect()}
        self._seq = rows.agg(F.max("seq").alias("s")).first()["s"] or 0
        self._seen = {(r["stream"], r["batch"]) for r in rows.collect()
                      if r["batch"] > self._folded.get(r["stream"], -1)}

    def _commit(self, batch: Batch) -> None:
        self._seq += 1
        head = (self._seq, batch.stream, batch.batch_id, batch.attempt)
        rows = [(*head, None, None, None, None)]  # a batch without files counts, too
        for sink, (fmt, schema) in batch.written.items():
            folder = f"{sink}/batch={batch.attempt}"
            found = (self.spark.read.schema(StructType.fromJson(json.loads(schema))).format(fmt)
                     .option("recursiveFileLookup", "true").load(f"{self.root}/{folder}").inputFiles())
            rows += [(*head, sink, fmt, schema, folder + f.split(f"batch={batch.attempt}", 1)[1])
                     for f in sorted(found)] or [(*head, sink, fmt, schema, None)]
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").json(
            f"{self.root}/commits/entries")
        self._seen.add((batch.stream, batch.batch_id))

    # ------------------------------------------------------------- reading
    def _snapshot(self) -> DataFrame | None:
        version = storage.newest_version(self.spark, f"{self.root}/commits")
        return self.spark.read.schema(ENTRY).parquet(
            f"{self.root}/commits/snapshot-{version}") if version else None

    def entries(self) -> DataFrame:
        """One row per committed file; of two attempts that both committed,
        which a single writer rules out, the first counts."""
        rows = self._snapshot()
        if storage.exists(self.spark, f"{self.root}/commits/entries"):
            fresh = self.spark.read.schema(ENTRY).json(f"{self.root}/commits/entries")
            rows = fresh if rows is None else rows.unionByName(fresh).distinct()
        if rows is None:
            return self.spark.createDataFrame([], ENTRY)
        first = F.min(F.struct("seq", "attempt")).over(Window.partitionBy("stream", "batch"))
        rows = rows.withColumn("_first", first).filter(
            F.struct("seq", "attempt") == F.col("_first")).drop("_first")
        if not storage.exists(self.spark, f"{self.root}/commits/drops"):
            return rows
        drops = self._drops().distinct().withColumn("_gone", F.lit(True))
        gone = F.col("_gone").isNotNull()  # the batch stays known, without the file
        return (rows.join(drops, ["sink", "file"], "left")
                .withColumn("file", F.when(~gone, F.col("file"))).drop("_gone")
                .select("seq", "stream", "batch", "attempt", "sink", "fmt", "schema", "file").distinct())

    def _drops(self) -> DataFrame:
        return self.spark.read.schema(DROP).json(f"{self.root}/commits/drops")

    def last_seq(self) -> int:
        return self.entries().agg(F.max("seq").alias("s")).first()["s"] or 0

    def read(self, sink: str, after: int = 0, upto: int | None = None) -> DataFrame:
        """A sink's rows from the files of committed batches, those of
        ``after < seq <= upto`` only. Partition columns (and ``batch``) come
        from the paths, so filters on them prune files."""
        rows = self.entries().filter((F.col("sink") == sink) & (F.col("seq") > after))
        if upto is not None:
            rows = rows.filter(F.col("seq") <= upto)
        found = rows.select("seq", "fmt", "schema", "file").collect()  # names, as any file index holds
        if not found:
            raise FileNotFoundError(f"no committed batch has written {self.root}/{sink}")
        last = max(found, key=lambda r: r["seq"])
        schema = StructType.fromJson(json.loads(last["schema"]))
        files = [f"{self.root}/{r['file']}" for r in found if r["file"]]
        if not files:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).format(last["fmt"])
                .option("basePath", f"{self.root}/{sink}").load(files))

    def has(self, sink: str, after: int = 0) -> bool:
        return not self.entries().filter((F.col("sink") == sink) & (F.col("seq") > after)).isEmpty()

    # --------------------------------------------------------- housekeeping
    def expire(self, sink: str, keep_from: str, by: str = "event_month") -> int:
        """Drops the partitions of a sink whose value is less than ``keep_from``,
        as text; the one of null values stays. Returns the number of files
        dropped. Rows are neither read nor written."""
        value = F.regexp_extract("file", f"/{by}=([^/]+)/", 1)
        old = (self.entries().filter((F.col("sink") == sink) & (value != "") & (value < keep_from)
                                     & (value != "__HIVE_DEFAULT_PARTITION__"))
               .select("sink", "file").distinct().collect())  # names, as any file index holds
        if old:
            self.spark.createDataFrame(old, DROP).coalesce(1).write.mode("append").json(
                f"{self.root}/commits/drops")
        if storage.exists(self.spark, f"{self.root}/commits/drops"):
            for row in self._drops().filter(F.col("sink") == sink).distinct().collect():
                storage.remove(self.spark, f"{self.root}/{row['file']}")
        return len(old)

    def compact(self) -> None:
        """Folds all entries into one snapshot and drops their files."""
        folder = f"{self.root}/commits/entries"
        if not storage.exists(self.spark, folder):
            return
        files = self.spark.read.schema(ENTRY).json(folder).inputFiles()
        version = storage.newest_version(self.spark, f"{self.root}/commits") + 1
        snapshot = f"{self.root}/commits/snapshot-{version}"
        storage.remove(self.spark, snapshot)  # left by a run that did not get to name it
        self.entries().write.parquet(snapshot)
        storage.publish_version(self.spark, f"{self.root}/commits", version)
        for file in files:
            storage.remove(self.spark, file)
        self._forget_drops()
        if version > 1:
            storage.remove(self.spark, f"{self.root}/commits/snapshot-{version - 1}")
        self._load()

    def _forget_drops(self) -> None:
        """Removes dropped files that are still there, and the list of them: the
        snapshot does not name them any more."""
        folder = f"{self.root}/commits/drops"
        if storage.exists(self.spark, folder):
            for row in self._drops().distinct().collect():
                storage.remove(self.spark, f"{self.root}/{row['file']}")
            storage.remove(self.spark, folder)

    def vacuum(self, sinks: Sequence[str], hours: float = VACUUM_AFTER_H) -> list[str]:
        """Removes the folders of attempts that never committed and are older
        than ``hours``; returns their paths."""
        kept = {r["attempt"] for r in self.entries().select("attempt").distinct().collect()}
        before = (time.time() - hours * 3600) * 1000
        gone = []
        for sink in sinks:
            for name, at in storage.children(self.spark, f"{self.root}/{sink}").items():
                if name.startswith("batch=") and name[6:] not in kept and at <= before:
                    gone.append(f"{self.root}/{sink}/{name}")
                    storage.remove(self.spark, gone[-1])
        return gone
