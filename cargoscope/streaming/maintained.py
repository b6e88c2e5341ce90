"""The dashboard kept up to date from what is new.

The reference polls a statement that reads every shipment's history. Here each
batch is reduced to one row per shipment it mentions (its newest position by
``max(struct)``, its change in open anomalies) and merged into a table of
positions bucketed by shipment; the page is the old page and the batch's
changed shipments, cut to its size again. ``updated_at`` never runs back, so a
shipment that is neither on the old page nor changed cannot get on the new one.
A refresh reads the new rows, the positions of the buckets they touch and the
buckets of the page's shipments; it never reads history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope import schemas
from cargoscope.operators.dashboard import SUMMARY_COLUMNS
from cargoscope.sources import storage
from cargoscope.sources.buckets import BucketedTable, hashed
from cargoscope.streaming.commits import CommitLog

POSITION = ("lat", "lon", "temperature", "speed_kmh")
SHIPMENT = ["shipment_id", "origin_hub", "destination_hub", "carrier_id", "status", "updated_at"]
BUCKETS = 256
PAGE_SIZE = 200
KEEP_PAGES = 3


def position_change(telemetry: DataFrame) -> DataFrame:
    """shipment_id, the newest row as a struct, no change of anomalies."""
    newest = F.max(F.struct("event_time", "id", *POSITION)).alias("newest")
    return telemetry.groupBy("shipment_id").agg(newest, F.lit(0).cast("long").alias("open_anomalies"))


def anomaly_change(events: DataFrame, telemetry: DataFrame, sign: int = 1) -> DataFrame:
    """shipment_id and what its open anomalies change by: the unresolved among
    new ``events``, or ``sign=-1`` times those that were resolved since."""
    none = F.lit(None).cast(position_change(telemetry).schema["newest"].dataType).alias("newest")
    opened = F.sum((~F.col("resolved") if sign > 0 else F.lit(True)).cast("long")) * sign
    return events.groupBy("shipment_id").agg(opened.alias("open_anomalies")).select(
        "shipment_id", none, "open_anomalies")


def combined(current: DataFrame | None, changes: DataFrame) -> DataFrame:
    rows = changes if current is None else current.unionByName(changes)
    return rows.groupBy("shipment_id").agg(F.max("newest").alias("newest"),
                                           F.sum("open_anomalies").alias("open_anomalies"))


class MaintainedSummary:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, page_size: int = PAGE_SIZE):
        self.spark, self.path, self.page_size = spark, path.rstrip("/"), page_size
        self.positions = BucketedTable(spark, f"{self.path}/positions", hashed("shipment_id", buckets=buckets))

    def _shipments(self) -> DataFrame | None:
        version = storage.newest_version(self.spark, f"{self.path}/shipments")
        return self.spark.read.parquet(f"{self.path}/shipments/page-{version}") if version else None

    def apply(self, telemetry: DataFrame, events: DataFrame, shipments: DataFrame | None = None,
              resolved: DataFrame | None = None, progress: dict[str, int] | None = None) -> list[int]:
        """Takes in new telemetry, new anomaly events, shipments that changed
        (whole rows) and events that were resolved since they were taken in.
        Returns the position buckets it rewrote."""
        changes = position_change(telemetry).unionByName(anomaly_change(events, telemetry))
        if resolved is not None:
            changes = changes.unionByName(anomaly_change(resolved, telemetry, sign=-1))
        touched = self.positions.merge(combined(None, changes), combined, progress)
        if shipments is not None:
            self._turn_page(shipments.select(*SHIPMENT))
        return touched

    def _turn_page(self, changed: DataFrame) -> None:
        old = self._shipments()
        rows = changed if old is None else old.unionByName(changed)
        newest = rows.groupBy("shipment_id").agg(F.max_by(F.struct(*SHIPMENT[1:]), "updated_at").alias("s"))
        page = newest.select("shipment_id", "s.*").orderBy(
            F.col("updated_at").desc(), "shipment_id").limit(self.page_size)
        version = storage.newest_version(self.spark, f"{self.path}/shipments") + 1
        page.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/shipments/page-{version}")
        storage.publish_version(self.spark, f"{self.path}/shipments", version)
        if version > KEEP_PAGES:
            storage.remove(self.spark, f"{self.path}/shipments/page-{version - KEEP_PAGES}")

    def refresh(self, ingest: CommitLog, scored: CommitLog, shipments: DataFrame | None = None) -> list[int]:
        """Takes in what the streams have committed since the last refresh."""
        done = self.positions.progress()
        upto = {"ingest": ingest.last_seq(), "scored": scored.last_seq()}
        after = {k: done.get(k, 0) for k in upto}
        if upto == after and shipments is None:
            return []
        telemetry, events = (self._since(log, sink, after[name], upto[name]) for log, sink, name in (
            (ingest, "telemetry", "ingest"), (scored, "anomaly_events", "scored")))
        return self.apply(telemetry, events, shipments, progress=upto)

    def _since(self, log: CommitLog, sink: str, after: int, upto: int) -> DataFrame:
        if log.has(sink, after):
            return log.read(sink, after, upto)
        return self.spark.createDataFrame([], schemas.TABLES[sink])

    def page(self) -> DataFrame:
        """The summary page: its shipments with position and open anomalies."""
        page = self._shipments()
        if page is None:
            raise FileNotFoundError(f"no shipments have been taken in under {self.path}")
        keys = [r["shipment_id"] for r in page.select("shipment_id").collect()]  # at most a page
        rows = self.positions.read(self.positions.buckets_of(page)).filter(F.col("shipment_id").isin(keys))
        return (page.join(rows, "shipment_id", "left")
                .select(*SHIPMENT, *[F.col("newest")[c].alias(c) for c in POSITION],
                        F.col("newest")["event_time"].alias("last_telemetry_at"),
                        F.coalesce("open_anomalies", F.lit(0).cast("long")).alias("open_anomalies"))
                .select(*SUMMARY_COLUMNS).orderBy(F.col("updated_at").desc(), "shipment_id"))
