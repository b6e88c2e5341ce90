"""Dashboard refresh (G6) and streaming rate check (X2 on a stream).

The reference polls the summary every 5 seconds. Here a refresh re-runs
``shipments_summary`` over the landed tables and writes a new version of a
small result table; ``start_refresh`` drives it from a rate source every
``processing_time``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.operators import dashboard, rates
from cargoscope.operators.rates import RATE_LIMIT_COUNT, RATE_LIMIT_SECONDS, rate_violations
from cargoscope.sources import storage
from cargoscope.streaming.commits import CommitLog, stream_identity

REFRESH_EVERY = "5 seconds"
PAGE_SIZE = 200
KEEP_PAGES = 3


def refresh_summary(load: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], out_path: str,
                    limit: int = PAGE_SIZE, status: str | None = None,
                    version: int | None = None) -> str:
    """Recompute the summary page from freshly loaded tables.

    ``load`` returns (shipments, telemetry, anomaly_events) each time, so new
    partitions landed by the streams are picked up. Each refresh writes a new
    folder and then publishes its version, one more than the greatest so far
    (or ``version``, if that is greater), so neither a restart nor a refresh
    by hand can publish a page that later ones do not replace. A reader takes
    the newest version (:func:`read_page`) and never sees a half-written page.
    The newest ``KEEP_PAGES`` pages are kept.

    This reads the tables' whole history; ``streaming.maintained`` keeps the
    same page from what is new.
    """
    shipments, telemetry, events = load()
    page = dashboard.shipments_summary(shipments, telemetry, events, status=status, limit=limit)
    spark = page.sparkSession
    version = max(version or 0, storage.newest_version(spark, out_path) + 1)
    path = f"{out_path}/pages/{version:020d}"
    page.coalesce(1).write.mode("overwrite").parquet(path)
    storage.publish_version(spark, out_path, version)
    for name in storage.children(spark, f"{out_path}/pages"):
        if name.isdigit() and int(name) <= version - KEEP_PAGES:
            storage.remove(spark, f"{out_path}/pages/{name}")
    return path


def read_page(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest finished page."""
    return spark.read.parquet(f"{out_path}/pages/{storage.newest_version(spark, out_path):020d}")


def load_landed(spark: SparkSession, shipments: DataFrame, ingest_dir: str,
                scoring_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dashboard's tables over what the streams landed."""
    return (shipments, CommitLog(spark, ingest_dir).read("telemetry"),
            CommitLog(spark, scoring_dir).read("anomaly_events"))


def start_refresh(spark: SparkSession, load, out_path: str, checkpoint_dir: str,
                  processing_time: str = REFRESH_EVERY, limit: int = PAGE_SIZE):
    """Run ``refresh_summary`` on every trigger of a 1-row-per-second rate source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream
            .foreachBatch(lambda _df, _bid: refresh_summary(load, out_path, limit))
            .option("checkpointLocation", checkpoint_dir)
            .trigger(processingTime=processing_time).start())


def run_rate_counts(messages: DataFrame, path: str, checkpoint_dir: str, key: str = "device_id",
                    seconds: int = RATE_LIMIT_SECONDS, time_col: str = "arrival_time",
                    available_now: bool = True, processing_time: str | None = None):
    """Keeps the counts of every (window, key) of a message stream in a table
    (``rates.counts_table``): each batch adds its own counts, so rows that come
    late, by days or weeks, correct their window instead of being dropped.
    Batches are applied once. Read violations with ``rates.over_limit``."""
    spark = messages.sparkSession
    table = rates.counts_table(spark, path)

    def step(batch, batch_id):
        keyed = batch if key in batch.columns else batch.withColumn(key, batch["attributes"][key])
        counts = rates.rate_counts(keyed, key, seconds, time_col)
        table.merge(counts, rates.add_counts, {stream_identity(spark, checkpoint_dir): batch_id})

    writer = messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def stream_rate_violations(messages: DataFrame, key: str = "device_id",
                           threshold: int = RATE_LIMIT_COUNT, seconds: int = RATE_LIMIT_SECONDS,
                           watermark: str = "24 hours") -> DataFrame:
    """Windowed per-key counts on a message stream, watermarked on arrival
    time; in append mode each (window, key) is emitted once when final."""
    keyed = messages.withColumn(key, messages["attributes"][key]) if key not in messages.columns \
        else messages
    return rate_violations(keyed.withWatermark("arrival_time", watermark), key, threshold, seconds,
                           time_col="arrival_time")
