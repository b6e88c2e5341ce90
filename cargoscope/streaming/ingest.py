"""Ingest stream (G1, G3, G4, G5): messages -> decode -> validate -> sinks.

* Exactly-once (G4): the source offsets live in the checkpoint, and a batch
  counts once the commit log (``streaming.commits``) names its files. Readers
  follow the log; a batch that is in it is not processed again. The batch's
  "now" is the read time that Spark stores with its offsets, so an attempt
  after a crash judges lateness as the first one did. Redelivered message ids
  are dropped within ``DEDUP_WINDOW``, measured by the read time, which never
  runs back, so no message is ever late for the watermark, whatever its
  file's age, its broker timestamp or its telemetry time. Topics
  (``published``, a broker) may get a message twice, with the same id.
* Late data (G3) is a rule with a recorded reason (``stale``).
* Delivery attempts (G5): with a ``RetryPolicy``, messages that could not be
  published wait in a durable queue (``streaming.delivery``). Without one,
  publishing is retried on the spot with doubling pauses, and what still fails
  after ``MAX_ATTEMPTS`` goes to the dead-letter sink with that count and a
  result of 500. Rejected messages go to the quarantine sink with reason and
  snippet.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope import schemas
from cargoscope.functions.columns import as_of_col
from cargoscope.operators import tables, validate
from cargoscope.sources import messages as msgsrc
from cargoscope.streaming.commits import Batch, CommitLog, stream_identity
from cargoscope.streaming.delivery import (PUBLISH_FAILED, QUEUE, RetryPolicy, queued, retry_pass,
                                           ticks_like)

DEDUP_WINDOW = "24 hours"
MAX_ATTEMPTS = 5  # deliveries before a message counts as dead (fixed value)
FIRST_PAUSE_S = 1.0


def with_read_time(messages: DataFrame) -> DataFrame:
    """Adds the time at which the batch was first read (Spark keeps it with the
    batch's offsets, so a replay has the same). A message without an id is known
    by its body, which a redelivery repeats."""
    body = F.sha2(F.coalesce("value", F.lit("")).cast("binary"), 256)
    return messages.withColumns({"read_time": F.current_timestamp(),
                                 "message_id": F.coalesce("message_id", body)})


def deduplicated(messages: DataFrame, window: str = DEDUP_WINDOW) -> DataFrame:
    """Drops message ids that the stream has read within ``window``."""
    return (with_read_time(messages).withWatermark("read_time", window)
            .dropDuplicatesWithinWatermark(["message_id"]))


def now_of(batch: DataFrame, as_of=None):
    """The batch's "now": ``as_of``, else its read time, else the clock."""
    return F.col("read_time") if as_of is None and "read_time" in batch.columns else as_of


def landed_telemetry(accepted: DataFrame) -> DataFrame:
    """Accepted messages as rows of the telemetry table (declared schema and
    types). The id is a digest of the message id, so a replay lands the same
    rows; ``message_id`` follows the declared columns."""
    row_id = F.conv(F.substring(F.md5("message_id"), 1, 15), 16, 10).cast("long")
    rows = accepted.withColumn("id", row_id).withColumn("event_time", F.col("timestamp"))
    return tables.with_defaults(rows, "telemetry").select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.TELEMETRY.fields], "message_id")


def publish(write: Callable[[], None], attempts: int = MAX_ATTEMPTS,
            pause_s: float = FIRST_PAUSE_S) -> int | None:
    """Runs an idempotent ``write`` up to ``attempts`` times, pausing twice as
    long after each failure. Returns the attempts used, None if all failed."""
    for attempt in range(1, attempts + 1):
        try:
            write()
            return attempt
        except Exception:  # noqa: BLE001 - any sink error counts as a failed delivery
            if attempt < attempts:
                time.sleep(pause_s * 2 ** (attempt - 1))
    return None


def process_ingest_batch(batch: DataFrame, batch_id: int, out_dir: str, as_of=None,
                         sink: Callable[[DataFrame, int], None] | None = None,
                         attempts: int = MAX_ATTEMPTS, pause_s: float = FIRST_PAUSE_S,
                         stream: str = "", log: CommitLog | None = None,
                         retry: RetryPolicy | None = None, now=None) -> None:
    """One micro-batch: decode, validate, write every sink, commit. Does
    nothing if (``stream``, ``batch_id``) is committed already.

    ``sink(messages, batch_id)`` publishes elsewhere than to files, e.g. to a
    broker. The checked batch is written once, read by every sink and removed.
    With ``retry`` a failed publish is not tried again here: the accepted
    messages wait in the retry queue (``streaming.delivery``).
    """
    log = log or CommitLog(batch.sparkSession, out_dir)
    if log.committed(stream, batch_id):
        return
    with log.batch(stream, batch_id) as out:
        decoded = validate.decode_telemetry(batch)
        checked = validate.validate_telemetry(decoded, as_of=now_of(batch, as_of), time_col="timestamp")
        checked = out.stage(validate.ingest_result(checked).drop("body_snippet"))
        if checked.isEmpty():  # a trigger that only moves the dedup window
            return
        accepted, rejected = validate.split_valid(checked)

        def files():
            out.write("published", msgsrc.publish_frame(accepted), fmt="json")

        def elsewhere():
            sink(msgsrc.publish_frame(accepted), batch_id)

        used = publish(files if sink is None else elsewhere, 1 if retry else attempts, pause_s)
        out.write("quarantine", msgsrc.quarantine_frame(rejected))
        if used is None and retry:
            results = accepted.limit(0)  # known once the queue is through with them
            out.write(QUEUE, queued(accepted, now or dt.datetime.now(dt.timezone.utc), retry))
        elif used is None:
            dead = accepted.withColumn("reject_reason", F.lit(PUBLISH_FAILED))
            results = dead.withColumn("status_code", F.lit(validate.STATUS_SERVER_ERROR))
            out.write("dead_letter", msgsrc.quarantine_frame(dead, attempts=attempts))
        else:
            results = accepted
            write_partitions(out, "telemetry", landed_telemetry(accepted))
        out.write("results", results.select("message_id", "status_code").unionByName(
            rejected.select("message_id", "status_code")))


def write_partitions(out: Batch, sink: str, rows: DataFrame, time_col: str = "event_time") -> None:
    """Lands a batch's rows by ``event_month``, so readers prune months."""
    out.write(sink, tables.with_time_partitions(rows, time_col).drop("event_date"), by=["event_month"])


def compact(spark: SparkSession, path: str, month: str, target: str) -> None:
    """Rewrites one month's batches of a committed sink (``<folder>/<sink>``) as
    few device-clustered files under ``target``."""
    root, _, sink = path.rstrip("/").rpartition("/")
    rows = CommitLog(spark, root).read(sink).filter(F.col("event_month") == month).drop("event_month", "batch")
    tables.write_telemetry(rows, target, grain="month", mode="append")


def drop_expired(log: CommitLog, sink: str, as_of, days: int = 7, by: str = "event_month") -> int:
    """Drops the partitions of a committed sink that hold only rows older than
    ``days`` at ``as_of`` (G7); ``tables.apply_retention`` filters the rest of
    the oldest one kept. Returns the number of files dropped."""
    now = dt.datetime.now(dt.timezone.utc) if as_of is None else as_of  # partitions are in UTC
    since = as_of_col(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    text = F.date_format(since, "yyyy_MM") if by == "event_month" else F.to_date(since).cast("string")
    keep_from = log.spark.range(1).select(text.alias("t")).first()["t"]
    return log.expire(sink, keep_from, by)


def run_ingest(spark: SparkSession, source_dir: str | None, out_dir: str, checkpoint_dir: str,
               as_of=None, available_now: bool = True, processing_time: str | None = None,
               max_files_per_trigger: int | None = msgsrc.FILES_PER_TRIGGER, dedup: bool = True,
               fmt: str = "json", options: dict | None = None,
               sink: Callable[[DataFrame, int], None] | None = None,
               attempts: int = MAX_ATTEMPTS, pause_s: float = FIRST_PAUSE_S,
               retry: RetryPolicy | None = None):
    """Start the ingest stream; returns the ``StreamingQuery``.

    With ``retry`` (and a ``sink``) failed deliveries go to the retry queue,
    which every trigger looks at first; a continuous stream triggers without
    new messages, too.

    ``available_now`` processes what is there and stops (tests, backfills);
    otherwise ``processing_time`` (e.g. ``"5 seconds"``) keeps it running.
    ``fmt`` and ``options`` choose the source (files or a broker).
    """
    stream = msgsrc.read_messages(spark, source_dir, streaming=True, fmt=fmt, options=options,
                                  max_files_per_trigger=max_files_per_trigger)
    stream = deduplicated(stream) if dedup else with_read_time(stream)
    if retry and not available_now:
        stream = stream.unionByName(ticks_like(stream))
    log = CommitLog(spark, out_dir)

    def step(df, bid):
        if retry and sink:
            retry_pass(spark, out_dir, sink, retry, log=log)
        process_ingest_batch(df, bid, out_dir, as_of, sink, attempts, pause_s,
                             stream_identity(spark, checkpoint_dir), log, retry)

    writer = (stream.writeStream.foreachBatch(step)
              .option("checkpointLocation", checkpoint_dir))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_landed(spark: SparkSession, out_dir: str, sink: str) -> DataFrame:
    """One sink of the ingest stream as a table: the committed batches' files."""
    return CommitLog(spark, out_dir).read(sink)
