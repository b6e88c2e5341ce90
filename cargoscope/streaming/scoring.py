"""Scoring stream (G2): published telemetry -> features -> score -> flag -> emit.

Malformed messages are skipped from the results but acknowledged (S18): the
checkpoint commits them and they are counted in the skipped sink. The scorer
is the same pluggable one as in batch (a fitted pipeline is shipped to the
executors once per batch, not called once per message). Sinks are committed
batch by batch (``streaming.commits``), as in the ingest stream; landed events
have ids made from their message ids.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.operators import scoring, validate
from cargoscope.schemas import ANOMALY_THRESHOLD
from cargoscope.sources import messages as msgsrc
from cargoscope.streaming.commits import CommitLog, stream_identity
from cargoscope.streaming.ingest import deduplicated, write_partitions

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
MESSAGE_ONLY = ("attributes", "arrival_time")  # not needed once a message is decoded


def process_scoring_batch(batch: DataFrame, batch_id: int, out_dir: str, scorer,
                          threshold: float = ANOMALY_THRESHOLD, as_of=None,
                          sink: Callable[[DataFrame, int], None] | None = None,
                          stream: str = "", log: CommitLog | None = None) -> None:
    """One micro-batch: the decoded batch is staged once and read by every
    sink; does nothing if the batch is committed already. An event's time is
    the batch's read time, so it is the same in every attempt."""
    log = log or CommitLog(batch.sparkSession, out_dir)
    if log.committed(stream, batch_id):
        return
    with log.batch(stream, batch_id) as out:
        decoded = out.stage(validate.decode_features(batch).drop(*MESSAGE_ONLY))
        if decoded.isEmpty():
            return
        ok = decoded.filter(F.col("decode_reason").isNull())
        flagged = scoring.flag_anomalies(scoring.score(ok, scorer), threshold)
        now = as_of
        if as_of is None and "read_time" in decoded.columns:  # one time in all rows of a batch
            micros = decoded.select(F.unix_micros(F.max("read_time")).alias("t")).first()["t"]
            now = EPOCH + dt.timedelta(microseconds=micros)
        results = out.stage(scoring.anomaly_results(flagged))
        out.write("results", results)
        messages, events = scoring.emit_anomalies(results, as_of=now)
        if sink is None:
            out.write("anomaly_messages", messages, fmt="json")
        else:
            sink(messages, batch_id)
        write_partitions(out, "anomaly_events", events)
        skipped = decoded.filter(F.col("decode_reason").isNotNull()).withColumnRenamed(
            "decode_reason", "reject_reason")
        out.write("skipped", msgsrc.quarantine_frame(skipped))


def run_scoring(spark: SparkSession, source_dir: str | None, out_dir: str, checkpoint_dir: str, scorer,
                threshold: float = ANOMALY_THRESHOLD, as_of=None, available_now: bool = True,
                processing_time: str | None = None,
                max_files_per_trigger: int | None = msgsrc.FILES_PER_TRIGGER, fmt: str = "json",
                options: dict | None = None, sink: Callable[[DataFrame, int], None] | None = None):
    """Start the scoring stream over published telemetry messages."""
    stream = deduplicated(msgsrc.read_messages(spark, source_dir, streaming=True, fmt=fmt,
                                               options=options,
                                               max_files_per_trigger=max_files_per_trigger))
    log = CommitLog(spark, out_dir)

    def step(df, bid):
        process_scoring_batch(df, bid, out_dir, scorer, threshold, as_of, sink,
                              stream_identity(spark, checkpoint_dir), log)

    writer = (stream.writeStream.foreachBatch(step)
              .option("checkpointLocation", checkpoint_dir))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
