"""Commit log of the streams: a batch counts once, whole, whatever is retried."""

import os

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import scoring
from cargoscope.sources import messages as msgsrc
from cargoscope.sources.fixtures import AS_OF, Fixtures
from cargoscope.streaming import ingest
from cargoscope.streaming import scoring as stream_scoring
from cargoscope.streaming.commits import CommitLog, stream_identity
from tests.conftest import SMOKE_DIR

LATER = "2024-03-15 00:00:00"
SCORER = scoring.linear_scorer([1 / 8, 0, 0, 0, 0, 0, 0], 0.0)


@pytest.fixture(scope="module")
def messages(spark):
    return Fixtures(spark, SMOKE_DIR).messages().drop("id").limit(200).cache()


def ids(df):
    return sorted(r.message_id for r in df.select("message_id").collect())


def test_replay_at_a_later_date_changes_nothing(spark, scratch, messages):
    out = f"{scratch}/out"
    ingest.process_ingest_batch(messages, 0, out, as_of=AS_OF)
    landed, bad = ids(ingest.read_landed(spark, out, "telemetry")), ids(ingest.read_landed(spark, out, "quarantine"))
    ingest.process_ingest_batch(messages, 0, out, as_of=LATER)  # all would be stale now
    assert ids(ingest.read_landed(spark, out, "telemetry")) == landed
    assert ids(ingest.read_landed(spark, out, "quarantine")) == bad
    assert sorted(landed + bad) == ids(messages)


def test_events_replayed_past_a_month_end_are_there_once(spark, scratch, messages):
    out = f"{scratch}/scored"
    for as_of in ("2024-01-31 23:59:59", "2024-02-01 00:00:01"):
        stream_scoring.process_scoring_batch(messages, 5, out, SCORER, as_of=as_of)
    events = CommitLog(spark, out).read("anomaly_events")
    assert events.count() == events.select("event_id").distinct().count() > 0
    assert {r.event_month for r in events.select("event_month").distinct().collect()} == {"2024_01"}


def test_an_attempt_without_commit_is_not_read(spark, scratch, messages):
    out = f"{scratch}/out"

    def dies(_batch, _id):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ingest.process_ingest_batch(messages, 0, out, as_of=LATER, sink=dies)
    attempt = CommitLog(spark, out).batch("", 0)
    attempt.write("quarantine", msgsrc.quarantine_frame(messages.withColumn("reject_reason", F.lit("x"))))
    attempt.close(commit=False)
    ingest.process_ingest_batch(messages, 0, out, as_of=AS_OF)
    both = ids(ingest.read_landed(spark, out, "telemetry")) + ids(ingest.read_landed(spark, out, "quarantine"))
    assert sorted(both) == ids(messages)
    log = CommitLog(spark, out)
    assert log.vacuum(["quarantine"], hours=1) == []
    assert len(log.vacuum(["quarantine", "nowhere"], hours=-1)) == 1
    assert len(os.listdir(f"{out}/quarantine")) == 1
    assert sorted(ids(log.read("telemetry")) + ids(log.read("quarantine"))) == ids(messages)


def test_staging_is_removed(spark, scratch, messages):
    out = f"{scratch}/out"
    ingest.process_ingest_batch(messages, 0, out, as_of=AS_OF)
    stream_scoring.process_scoring_batch(messages, 0, f"{scratch}/scored", SCORER, as_of=AS_OF)
    assert os.listdir(f"{out}/staging") == [] == os.listdir(f"{scratch}/scored/staging")


def test_batches_of_another_stream_are_not_replays(spark, scratch, messages):
    out = f"{scratch}/out"
    ingest.process_ingest_batch(messages.limit(100), 0, out, as_of=AS_OF, stream="a")
    ingest.process_ingest_batch(messages.limit(50), 0, out, as_of=AS_OF, stream="b")
    log = CommitLog(spark, out)
    assert log.read("results").count() == 150
    assert log.committed("a", 0) and log.committed("b", 0) and not log.committed("a", 1)


def test_log_compacts_and_reads_the_same(spark, scratch, messages):
    out = f"{scratch}/out"
    log = CommitLog(spark, out)
    for k in range(4):
        ingest.process_ingest_batch(messages.limit(20), k, out, as_of=AS_OF, log=log)
        if k in (1, 2):
            log.compact()
    assert CommitLog(spark, out).read("results").count() == 80 == log.read("results").count()
    again = CommitLog(spark, out)
    assert all(again.committed("", k) for k in range(4)) and not again.committed("", 4)
    assert again.last_seq() == 4 and again.read("results", after=2, upto=3).count() == 20
    assert len(again.entries().filter("sink = 'results'").collect()) >= 4
    assert len([n for n in os.listdir(f"{out}/commits") if n.startswith("snapshot")]) == 1


def test_unwritten_sink_raises(spark, scratch):
    with pytest.raises(FileNotFoundError):
        CommitLog(spark, f"{scratch}/none").read("telemetry")


def test_read_time_is_the_batch_now(spark, scratch):
    fresh = spark.createDataFrame(
        [("m1", '{"device_id":"d","shipment_id":"s","timestamp":"2020-01-02T00:00:00Z"}',
          {"content_type": "application/json"})], "message_id string, value string, attributes map<string,string>")
    batch = fresh.withColumn("read_time", F.lit("2020-01-02 05:00:00").cast("timestamp"))
    ingest.process_ingest_batch(batch, 0, f"{scratch}/out")
    assert ids(ingest.read_landed(spark, f"{scratch}/out", "telemetry")) == ["m1"]


def test_messages_without_id_are_kept_apart(spark):
    rows = [(None, "a", None), (None, "b", None), ("x", "a", None), (None, None, None)]
    df = spark.createDataFrame(rows, "message_id string, value string, attributes map<string,string>")
    assert ingest.with_read_time(df).select("message_id").distinct().count() == 4


def test_stream_commits_under_its_checkpoint_identity(spark, scratch, messages):
    src = f"{scratch}/src"
    messages.coalesce(1).write.json(src)
    ingest.run_ingest(spark, src, f"{scratch}/out", f"{scratch}/ckpt", as_of=AS_OF).awaitTermination()
    name = stream_identity(spark, f"{scratch}/ckpt")
    entries = CommitLog(spark, f"{scratch}/out").entries()
    assert {r.stream for r in entries.collect()} == {name} and len(name) == 36
    # A new checkpoint reads the source again under another identity: its ids are no replays.
    ingest.run_ingest(spark, src, f"{scratch}/out", f"{scratch}/ckpt2", as_of=AS_OF).awaitTermination()
    assert CommitLog(spark, f"{scratch}/out").entries().select("stream").distinct().count() == 2
