"""Streams (availableNow): stream result = batch result, restart adds no
duplicates; training, model scoring and artifact round trip."""

import json
import os

from pyspark.sql import functions as F

from cargoscope.operators import evaluation, scoring, training, validate
from cargoscope.sources.fixtures import AS_OF, Fixtures
from cargoscope.session import plan_text
from cargoscope.sources.messages import kafka_envelopes, kafka_records
from cargoscope.sources.tables import read_table
from cargoscope.streaming import ingest
from cargoscope.streaming import scoring as stream_scoring
from cargoscope.streaming.refresh import read_page, refresh_summary, stream_rate_violations
from tests.conftest import SMOKE_DIR

EARLY = "2024-01-01 00:00:00"  # nothing is stale yet


def write_batches(spark, msgs, folder, parts):
    """Message envelopes as JSON-lines files, one folder write per batch."""
    for i in range(parts):
        (msgs.filter(F.col("id") % parts == i).drop("id").coalesce(1)
         .write.mode("overwrite").json(f"{folder}/batch{i}"))
        # the file source reads a flat folder: move the part files up
        for name in os.listdir(f"{folder}/batch{i}"):
            if name.endswith(".json"):
                os.replace(f"{folder}/batch{i}/{name}", f"{folder}/b{i}-{name}")


def test_ingest_stream_equals_batch_and_is_idempotent(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    msgs = fx.messages().cache()
    src, out, ckpt = f"{scratch}/src", f"{scratch}/out", f"{scratch}/ckpt"
    os.makedirs(src)
    write_batches(spark, msgs, src, 3)

    q = ingest.run_ingest(spark, src, out, ckpt, as_of=AS_OF)
    q.awaitTermination()
    published = ingest.read_landed(spark, out, "published")
    quarantined = ingest.read_landed(spark, out, "quarantine")

    batch = validate.validate_telemetry(validate.decode_telemetry(msgs), as_of=AS_OF, time_col="timestamp")
    ok, bad = validate.split_valid(batch)
    assert published.count() == ok.count()
    assert quarantined.count() == bad.count()
    assert sorted(r.message_id for r in published.collect()) == sorted(r.message_id for r in ok.collect())
    landed = ingest.read_landed(spark, out, "telemetry")
    assert landed.filter("id is null").count() == 0
    assert landed.count() == ok.count() and "event_month" in landed.columns

    # Restart on the same checkpoint with nothing new: no output added.
    q = ingest.run_ingest(spark, src, out, ckpt, as_of=AS_OF)
    q.awaitTermination()
    assert ingest.read_landed(spark, out, "published").count() == ok.count()

    # Redelivery of already-seen message ids in a new file: dropped by the dedup.
    write_batches(spark, msgs.filter(F.col("id") % 3 == 0), src + "/../redo", 1)
    for name in os.listdir(f"{scratch}/redo"):
        os.replace(f"{scratch}/redo/{name}", f"{src}/redo-{name}")
    q = ingest.run_ingest(spark, src, out, ckpt, as_of=AS_OF)
    q.awaitTermination()
    assert ingest.read_landed(spark, out, "published").count() == ok.count()


def test_no_message_is_lost_to_file_age_or_order(spark, scratch):
    msgs = Fixtures(spark, SMOKE_DIR).messages().cache()
    src, out, ckpt = f"{scratch}/src", f"{scratch}/out", f"{scratch}/ckpt"
    os.makedirs(src)
    write_batches(spark, msgs, src, 4)
    for i, name in enumerate(sorted(n for n in os.listdir(src) if n.endswith(".json"))):
        t = os.stat(f"{src}/{name}").st_mtime - [0, 72, 20 * 24, 1][i % 4] * 3600
        os.utime(f"{src}/{name}", (t, t))
    for _ in range(2):
        ingest.run_ingest(spark, src, out, ckpt, as_of=AS_OF, max_files_per_trigger=1).awaitTermination()
        published = ingest.read_landed(spark, out, "published").select("message_id")
        quarantined = ingest.read_landed(spark, out, "quarantine").select("message_id")
        both = [r.message_id for r in published.union(quarantined).collect()]
        assert len(both) == len(set(both)) == msgs.count()


def test_failed_publish_is_retried_then_dead_lettered(spark, scratch):
    msgs = Fixtures(spark, SMOKE_DIR).messages().limit(200).cache()
    src = f"{scratch}/src"
    os.makedirs(src)
    write_batches(spark, msgs, src, 1)
    calls = []

    def sink(fail_times):
        def write(df, batch_id):
            calls.append(batch_id)
            if len(calls) <= fail_times:
                raise OSError("broker is away")
            df.write.mode("overwrite").json(f"{scratch}/broker{fail_times}/{batch_id}")
        return write

    for fails, dead in ((2, False), (5, True)):
        calls.clear()
        out = f"{scratch}/out{fails}"
        ingest.run_ingest(spark, src, out, f"{scratch}/ckpt{fails}", as_of=EARLY, sink=sink(fails),
                          pause_s=0.01).awaitTermination()
        results = {r.status_code: r.n for r in spark.read.parquet(f"{out}/results").groupBy(
            "status_code").agg(F.count("*").alias("n")).collect()}
        assert sum(results.values()) == 200 and (500 in results) == dead and (202 in results) != dead
        assert len(calls) == min(fails + 1, 5)
        if dead:
            letters = spark.read.parquet(f"{out}/dead_letter")
            assert letters.count() == results[500]
            assert {(r.attempts, r.reject_reason) for r in letters.collect()} == {(5, "publish_failed")}
            assert not os.path.exists(f"{out}/telemetry")
        else:
            assert spark.read.parquet(f"{out}/telemetry").count() == results[202]


def test_landed_tables_have_the_declared_schema_and_replay_to_the_same_rows(spark, scratch):
    msgs = Fixtures(spark, SMOKE_DIR).messages().drop("id").limit(300)
    for _ in range(2):
        ingest.process_ingest_batch(msgs, 7, f"{scratch}/out", as_of=EARLY)
        stream_scoring.process_scoring_batch(
            spark.read.schema("message_id string, value string, attributes map<string,string>")
            .json(f"{scratch}/out/published"), 3, f"{scratch}/scored",
            scoring.linear_scorer([1 / 8, 0, 0, 0, 0, 0, 0], 0.0), as_of=AS_OF)
        tel = read_table(spark, f"{scratch}/out/telemetry", "telemetry")
        events = read_table(spark, f"{scratch}/scored/anomaly_events", "anomaly_events")
        seen = ([r.id for r in tel.orderBy("id").collect()],
                [r.event_id for r in events.orderBy("event_id").collect()])
        assert None not in seen[0] and len(set(seen[0])) == len(seen[0]) > 0
        assert len(set(seen[1])) == len(seen[1]) > 0
        first = seen if _ == 0 else first
        assert seen == first
    plan = plan_text(tel.filter("event_month = '2024_01'"))
    assert "PartitionFilters: [isnotnull(event_month" in plan


def test_kafka_columns(spark):
    raw = spark.createDataFrame(
        [("t", 1, 5, b"{}", [("message_id", b"m1"), ("content_type", b"application/json")], AS_OF),
         ("t", 1, 6, b"x", None, AS_OF)],
        "topic string, partition int, offset long, value binary, "
        "headers array<struct<key:string,value:binary>>, timestamp string")
    a, b = kafka_envelopes(raw).collect()
    assert (a.message_id, a.value, a.attributes["content_type"]) == ("m1", "{}", "application/json")
    assert (b.message_id, b.attributes) == ("t-1-6", {})
    back = kafka_records(kafka_envelopes(raw)).collect()[0]
    assert (back.key, back.value, bytes(back.headers[0].value)) == ("m1", "{}", b"m1")


def test_scoring_stream(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    msgs = fx.messages().cache()
    src, out, ckpt = f"{scratch}/src", f"{scratch}/out", f"{scratch}/ckpt"
    os.makedirs(src)
    write_batches(spark, msgs, src, 2)
    scorer = scoring.linear_scorer([1 / 128, 1 / 256, 0, 0, 1 / 512, -1 / 256, 0], 0.5)
    q = stream_scoring.run_scoring(spark, src, out, ckpt, scorer, as_of=AS_OF)
    q.awaitTermination()
    results = spark.read.parquet(f"{out}/results")
    skipped = spark.read.parquet(f"{out}/skipped")
    decoded = validate.decode_features(msgs)
    assert results.count() == decoded.filter(F.col("decode_reason").isNull()).count()
    assert skipped.count() == decoded.filter(F.col("decode_reason").isNotNull()).count()
    events = spark.read.parquet(f"{out}/anomaly_events")
    assert events.count() == results.filter("is_anomaly").count()
    anomaly_msgs = spark.read.json(f"{out}/anomaly_messages")
    one = json.loads(anomaly_msgs.first().value)
    assert one["is_anomaly"] is True and one["threshold"] == 0.75


def test_stream_rate_violations(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    src = f"{scratch}/src"
    os.makedirs(src)
    write_batches(spark, fx.messages(), src, 1)
    from cargoscope.sources.messages import read_messages
    stream = read_messages(spark, src, streaming=True)
    counts = stream_rate_violations(stream, "device_id", threshold=0, seconds=3600)
    q = (counts.writeStream.format("memory").queryName("rates_test").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT SUM(n) AS n FROM rates_test").first().n
    assert got == fx.messages().count()


def test_dashboard_refresh(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    for _ in range(2):  # a reader gets the newest finished version, never a half-written one
        refresh_summary(lambda: (fx.shipments(), fx.telemetry(), fx.anomaly_events()), f"{scratch}/page")
    os.makedirs(f"{scratch}/page/pages/99999999999999999999")
    assert read_page(spark, f"{scratch}/page").count() == 200


def test_train_score_save_load(spark, scratch):
    fx = Fixtures(spark, SMOKE_DIR)
    loaded = training.load_training(fx.training(), as_of=AS_OF, time_col="event_time")
    feats = training.select_features(loaded, keep=["event_id", "device_id", "event_time"])
    split = training.temporal_split(training.impute(feats), ["event_time", "device_id", "event_id"])
    model = training.train(split, max_iter=3)
    test = split.filter(F.col("split") == "test")
    scored = scoring.score(test, model, out="p")
    values = [r.p for r in scored.select("p").collect()]
    assert values and all(0.0 <= v <= 1.0 for v in values)
    training.save_model(model, f"{scratch}/model")
    again = scoring.score(test, training.load_model(f"{scratch}/model"), out="p")
    assert sorted(values) == sorted(r.p for r in again.select("p").collect())
    report = evaluation.evaluate(scored, "anomaly_label", "p").first()
    assert 0.0 <= report.roc_auc <= 1.0


def test_split_fraction(spark):
    fx = Fixtures(spark, SMOKE_DIR)
    feats = training.select_features(fx.training().filter("anomaly_label IS NOT NULL"),
                                     keep=["event_id", "device_id", "event_time"])
    split = training.temporal_split(feats, ["event_time", "device_id", "event_id"])
    n = split.count()
    train_rows = split.filter("split = 'train'")
    assert train_rows.count() == int(n * 0.8)
    last_train = train_rows.agg(F.max("event_time")).first()[0]
    first_test = split.filter("split = 'test'").agg(F.min("event_time")).first()[0]
    assert last_train <= first_test


def test_periodic_refresh_writes_page(spark, scratch):
    import time

    from cargoscope.streaming.refresh import start_refresh
    fx = Fixtures(spark, SMOKE_DIR)
    out = f"{scratch}/page"
    q = start_refresh(spark, lambda: (fx.shipments(), fx.telemetry(), fx.anomaly_events()), out,
                      f"{scratch}/ckpt", processing_time="1 second", limit=50)
    try:
        deadline = time.time() + 90
        while time.time() < deadline and not os.path.exists(f"{out}/versions/_SUCCESS"):
            time.sleep(1)
    finally:
        q.stop()
    assert read_page(spark, out).count() == 50
