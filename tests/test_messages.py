"""Message sources and sinks: payload shape, attributes, bounded pulls, round trip."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cargoscope.sources import messages

ACCEPTED = ("device_id string, shipment_id string, timestamp timestamp, lat double, lon double, "
            "temperature double, humidity double, speed_kmh double, battery_pct double")


def test_payload_omits_null_optionals_in_field_order(spark):
    ts = dt.datetime(2024, 1, 30, 23, 0, 0, 123456)
    df = spark.createDataFrame([("d1", "s1", ts, 1.5, -2.0, None, 40.0, None, None)], ACCEPTED)
    [row] = messages.publish_frame(df).collect()
    body = json.loads(row.value)
    assert list(body) == ["device_id", "timestamp", "lat", "lon", "humidity", "shipment_id"]
    assert body["timestamp"] == "2024-01-30T23:00:00.123456Z"
    assert row.attributes == {"device_id": "d1", "shipment_id": "s1", "content_type": "application/json"}


def test_published_payload_decodes_back(spark):
    from cargoscope.operators import validate
    ts = dt.datetime(2024, 1, 30, 23, 0, 0)
    df = spark.createDataFrame([("d1", "s1", ts, 1.5, -2.0, 20.0, 40.0, 10.0, 0.0)], ACCEPTED)
    out = validate.validate_telemetry(validate.decode_telemetry(messages.publish_frame(df)),
                                      as_of="2024-01-31 00:00:00", time_col="timestamp")
    r = out.first()
    assert r.reject_reason is None and (r.lat, r.battery_pct) == (1.5, 0.0)


@pytest.mark.parametrize("n", [0, 201, -3])
def test_pull_bounds(spark, n):
    df = spark.range(5).select(F.col("id").cast("string").alias("message_id"))
    with pytest.raises(ValueError):
        messages.pull(df, n)


def test_pull_limits(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("message_id"))
    assert messages.pull(df).count() == 50
    assert messages.pull(df, 200).count() == 200


def test_write_then_read_messages(spark, scratch):
    rows = [("m1", '{"a":1}', {"content_type": "application/json"}), ("m2", "x", None)]
    df = spark.createDataFrame(rows, "message_id string, value string, attributes map<string,string>")
    messages.write_messages(df, f"{scratch}/topic")
    back = messages.read_messages(spark, f"{scratch}/topic")
    got = {r.message_id: (r.value, r.attributes) for r in back.collect()}
    assert got["m1"] == ('{"a":1}', {"content_type": "application/json"})
    assert "arrival_time" in back.columns


def test_quarantine_frame(spark):
    df = spark.createDataFrame([("m1", "y" * 300, "malformed")],
                               "message_id string, value string, reject_reason string")
    [r] = messages.quarantine_frame(df, attempts=5).collect()
    assert r.body_snippet == "y" * 200 + "..." and r.attempts == 5 and r.reject_reason == "malformed"
