"""Gateway decode + validation: the reference's handler cases and the S-rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import validate

AS_OF = "2024-01-31 00:00:00"
NOW = "2024-01-30T23:00:00Z"
JSON_CT = {"content_type": "application/json"}


def valid_payload(**over):
    p = {"device_id": "unit-7", "shipment_id": "box-42", "timestamp": NOW, "lat": -12.25,
         "lon": 130.75, "temperature": 4.0, "humidity": 35.5, "speed_kmh": 51.0, "battery_pct": 64.0}
    p.update(over)
    return p


def run(spark, bodies, attrs=None):
    rows = [(f"m{i}", b, attrs or JSON_CT) for i, b in enumerate(bodies)]
    msgs = spark.createDataFrame(rows, "message_id string, value string, attributes map<string,string>")
    checked = validate.validate_telemetry(validate.decode_telemetry(msgs), as_of=AS_OF,
                                          time_col="timestamp")
    out = (validate.ingest_result(checked).drop("timestamp", "arrival_time")
           .orderBy("message_id").collect())
    return out


def test_valid_payload_accepted(spark):
    [r] = run(spark, [json.dumps(valid_payload())])
    assert r.reject_reason is None and r.status_code == 202


def test_missing_device_rejected(spark):
    p = valid_payload()
    del p["device_id"]
    [r] = run(spark, [json.dumps(p)])
    assert (r.reject_reason, r.status_code) == ("device_id", 400)
    assert "device_id" in r.error


def test_bad_latitude_rejected(spark):
    [r] = run(spark, [json.dumps(valid_payload(lat=999))])
    assert (r.reject_reason, r.status_code) == ("lat", 400)
    assert r.error == "payload validation failed: invalid latitude: 999.000000 (must be -90..90)"


def test_stale_rejected(spark):
    old = "2024-01-29T00:00:00Z"  # 48 h before as_of
    [r] = run(spark, [json.dumps(valid_payload(timestamp=old))])
    assert (r.reject_reason, r.status_code) == ("stale", 400)


def test_stale_boundary_is_strict(spark):
    exactly = "2024-01-30T00:00:00Z"  # exactly 24 h: not stale
    [r] = run(spark, [json.dumps(valid_payload(timestamp=exactly))])
    assert r.reject_reason is None


def test_wrong_content_type(spark):
    [r] = run(spark, [json.dumps(valid_payload())], attrs={"content_type": "text/plain"})
    assert (r.reject_reason, r.status_code) == ("content_type", 415)
    [r] = run(spark, [json.dumps(valid_payload())],
              attrs={"content_type": "application/json; charset=utf-8"})
    assert r.status_code == 415


def test_content_type_checked_before_json(spark):
    [r] = run(spark, ["not json"], attrs={"content_type": "text/plain"})
    assert r.reject_reason == "content_type"


@pytest.mark.parametrize("body,reason", [
    ('{"device_id":123,"shipment_id":"s","timestamp":"%s"}' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s","lat":"28"}' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s","lat":null}' % NOW, None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s"}' % NOW, None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s","lat":NaN}' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s"} trailing' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s"}{}' % NOW, "malformed"),
    ("", "malformed"),
    ("null", "device_id"),
    ('[{"device_id":"d"}]', "malformed"),
    ('{"device_id":"d","shipment_id":"s"', "malformed"),
    ("{'device_id':'d'}", "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-30T23:00:00"}', "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-30"}', "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-31T04:00:00+05:30"}', None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-30T23:00:00.123456789Z"}', None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"0001-01-01T00:00:00Z"}', "timestamp"),
    ('{"device_id":"","shipment_id":"s","timestamp":"%s"}' % NOW, "device_id"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s","battery_pct":0.0}' % NOW, None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s","battery_pct":101}' % NOW, "battery_pct"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s","speed_kmh":9999}' % NOW, None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2030-01-01T00:00:00Z"}', None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s"}] xyz' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s"},{"a":1}' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s"},{"a":0}]' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"%s","speed_kmh":1e400}' % NOW, "malformed"),
    ('{"Device_ID":"d","SHIPMENT_id":"s","timestamp":"%s"}' % NOW, None),
    ('{"device_id":"x","device_id":"","shipment_id":"s","timestamp":"%s"}' % NOW, "device_id"),
    ('{"device_id":"x","device_id":null,"shipment_id":"s","timestamp":"%s"}' % NOW, None),
    ('{"device_id":1,"device_id":"x","shipment_id":"s","timestamp":"%s"}' % NOW, "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-30T23:00:00.1234567891Z"}', None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-30T23:00:00,5Z"}', "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-31T18:00:00+19:00"}', None),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-01-31T18:00:00+24:00"}', "malformed"),
    ('{"device_id":"d","shipment_id":"s","timestamp":"2024-02-30T23:00:00Z"}', "malformed"),
    (None, "malformed"), ("{}", "device_id"), (' null\n', "device_id"), ('"text"', "malformed"),
])
def test_decode_golden_rows(spark, body, reason):
    [r] = run(spark, [body])
    assert r.reject_reason == reason


def test_only_the_first_mib_of_a_body_is_decoded(spark):
    [r] = run(spark, [json.dumps(valid_payload(pad="x" * (1 << 20)))])
    assert r.reject_reason == "malformed"  # cut inside a string
    assert r.body_snippet.endswith("...") and len(r.body_snippet) == 203
    [r] = run(spark, [json.dumps(valid_payload()) + " " * (1 << 20) + "not json"])
    assert r.reject_reason is None and r.device_id == "unit-7"


def test_last_key_and_offset_arithmetic(spark):
    body = ('{"device_id":"a","DEVICE_ID":"b","device_id":null,"shipment_id":"s","battery_pct":5,'
            '"Battery_Pct":null,"lat":3,"lat":null,"timestamp":"2024-01-31T18:30:00.9876543219+19:45"}')
    [r] = (validate.decode_telemetry(spark.createDataFrame(
        [("m", body, JSON_CT)], "message_id string, value string, attributes map<string,string>"))
        .selectExpr("*", "cast(timestamp as string) as at").drop("timestamp").collect())
    assert (r.device_id, r.battery_pct, r.lat) == ("b", None, 3.0)
    assert r.at == "2024-01-30 22:45:00.987654"


def test_missing_lat_lon_decode_to_zero(spark):
    body = '{"device_id":"d","shipment_id":"s","timestamp":"%s"}' % NOW
    [r] = run(spark, [body])
    assert (r.lat, r.lon) == (0.0, 0.0)


def test_first_failing_rule_wins(spark):
    df = spark.createDataFrame(
        [("", None, None, 999.0, 999.0, 999.0, -1.0, -1.0)],
        "device_id string, shipment_id string, event_time timestamp, lat double, lon double, "
        "temperature double, humidity double, battery_pct double")
    r = validate.validate_telemetry(df, as_of=AS_OF).first()
    assert r.reject_reason == "device_id"


def test_rule_order(spark):
    rows = [
        ("d", "s", dt.datetime(2024, 1, 30, 12), 95.0, 200.0, 300.0, 101.0, 101.0, "lat"),
        ("d", "s", dt.datetime(2024, 1, 30, 12), 0.0, 200.0, 300.0, 101.0, 101.0, "lon"),
        ("d", "s", dt.datetime(2024, 1, 30, 12), 0.0, 0.0, 300.0, 101.0, 101.0, "temperature"),
        ("d", "s", dt.datetime(2024, 1, 30, 12), 0.0, 0.0, None, 101.0, 101.0, "humidity"),
        ("d", "s", dt.datetime(2024, 1, 30, 12), 0.0, 0.0, None, None, 101.0, "battery_pct"),
        ("d", "s", dt.datetime(2024, 1, 20, 12), 95.0, 0.0, None, None, None, "stale"),
    ]
    df = spark.createDataFrame(rows, "device_id string, shipment_id string, event_time timestamp_ntz, "
                                     "lat double, lon double, temperature double, humidity double, "
                                     "battery_pct double, expected string")
    for r in validate.validate_telemetry(df, as_of=AS_OF).collect():
        assert r.reject_reason == r.expected


def test_strict_gps_option(spark):
    df = spark.createDataFrame([("d", "s", dt.datetime(2024, 1, 30, 12), None, 1.0)],
                               "device_id string, shipment_id string, event_time timestamp_ntz, "
                               "lat double, lon double")
    df = df.withColumn("temperature", F.lit(None).cast("double")) \
           .withColumn("humidity", F.lit(None).cast("double")) \
           .withColumn("battery_pct", F.lit(None).cast("double"))
    assert validate.validate_telemetry(df, as_of=AS_OF).first().reject_reason is None
    assert validate.validate_telemetry(df, as_of=AS_OF, strict_gps=True).first().reject_reason == "lat"


def test_validation_is_permutation_invariant(spark):
    from cargoscope.sources.fixtures import Fixtures
    tel = Fixtures(spark, "/root/testdata/sf0.001").telemetry()
    a = validate.validate_telemetry(tel, as_of=AS_OF).select("id", "reject_reason")
    b = validate.validate_telemetry(tel.orderBy(F.rand(7)), as_of=AS_OF).select("id", "reject_reason")
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("body,ok", [
    ('{"device_id":"unit-7","shipment_id":"box-42","temperature":-3.5,"humidity":12,"lat":-12.25,'
     '"lon":130.75,"speed_kmh":0.0,"battery_pct":7,"hours_since_last_checkpoint":1.25}', True),
    ('{"device_id":"unit-7"}', False),
    ('{"device_id":"d","shipment_id":"s","lat":" 2.5e1 ","lon":true}', True),
    ('{"device_id":"d","shipment_id":"s","lat":"28d","lon":1}', False),
    ('{"device_id":"d","shipment_id":"s","lat":"0x1p3","lon":1}', False),
    ('{"device_id":"d","shipment_id":"s","lat":"-inf","lon":1}', True),
    ('{"device_id":"d","shipment_id":"s","lat":1,"lat":null,"lon":1}', False),
    ('{"device_id":"d","shipment_id":"s","lat":"x","lat":3,"lon":1}', True),
    ('{"Device_ID":"d","shipment_id":"s","lat":1,"lon":1}', False),
    ('{"device_id":"d","shipment_id":"s","lat":1,"lon":1}] x', False),
    ('{"device_id":"d","shipment_id":"s","lat":1,"lon":1},{"a":1}', False),
    ("null", False), ("", False), (None, False),
    ('{"device_id":"d","shipment_id":"s","lat":"28.5","lon":1,"extra":{"x":1}}', True),
    ('{"device_id":1,"shipment_id":"s","lat":1,"lon":1}', False),
    ('{"device_id":"d","shipment_id":"s","lat":null,"lon":1}', False),
    ('{"device_id":"d","shipment_id":"s","lat":"abc","lon":1}', False),
    ("[]", False),
])
def test_decode_features(spark, body, ok):
    msgs = spark.createDataFrame([("m", body)], "message_id string, value string")
    r = validate.decode_features(msgs).first()
    assert (r.decode_reason is None) == ok


def test_content_type_wins_over_oversized_body(spark):
    body = json.dumps(valid_payload(pad="x" * (1 << 20)))
    [r] = run(spark, [body], attrs={"content_type": "text/plain"})
    assert (r.reject_reason, r.status_code) == ("content_type", 415)


def test_ingest_request_handler_cases(spark):
    ok = json.dumps(valid_payload())
    assert validate.ingest_request(spark, ok, as_of=AS_OF) == (
        202, {"status": "accepted", "message_id": "request", "device_id": "unit-7"})
    missing = valid_payload()
    del missing["device_id"]
    status, resp = validate.ingest_request(spark, json.dumps(missing), as_of=AS_OF)
    assert status == 400 and "device_id" in resp["error"]
    assert validate.ingest_request(spark, json.dumps(valid_payload(lat=999)), as_of=AS_OF)[0] == 400
    assert validate.ingest_request(spark, json.dumps(valid_payload(timestamp="2024-01-29T00:00:00Z")),
                                   as_of=AS_OF)[0] == 400
    assert validate.ingest_request(spark, ok, content_type="text/plain", as_of=AS_OF) == (
        415, {"error": "Content-Type must be application/json"})


def random_body(rnd):
    """Flat objects with repeated, re-cased and mistyped keys, and broken ones."""
    def value():
        return rnd.choice(['"d"', '""', "null", "5", "-0", "-0.0", "-0.5", "0", "12.25", "1e3", "1E-2", "1e400",
                           "true", "false", '"12.5"', '" 7 "', '"2024-01-30T23:00:00Z"', '"x\\"lat\\":1"',
                           '"\\u0041\\n"', "01", "NaN", "[1]", '{"lat":1}', "123456789012345678",
                           "0.1234567890123456789", '"lat"', "-", '"{"'])
    keys = ["device_id", "shipment_id", "timestamp", "lat", "lon", "temperature", "humidity", "speed_kmh",
            "battery_pct", "hours_since_last_checkpoint", "Lat", "DEVICE_ID", "extra", "a1", "lat "]
    good = {"device_id": '"d"', "shipment_id": '"s"', "timestamp": '"2024-01-30T23:00:00Z"', "lat": "1.5",
            "lon": "-2"}
    pairs = list(good.items())
    for _ in range(rnd.randrange(4)):
        pairs.insert(rnd.randrange(len(pairs) + 1), (rnd.choice(keys), value()))
    gap = rnd.choice(["", " ", "\n\t"])
    body = "{" + ("," + gap).join(f'{gap}"{k}"{gap}:{gap}{v}' for k, v in pairs) + "}"
    return rnd.choice(["", "", "", " "]) + body + rnd.choice(["", "", "", "\n", "x", ",{}", "}"])


def test_typed_and_general_decode_agree(spark, monkeypatch):
    import random
    rnd = random.Random(11)
    rows = [(str(i), random_body(rnd), {"content_type": "application/json"}) for i in range(4000)]
    msgs = spark.createDataFrame(rows, "message_id string, value string, attributes map<string,string>").cache()

    def both():
        return ({r.message_id: r for r in validate.decode_telemetry(msgs).collect()},
                {r.message_id: r for r in validate.decode_features(msgs).collect()})

    typed = both()
    plain = validate._typed(msgs, F.col("value"), ["device_id", "shipment_id", "timestamp"],
                            ["lat", "lon", *validate.OPTIONAL_SENSORS], True)
    assert 400 < plain.filter("_plain").count() < 3600
    monkeypatch.setattr(validate, "FLAT_BODY_CHARS", -1)
    general = both()
    for a, b in zip(typed, general):
        assert {k: str(v) for k, v in a.items()} == {k: str(v) for k, v in b.items()}
    assert {r.decode_reason for r in typed[0].values()} == {None, "malformed"}
